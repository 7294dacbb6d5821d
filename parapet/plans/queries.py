"""The registered queries: every operator over the given tables.

Lists are joined to text, times are text and long texts are digests, so that results
compare across engines. ``spark, folder`` are the session and the table folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet import lexicon as lx
from parapet.functions import risk, scoring
from parapet.functions import text as tx
from parapet.operators import audit as au
from parapet.operators import evaluation as ev
from parapet.operators import incidents as inc
from parapet.operators import listing as ls
from parapet.operators import metrics as mt
from parapet.operators import normalize as nz
from parapet.operators import paging as pg
from parapet.operators import requests as rq
from parapet.operators import text_index as ti
from parapet.operators.filters import (
    AuditFilter,
    BoardFilter,
    calendar_dates,
    present,
    text_dates,
)
from parapet.operators.lexicon_match import builtin_lexicon, compiled_matches, match_lexicon
from parapet.operators.normalize import to_conversations
from parapet.operators.quota import quota_verdicts, with_quota_status
from parapet.plans import corpus as cp
from parapet.plans import flagship
from parapet.plans.batch import audit_batch
from parapet.schemas import CSV_READ, CSV_WRITE
from parapet.session import cut_lineage, shared_folder
from parapet.sources import readers as rd
from parapet.sources import writers as wr
from parapet.streaming import ingest as si
from parapet.streaming import jobs as sj
from parapet.streaming import latency as sl
from parapet.streaming import totals as st
from parapet.streaming.quota import live_windows
from parapet.streaming.quota import stream_quota as quota_stream
from parapet.streaming.volume import daily_totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY_SECONDS = 86_400
QUOTA_LIMIT = 5


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(column: str | Column, name: str | None = None) -> Column:
    array = F.col(column) if isinstance(column, str) else column
    return F.array_join(array, "|").alias(name or column)


def digest(column: str) -> Column:
    return F.md5(F.col(column)).alias(f"{column}_md5")


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def day_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def seeded_rows(spark: SparkSession, folder: str) -> DataFrame:
    return nz.to_conversations(cp.seeded_input(spark, folder))


# --- detectors -------------------------------------------------------------------


@query
def detect_pii(spark, folder):
    found = au.detect(seeded_rows(spark, folder))
    return found.select("id", "has_pii", joined("pii_data"), joined("pii_types"))


@query
def detect_pii_pages(spark, folder):
    pages = cp.spread(cp.table(spark, folder, "pages"))
    return au.detect(pages, "html").select("page_id", "has_pii", joined("pii_data"))


@query
def redact_pii(spark, folder):
    cleaned = au.redact(seeded_rows(spark, folder))
    return cleaned.select("id", digest("output_text"), "redaction_count", "redaction_applied")


@query
def redact_pages(spark, folder):
    pages = cp.spread(cp.table(spark, folder, "pages"))
    cleaned = au.redact(pages, "html")
    return cleaned.select("page_id", digest("html"), "redaction_count")


@query
def detect_refusal(spark, folder):
    found = au.detect(seeded_rows(spark, folder))
    return found.select("id", "is_refusal", "refusal_phrase")


@query
def detect_self_harm(spark, folder):
    found = au.detect(seeded_rows(spark, folder))
    return found.select("id", "self_harm", "self_harm_match")


@query
def detect_jailbreak(spark, folder):
    found = au.detect(seeded_rows(spark, folder))
    return found.select("id", "jailbreak", "jailbreak_phrase")


@query
def detect_bias(spark, folder):
    found = au.detect(seeded_rows(spark, folder))
    return found.select("id", "bias", "bias_match")


@query
def detect_toxicity(spark, folder):
    scorer = scoring.stored_score("given_toxicity")
    found = au.detect(seeded_rows(spark, folder), toxicity=scorer)
    return found.select("id", F.round("toxicity_score", 6).alias("toxicity_score"))


@query
def detect_sentiment(spark, folder):
    scorer = scoring.stored_score("given_sentiment")
    found = au.detect(seeded_rows(spark, folder), sentiment=scorer)
    return found.select("id", F.round("sentiment_score", 6).alias("sentiment_score"))


def letter_model():
    """A stand-in model: the count of the letter e in hundredths, modulo 101.

    It fails on some texts.
    """

    def score(texts):
        if any(len(t) % 7 == 3 for t in texts):
            raise ValueError("a text this model cannot take")
        return [[{"label": "toxicity", "score": t.count("e") % 101 / 100}] for t in texts]

    return score


@query
def model_scores(spark, folder):
    documents = cp.spread(cp.table(spark, folder, "documents"))
    result = scoring.model_result(letter_model)(F.col("text"))
    scored = documents.select("doc_id", "text", result.alias("r"))
    found = au.detect(scored, "text", toxicity=scoring.stored_score("r.score"))
    return found.select(
        "doc_id", F.round("toxicity_score", 6).alias("toxicity_score"),
        F.col("r.failed").alias("score_failed"),
    )


@query
def model_scores_staged(spark, folder):
    """The same scores from a stage of their own, texts batched by length."""
    documents = cp.spread(cp.table(spark, folder, "documents")).select("doc_id", "text")
    found = scoring.scored_table(documents, letter_model, "text")
    return found.select(
        "doc_id", F.round("score", 6).alias("toxicity_score"), F.col("failed").alias("score_failed")
    )


@query
def analyze_output(spark, folder):
    documents = cp.spread(cp.table(spark, folder, "documents"))
    found = au.detect(documents, "text")
    return found.select(
        "doc_id", "has_pii", "is_refusal", "self_harm", "jailbreak", "bias",
        "toxicity_score", "sentiment_score",
    )


@query
def signal_totals(spark, folder):
    documents = cp.spread(cp.table(spark, folder, "documents"))
    flags = ("has_pii", "is_refusal", "self_harm", "jailbreak", "bias")
    found = au.detect(documents, "text")
    return found.groupBy("lang").agg(
        F.count("*").alias("texts"), *[F.count_if(c).alias(c) for c in flags]
    )


@query
def lexicon_join(spark, folder):
    documents = cp.spread(cp.table(spark, folder, "documents"))
    matched = match_lexicon(documents, builtin_lexicon(spark))
    return matched.select("doc_id", F.inline("matches")).select("doc_id", "signal", "phrase")


@query
def lexicon_terms(spark, folder):
    """A lexicon from a table: the long words of all benchmark items."""
    words = F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("phrase")
    terms = cp.table(spark, folder, "benchmark").select(words).filter(F.length("phrase") >= 7)
    lexicon = terms.distinct().select(
        F.concat(F.lit("term "), F.left("phrase", F.lit(1))).alias("signal"),
        F.length("phrase").alias("ord"), "phrase",
    )
    documents = cp.table(spark, folder, "documents").select("doc_id", "text")
    matched = match_lexicon(documents, lexicon, compiled=0)
    return matched.select("doc_id", F.inline("matches")).select("doc_id", "signal", "phrase")


@query
def lexicon_compiled(spark, folder):
    documents = cp.spread(cp.table(spark, folder, "documents"))
    lists = {"jailbreak": lx.JAILBREAK_PHRASES, "bias_group": lx.BIAS_GROUPS}
    return documents.select(
        "doc_id", *[c.alias(n) for n, c in compiled_matches(F.col("text"), lists).items()]
    )


# --- risk ------------------------------------------------------------------------


def fresh_audit(spark, folder, **options) -> DataFrame:
    return au.audit(
        seeded_rows(spark, folder),
        toxicity=scoring.stored_score("given_toxicity"),
        sentiment=scoring.stored_score("given_sentiment"),
        batch_time=cp.BATCH_TIME,
        **options,
    )


@query
def risk_labels(spark, folder):
    return fresh_audit(spark, folder).select("id", joined("risk_labels"), "flagged")


@query
def risk_explanations(spark, folder):
    return fresh_audit(spark, folder).select("id", joined("risk_explanations"))


@query
def audit_rows(spark, folder):
    return fresh_audit(spark, folder).select(
        "id", "timestamp", "input_text", digest("output_text"),
        F.round("toxicity_score", 6).alias("toxicity_score"),
        "has_pii", "is_refusal", "self_harm", "jailbreak", "bias",
        F.round("sentiment_score", 6).alias("sentiment_score"),
        joined("risk_labels"), joined("risk_explanations"), joined("pii_types"),
        "flagged", "redaction_applied", "redaction_count",
        "project_name", "model_name", "user_id", "request_id", joined("tags"),
        stamp("ts"), day_text("audit_date"),
    )


@query
def audit_unredacted(spark, folder):
    rows = fresh_audit(spark, folder, redact_pii=False)
    return rows.select("id", digest("output_text"), "redaction_applied", "redaction_count")


@query
def audit_threshold(spark, folder):
    rows = fresh_audit(spark, folder, threshold=0.45)
    return rows.select("id", "flagged", joined("risk_explanations"))


@query
def batch_summary(spark, folder):
    return au.batch_summary(fresh_audit(spark, folder))


@query
def audit_conversations(spark, folder):
    rows = au.audit(cp.reply_pairs(spark, folder), batch_time=cp.BATCH_TIME)
    return rows.select(
        "id", digest("input_text"), digest("output_text"), "request_id", "flagged",
        joined("risk_labels"), joined("risk_explanations"),
    )


@query
def audit_benchmark(spark, folder):
    items = cp.table(spark, folder, "benchmark")
    found = au.evaluate(items, "text")
    return found.select("item_id", "flagged", joined("risk_labels"))


# --- normalising -----------------------------------------------------------------


@query
def normalize_tags(spark, folder):
    raw = cp.seeded_input(spark, folder).select("id", "tags")
    return nz.normalize_tags(raw).select("id", joined("tags"))


@query
def shape_conversations(spark, folder):
    raw = cp.seeded_input(spark, folder).select("id", "output_text", "user_id")
    return nz.to_conversations(raw).select(
        "id", "input_text", digest("output_text"), "user_id", "project_name", joined("tags")
    )


@query
def fill_missing(spark, folder):
    raw = seeded_rows(spark, folder).withColumn(
        "tags", F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(
            F.col("tags")
        )
    )
    rows = nz.fill_missing(raw, tags=["batch", "default"], project_name="none", user_id="nobody")
    return rows.select("id", "project_name", "user_id", joined("tags"))


@query
def fill_falsy(spark, folder):
    rows = nz.fill_falsy(seeded_rows(spark, folder), tags=["x"], project_name="none")
    return rows.select("id", "project_name", joined("tags"))


@query
def fill_timestamp(spark, folder):
    rows = nz.fill_timestamp(seeded_rows(spark, folder), cp.BATCH_TIME)
    return rows.select("id", "timestamp")


def blanked(spark, folder) -> DataFrame:
    """Seeded rows, some with blank or padded texts."""
    number = F.col("id")
    return seeded_rows(spark, folder).withColumns(
        {
            "input_text": F.when(number % 5 == 0, F.lit(" \t \n")).otherwise(
                F.concat(F.lit(" "), "input_text", F.lit("　"))
            ),
            "output_text": F.when(number % 7 == 0, F.lit("")).otherwise(F.col("output_text")),
            "project_name": F.concat(F.lit(" "), "project_name", F.lit(" ")),
        }
    )


@query
def quarantine_split(spark, folder):
    _, rejected = nz.split_valid(nz.strip_fields(blanked(spark, folder)))
    return rejected.select("id", "input_text", "project_name", "reject_reason")


@query
def accepted_rows(spark, folder):
    valid, _ = nz.split_valid(nz.strip_fields(blanked(spark, folder)))
    return valid.select("id", "input_text", "project_name", digest("output_text"))


@query
def decode_lists(spark, folder):
    rows = seeded_rows(spark, folder)
    number = F.col("id")
    raw = (
        F.when(number % 5 == 0, F.lit(None).cast("string"))
        .when(number % 5 == 1, F.lit(""))
        .when(number % 5 == 2, F.concat(F.lit("["), "model_name"))
        .when(number % 5 == 3, F.col("user_id"))
        .otherwise(tx.encode_list(F.col("tags")))
    )
    return rows.select("id", joined(tx.decode_list(raw), "items"))


@query
def encode_lists(spark, folder):
    rows = seeded_rows(spark, folder)
    return rows.select("id", tx.encode_list(F.col("tags")).alias("tags_json"))


@query
def decode_flags(spark, folder):
    raw = F.element_at(
        F.array(*[F.lit(w) for w in ["1", " TRUE ", "t", "Yes", "y", "0", "false", "no", "", "on"]]),
        (F.col("doc_id") % 10 + 1).cast("int"),
    )
    rows = cp.table(spark, folder, "documents").withColumn("raw", raw)
    return rows.select(
        "doc_id", tx.decode_flag(F.col("raw")).alias("text_flag"),
        tx.decode_number_flag(F.col("n_chars") % 2).alias("number_flag"),
    )


@query
def result_view(spark, folder):
    view = au.result_view(cp.audited(spark, folder))
    for name in ("risk_labels", "risk_explanations", "pii_types"):
        view = view.withColumn(name, joined(name))
    for name in ("toxicity_score", "sentiment_score"):
        view = view.withColumn(name, F.round(name, 6))
    return view


@query
def parse_timestamps(spark, folder):
    rows = seeded_rows(spark, folder).select(
        "id",
        F.when(F.col("id") % 9 == 0, F.lit("not a time")).otherwise(F.col("timestamp")).alias(
            "timestamp"
        ),
    )
    return au.with_time(rows).select("id", stamp("ts"), day_text("audit_date"))


@query
def status_labels(spark, folder):
    rows = cp.audited(spark, folder)
    return rows.select("id", risk.status_label(F.col("flagged")).alias("status"))


@query
def risk_reasons(spark, folder):
    rows = cp.audited(spark, folder)
    return rows.select("id", risk.risk_reason(F.col("risk_labels")).alias("risk_reason"))


@query
def display_rows(spark, folder):
    rows = ls.display_rows(cp.audited(spark, folder))
    return rows.select(
        "timestamp", "project_name", "model_name", "user_id", "input_text", digest("output_text"),
        F.round("toxicity_score", 6).alias("toxicity_score"), "has_pii", "is_refusal",
        "self_harm", "jailbreak", "bias",
        F.round("sentiment_score", 6).alias("sentiment_score"), "flagged", "risk_reason",
    )


@query
def record_details(spark, folder):
    rows = ls.record_details(cp.audited(spark, folder))
    return rows.select(
        "id", "project_name", "model_name", "user_id", "request_id", "tags", "risk_reason",
        "status", joined("risk_explanations"), "redaction_note",
    )


@query
def client_identity(spark, folder):
    return cp.request_headers(spark, folder).select("event_id", "identity")


@query
def ensure_columns(spark, folder):
    old = cp.audited(spark, folder).select(
        "id", "timestamp", "input_text", "toxicity_score", "has_pii", "flagged"
    )
    rows = nz.ensure_columns(old)
    return rows.select(
        "id", "flagged", "project_name", "request_id", joined("tags"), joined("risk_labels"),
        "self_harm", "jailbreak", "bias", "redaction_applied", "redaction_count",
    )


@query
def assign_ids(spark, folder):
    rows = nz.assign_ids(cp.table(spark, folder, "documents").select("doc_id"))
    return rows.agg(
        F.count("*").alias("rows"),
        F.countDistinct("id").alias("ids"),
        F.min("id").alias("low"),
        F.max("id").alias("high"),
    )


@query
def union_sources(spark, folder):
    documents = seeded_rows(spark, folder).select(*cp.UNION_FIELDS)
    replies = cp.reply_pairs(spark, folder).select(*cp.UNION_FIELDS)
    rows = nz.union_all(documents, replies)
    return rows.select("id", "input_text", digest("output_text"), "request_id", joined("tags"))


# --- filters ---------------------------------------------------------------------


@query
def filter_flagged(spark, folder):
    return AuditFilter(flagged=True).apply(cp.audited(spark, folder)).select("id", "flagged")


@query
def filter_equality(spark, folder):
    chosen = AuditFilter(project_name="src3", model_name="model-en")
    return chosen.apply(cp.audited(spark, folder)).select("id", "project_name", "model_name")


@query
def filter_user(spark, folder):
    return AuditFilter(user_id="user-7").apply(cp.audited(spark, folder)).select("id", "user_id")


@query
def filter_search(spark, folder):
    return AuditFilter(search="User1_@CORP%dial").apply(fresh_audit(
        spark, folder, redact_pii=False)).select("id")


def signature_index(spark, folder) -> DataFrame:
    return ti.read_signatures(spark, cp.index_of(spark, folder, ti.write_signatures))


@query
def search_indexed(spark, folder):
    table = cp.audited(spark, folder)
    found = ti.find_like(table, signature_index(spark, folder), "or ELSE [redacted_phone]%keys")
    return found.select("id")


@query
def search_regex_indexed(spark, folder):
    table = cp.audited(spark, folder)
    found = ti.find_regex(table, signature_index(spark, folder), "(REDACTED_PHONE|lazy and)")
    return found.select("id")


@query
def filter_all_tags(spark, folder):
    return AuditFilter(tag=" en , demo").apply(cp.audited(spark, folder)).select(
        "id", joined("tags")
    )


@query
def filter_all_labels(spark, folder):
    chosen = AuditFilter(risk_label="pii,jailbreak")
    return chosen.apply(cp.audited(spark, folder)).select("id", joined("risk_labels"))


@query
def filter_dates(spark, folder):
    rows = cp.audited(spark, folder)
    return rows.filter(text_dates("2024-01-10", "2024-01-20", prune_days=True)).select(
        "id", "timestamp"
    )


@query
def filter_conjunction(spark, folder):
    chosen = AuditFilter(
        flagged=True, model_name="model-en", tag="demo", risk_label="jailbreak",
        start_date="2024-01-05", end_date="2024-02-10", search="prompt 1",
    )
    return chosen.apply(cp.audited(spark, folder)).select("id", "timestamp", "project_name")


@query
def board_status(spark, folder):
    return BoardFilter(statuses=("Safe",)).apply(cp.audited(spark, folder)).select("id")


@query
def board_regex(spark, folder):
    chosen = BoardFilter(search="(REDACTED_PHONE|lazy and)")
    return chosen.apply(cp.audited(spark, folder)).select("id")


@query
def board_toxicity(spark, folder):
    rows = BoardFilter(min_toxicity=0.55).apply(cp.audited(spark, folder))
    return rows.select("id", F.round("toxicity_score", 6).alias("toxicity_score"))


@query
def board_choices(spark, folder):
    chosen = BoardFilter(
        projects=("src1", "src2", "src3"), models=("model-en", "model-de"),
        users=tuple(f"user-{i}" for i in range(0, 50, 3)),
    )
    return chosen.apply(cp.audited(spark, folder)).select("id", "project_name", "user_id")


@query
def board_any(spark, folder):
    chosen = BoardFilter(tags=("de", "demo"), risk_labels=("bias", "self_harm"))
    return chosen.apply(cp.audited(spark, folder)).select("id", joined("risk_labels"))


@query
def board_pii_refusal(spark, folder):
    rows = cp.audited(spark, folder)
    pii = BoardFilter(pii_only=True).apply(rows).select("id", F.lit("pii").alias("kind"))
    refused = BoardFilter(refusal_only=True).apply(rows).select(
        "id", F.lit("refusal").alias("kind")
    )
    return pii.unionByName(refused)


@query
def board_calendar(spark, folder):
    rows = cp.audited(spark, folder)
    return rows.filter(calendar_dates("2024-01-31", "2024-02-05")).select("id", "timestamp")


@query
def point_lookup(spark, folder):
    return ls.by_id(cp.audited(spark, folder), 42).select("id", "timestamp", "user_id")


@query
def non_empty(spark, folder):
    return cp.audited(spark, folder).filter(present("project_name")).select("id", "project_name")


@query
def recent_24h(spark, folder):
    return cp.audited(spark, folder).agg(mt.recent_count(cp.AS_OF).alias("recent_24h"))


# --- aggregates ------------------------------------------------------------------


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query
def metrics_overview(spark, folder):
    row = mt.overview(cp.audited(spark, folder), cp.AS_OF)
    return rounded(
        row, "avg_toxicity", "refusal_rate", "self_harm_rate", "jailbreak_rate", "bias_rate",
        "pii_rate", "flagged_rate",
    )


@query
def metrics_document(spark, folder):
    row = mt.metrics_document(cp.audited(spark, folder), cp.AS_OF)
    return row.select("total", "flagged", F.explode("risk_counts").alias("label", "count"))


@query
def risk_counts(spark, folder):
    return mt.label_counts(cp.audited(spark, folder))


@query
def label_profile(spark, folder):
    return flagship.label_profile(spark, folder)


@query
def filtered_count(spark, folder):
    chosen = AuditFilter(flagged=True, tag="demo")
    return chosen.apply(cp.audited(spark, folder)).agg(F.count("*").alias("total"))


@query
def meta_values(spark, folder):
    return mt.meta_values(cp.audited(spark, folder))


@query
def meta_document(spark, folder):
    row = mt.meta_document(cp.audited(spark, folder))
    return row.select(*[joined(c) for c in row.columns])


@query
def option_values(spark, folder):
    return ls.option_values(cp.audited(spark, folder), "tags")


@query
def kpis(spark, folder):
    return mt.kpis(cp.audited(spark, folder))


@query
def shown_of_total(spark, folder):
    chosen = BoardFilter(min_toxicity=0.3, risk_labels=("jailbreak",)).predicate()
    return mt.shown_of_total(cp.audited(spark, folder), chosen)


@query
def toxicity_histogram(spark, folder):
    return mt.toxicity_histogram(cp.audited(spark, folder)).select("toxicity_bin", "count")


@query
def status_counts(spark, folder):
    return mt.status_counts(cp.audited(spark, folder))


@query
def label_counts(spark, folder):
    rows = BoardFilter(models=("model-en", "model-fr")).apply(cp.audited(spark, folder))
    return mt.label_counts(rows)


@query
def signal_breakdown(spark, folder):
    return mt.signal_breakdown(cp.audited(spark, folder))


@query
def daily_volume(spark, folder):
    return mt.daily_volume(cp.audited(spark, folder)).select(day_text("day"), "count")


@query
def incident_breakdown(spark, folder):
    return inc.risk_breakdown(cp.audited(spark, folder))


@query
def label_bars(spark, folder):
    return mt.label_bars(cp.audited(spark, folder))


# --- listings and reports --------------------------------------------------------


@query
def list_page(spark, folder):
    rows = ls.page(cp.audited(spark, folder), number=3, size=25)
    return rows.select("id", "timestamp", "flagged")


@query
def list_page_after(spark, folder):
    rows = ls.page_after(cp.audited(spark, folder), "2024-01-20T00:00:00", 0, size=40)
    return rows.select("id", "timestamp")


def last_full_page(spark, folder, flagged: bool) -> DataFrame:
    """The last page of 25 rows, found by the index of row counts."""
    index = pg.read_page_index(spark, cp.index_of(spark, folder, pg.write_page_index))
    number = max(1, pg.page_total(index, flagged) // 25)
    return pg.page_at(cp.audited(spark, folder), index, number, 25, flagged).select("id", "timestamp")


@query
def list_page_deep(spark, folder):
    return last_full_page(spark, folder, False)


@query
def list_page_deep_flagged(spark, folder):
    return last_full_page(spark, folder, True)


@query
def list_page_rows(spark, folder):
    table = cp.audited(spark, folder)
    rows = ls.late_rows(table, ls.page(table, number=2, size=50))
    return rows.select("id", "timestamp", digest("output_text"), joined("risk_labels"))


@query
def page_count(spark, folder):
    return ls.page_count(cp.audited(spark, folder), 20, AuditFilter(flagged=True))


@query
def latest_logs(spark, folder):
    rows = ls.latest(cp.audited(spark, folder), limit=5000, flagged=False)
    return rows.select("id", "timestamp", joined("tags"))


@query
def top_flagged_of_page(spark, folder):
    rows = ls.flagged_of_page(ls.page(cp.audited(spark, folder), size=20))
    return rows.withColumn("labels", joined("labels"))


@query
def incident_selection(spark, folder):
    rows = inc.select_incidents(
        cp.audited(spark, folder), limit=150, model_name="model-en", start_date="2024-01-08"
    )
    return rows.select("id", "timestamp", "model_name")


@query
def incident_timeline(spark, folder):
    return inc.timeline(cp.audited(spark, folder)).select("id", "line")


@query
def incident_report(spark, folder):
    lines = inc.report_lines(cp.audited(spark, folder), cp.AS_OF, limit=100, risk_label="bias")
    return lines.select(
        F.col("section").cast("bigint").alias("section"),
        F.col("rank").cast("bigint").alias("rank"),
        F.col("part").cast("bigint").alias("part"),
        "line",
    )


@query
def incident_documents(spark, folder):
    rows = inc.report_documents(cp.audited(spark, folder), cp.AS_OF, limit=100)
    return rows.select(
        "kind", "id",
        F.get_json_object("document", "$.count").alias("count"),
        F.get_json_object("document", "$.timestamp").alias("timestamp"),
        F.get_json_object("document", "$.risk_labels[0]").alias("first_label"),
    )


@query
def incident_documents_written(spark, folder):
    """The JSON report written and read back; texts with line breaks stay one document."""
    path = shared_folder(spark, "report")
    wr.write_documents(inc.report_documents(cp.audited(spark, folder), cp.AS_OF, limit=100), path)
    read = rd.read_documents(spark, path)
    part = lambda name: F.get_json_object("document", f"$.{name}")
    return read.select(
        "kind", part("id").cast("bigint").alias("id"), part("count").alias("count"),
        F.md5(part("output_text")).alias("output_text_md5"), part("filters.limit").alias("limit"),
    )


# --- evaluation ------------------------------------------------------------------


def counted(spark, folder, with_toxicity: bool = True, seeds: bool = True) -> DataFrame:
    """Confusion counts over seeded or bare documents; labels join the narrow guesses."""
    rows = cp.seeded_input(spark, folder)
    if not seeds:
        rows = cp.spread(cp.table(spark, folder, "documents")).select(
            F.col("doc_id").alias("id"), F.col("text").alias("output_text"),
            ((F.col("doc_id") % 101) / F.lit(100.0)).alias("given_toxicity"),
        )
    scorer = scoring.stored_score("given_toxicity") if with_toxicity else None
    guesses = ev.predict(rows.select("id", "output_text", "given_toxicity"), scorer)
    return ev.count_guesses(cp.with_labels(guesses, spark, folder), not with_toxicity)


@query
def eval_confusion(spark, folder):
    return counted(spark, folder)


@query
def eval_metrics(spark, folder):
    scored = ev.with_scores(counted(spark, folder, with_toxicity=False))
    return rounded(scored, "precision", "recall", "f1")


@query
def eval_combined(spark, folder):
    return rounded(
        ev.combined(counted(spark, folder, with_toxicity=False)), "precision", "recall", "f1"
    )


@query
def eval_gate(spark, folder):
    """Seeded rows as the baseline, the bare documents as the current run."""
    baseline = cut_lineage(ev.with_scores(counted(spark, folder)), "baseline")  # stored, as always
    current = ev.with_scores(counted(spark, folder, seeds=False))
    current = current.withColumn("skipped", F.col("signal") == "toxicity").filter(
        "signal <> 'bias'"
    )
    failed = ev.gate(baseline, current, allowed_drop=0.05)
    return rounded(failed, "baseline", "current", "drop", "allowed").drop("message")


# --- request log and jobs --------------------------------------------------------


@query
def request_stats(spark, folder):
    return rounded(rq.request_totals(cp.requests(spark, folder)), "error_rate")


@query
def request_status_codes(spark, folder):
    return rq.status_code_counts(cp.requests(spark, folder))


@query
def latency_percentiles(spark, folder):
    return rq.latency_percentiles(cp.requests(spark, folder))


@query
def latency_percentiles_by_path(spark, folder):
    return rq.latency_percentiles_by(cp.requests(spark, folder))


@query
def latency_percentiles_all(spark, folder):
    return rq.percentiles_of_all(cp.requests(spark, folder))


@query
def runtime_snapshot(spark, folder):
    jobs = rq.latest_jobs(cp.job_updates(spark, folder))
    row = rounded(rq.runtime_snapshot(cp.requests(spark, folder), jobs), "error_rate")
    codes = F.array_join(
        F.transform(F.map_entries("status_codes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|"
    )
    return row.withColumn("status_codes", codes)


@query
def quota_exempt(spark, folder):
    paths = F.element_at(
        F.array(*[F.lit(p) for p in ["/health", "/docs/x", "/audit", "/openapi.json", "/healthy"]]),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    log = cp.requests(spark, folder).withColumn("path", paths)
    return log.filter(~rq.is_exempt(F.col("path"))).select("event_id", "path")


def verdict_columns(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("identity", "event_id", "n", "allowed", "remaining", "reset_s")


@query
def quota_verdict(spark, folder):
    log = cp.requests(spark, folder)
    return verdict_columns(
        quota_verdicts(log, limit=QUOTA_LIMIT, window_seconds=DAY_SECONDS)
    )


@query
def quota_verdict_hot(spark, folder):
    """The same verdicts with every busy client taken by the pointer-jumping path."""
    log = cp.requests(spark, folder)
    return verdict_columns(
        quota_verdicts(
            log, limit=QUOTA_LIMIT, window_seconds=DAY_SECONDS, hot_rows=60, slot_us=60_000_000
        )
    )


@query
def quota_status_codes(spark, folder):
    log = with_quota_status(
        cp.requests(spark, folder), F.col("path") == "/view",
        limit=QUOTA_LIMIT, window_seconds=DAY_SECONDS,
    )
    return rq.status_code_counts(log)


@query
def job_latest(spark, folder):
    jobs = rq.latest_jobs(cp.job_updates(spark, folder))
    times = ("submitted_at", "started_at", "finished_at", "updated_at")
    return jobs.select("job_id", "status", *[stamp(c) for c in times], "error")


@query
def job_status_counts(spark, folder):
    return rq.job_status_counts(rq.latest_jobs(cp.job_updates(spark, folder)))


@query
def job_ttl(spark, folder):
    jobs = rq.latest_jobs(cp.job_updates(spark, folder))
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return rq.live_jobs(jobs, as_of, ttl_seconds=DAY_SECONDS).select("job_id", "status")


# --- sources and sinks -----------------------------------------------------------


def raw_text_rows(spark, folder) -> DataFrame:
    return cp.seeded_input(spark, folder).select(
        "input_text", "output_text", "project_name", "model_name", "user_id", "request_id",
        "tags", "timestamp",
    )


def round_trip(rows: DataFrame) -> DataFrame:
    return rows.select(
        "request_id", "input_text", digest("output_text"), "project_name", "model_name",
        "user_id", joined("tags"), "timestamp",
    )


@query
def csv_roundtrip(spark, folder):
    path = shared_folder(spark, "csv")
    raw_text_rows(spark, folder).write.options(**CSV_WRITE).csv(path)
    return round_trip(rd.read_csv(spark, path, multi_line=True))


@query
def jsonl_roundtrip(spark, folder):
    path = shared_folder(spark, "jsonl")
    rows = raw_text_rows(spark, folder)
    rows.withColumn("tags", F.split("tags", ",")).write.json(path)
    return round_trip(rd.read_jsonl(spark, path))


@query
def missing_fields(spark, folder):
    """Required fields that JSON records lack: every fifth has no input, every seventh no output."""
    rows = raw_text_rows(spark, folder).withColumn("n", F.regexp_extract("request_id", "[0-9]+", 0).cast("bigint"))
    lacking = {c: F.when(F.col("n") % k != 0, F.col(c)) for c, k in (("input_text", 5), ("output_text", 7))}
    record = F.to_json(F.struct(*rows.columns))
    cut = F.when(F.col("n") % 11 == 0, F.expr("left(record, length(record) - 2)")).otherwise(F.col("record"))
    records = rows.withColumns(lacking).select(record.alias("record"), "n").select(cut.alias("record"))
    absent = F.array_join(rd.missing_fields(F.col("record")), "|").alias("missing")
    return records.groupBy(absent).agg(F.count("*").alias("count"))


@query
def rows_in_memory(spark, folder):
    """A page of the newest rows, held by the caller, as conversations again: mappings and pairs by turns."""
    held = ls.latest(cp.audited(spark, folder), limit=400).collect()
    rows = [r.asDict() if r["id"] % 2 else (r["input_text"], r["output_text"]) for r in held]
    return rd.from_rows(spark, rows).select(
        "input_text", digest("output_text"), "project_name", "request_id", joined("tags"), "timestamp"
    )


@query
def payload_batch(spark, folder):
    rows = raw_text_rows(spark, folder).withColumn("tags", F.split("tags", ","))
    documents = rows.select(F.to_json(F.array(F.struct("*"))).alias("records"))
    return round_trip(rd.payload_rows(documents, "records"))


@query
def payload_quarantine(spark, folder):
    """Every ninth document is cut off; records of the others are kept, and all are counted."""
    rows = raw_text_rows(spark, folder).withColumns(
        {"tags": F.split("tags", ","), "number": F.regexp_extract("request_id", "[0-9]+", 0).cast("bigint")}
    )
    record = F.struct(*[c for c in rows.columns if c != "number"])
    text = F.to_json(F.array(record, record))
    cut = F.when(F.col("number") % 9 == 0, F.expr("left(text, length(text) - 3)")).otherwise(F.col("text"))
    documents = rows.select("number", text.alias("text")).select("number", cut.alias("text"))
    records, rejects = rd.split_payload(documents, "text")
    kept = records.select("number", F.lit("kept").alias("outcome"), digest("output_text"))
    gone = rejects.select("number", F.col("reject_reason").alias("outcome"), F.lit(None).cast("string").alias("output_text_md5"))
    return kept.unionByName(gone)


@query
def export_padded(spark, folder):
    """Blanks and line breaks at both ends of a text survive export and import."""
    path = shared_folder(spark, "export")
    padded = F.concat(F.lit("  \t"), F.col("output_text"), F.lit(" \n "))
    wr.export_csv(cp.audited(spark, folder).withColumn("output_text", padded), path)
    return rd.read_exported(spark, path).select("id", digest("output_text"))


@query
def append_twice(spark, folder):
    """Two batches, one of them repeated: no row twice, no id twice."""
    path = shared_folder(spark, "table")
    rows = fresh_audit(spark, folder)
    for batch, rest in ((1, 0), (2, 1), (2, 1)):
        wr.append_batch(rows.filter(F.col("id") % 2 == rest), path, batch)
    return rd.read_audit_table(spark, path).agg(
        F.count("*").alias("stored"), F.countDistinct("id").alias("ids"),
        F.countDistinct("request_id").alias("requests"), F.min("id").alias("first_id"),
        F.count_if(F.col("id") > 2 << wr.BATCH_ID_BITS).alias("second_batch"),
    )


@query
def upload_defaults(spark, folder):
    path = shared_folder(spark, "upload") + ".csv"
    raw_text_rows(spark, folder).write.options(**CSV_WRITE).csv(path)
    return round_trip(rd.read_upload(spark, path, tags=["up"], project_name="uploads"))


@query
def audit_table_roundtrip(spark, folder):
    path = shared_folder(spark, "table")
    wr.write_audit_table(fresh_audit(spark, folder), path)
    rows = rd.read_audit_table(spark, path)
    return rows.select("id", "timestamp", digest("output_text"), joined("risk_labels"),
                       day_text("audit_date"))


@query
def export_csv(spark, folder):
    path = shared_folder(spark, "export")
    wr.export_csv(cp.audited(spark, folder), path)
    rows = spark.read.options(**CSV_READ, multiLine=True).csv(path)
    return rows.select("id", "timestamp", "flagged", "risk_labels", "tags", digest("output_text"))


@query
def export_import(spark, folder):
    path = shared_folder(spark, "export")
    wr.export_csv(cp.audited(spark, folder), path)
    rows = rd.read_exported(spark, path)
    return rows.select(
        "id", "timestamp", digest("output_text"), "flagged", "has_pii", "redaction_count",
        F.round("toxicity_score", 6).alias("toxicity_score"), joined("risk_explanations"),
        joined("tags"), day_text("audit_date"),
    )


@query
def export_filtered(spark, folder):
    path = shared_folder(spark, "export")
    chosen = AuditFilter(flagged=False, model_name="model-en")
    wr.export_csv(cp.audited(spark, folder), path, chosen)
    rows = spark.read.options(**CSV_READ, multiLine=True).csv(path)
    return nz.decode_row(rows).select("id", "flagged", "is_refusal", joined("risk_labels"))


@query
def metrics_roundtrip(spark, folder):
    path = shared_folder(spark, "metrics")
    counts = counted(spark, folder, with_toxicity=False)
    wr.write_metrics(ev.metrics_json(counts, lx.TOXICITY_THRESHOLD, False), path)
    return rounded(rd.read_metrics(spark, path), "precision", "recall", "f1")


@query
def labeled_roundtrip(spark, folder):
    path = shared_folder(spark, "labeled")
    names = [f"label_{s}" for s in lx.EVAL_SIGNALS]
    rows = cp.with_labels(cp.seeded_input(spark, folder), spark, folder)
    # a false label is left out, which reads as false again
    sparse = [F.when(F.col(n), F.lit(True)).alias(n) for n in names]
    rows.select("input_text", "output_text", *sparse).write.json(path)
    return rd.read_labeled(spark, path).select("input_text", *names)


@query
def batch_job(spark, folder):
    """Two sources, one of them without a project, in one batch; the counts come from the write."""
    rows = to_conversations(raw_text_rows(spark, folder))
    even = F.pmod(F.xxhash64("request_id"), F.lit(2)) == 0
    sources = [rows.filter(even), rows.filter(~even).withColumn("project_name", F.lit(None).cast("string"))]
    table, export = shared_folder(spark, "table"), shared_folder(spark, "export")
    counts = audit_batch(sources, table, 7, cp.BATCH_TIME, export=export, project_name="batch")
    stored = rd.read_audit_table(spark, table).agg(
        F.count("*").alias("stored"), F.countDistinct("id").alias("ids"),
        F.count_if(F.col("project_name").isNull()).alias("no_project"),
    )
    exported = rd.read_exported(spark, export).agg(F.count("*").alias("exported"))
    return mt.beside(stored, exported).select(
        *[F.lit(counts[c]).cast("bigint").alias(c) for c in ("processed", "flagged")],
        "stored", "ids", "no_project", "exported",
    )


@query
def labeled_reject(spark, folder):
    """Labels of several spellings; every thirteenth line is cut off and set aside."""
    path = shared_folder(spark, "labeled")
    rows = cp.with_labels(cp.seeded_input(spark, folder), spark, folder)
    spelled = F.when(F.col("id") % 3 == 0, F.lit("1")).when(F.col("id") % 3 == 1, F.lit("true"))
    pii = F.when(F.col("label_pii"), spelled.otherwise(F.lit('"yes"'))).otherwise(F.lit("0"))
    line = F.concat(
        F.lit('{"input_text": '), F.get(F.split(F.to_json(F.array("input_text")), r"^\[|\]$"), F.lit(1)),
        F.lit(', "label_pii": '), pii, F.when(F.col("id") % 13 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    rows.select(line.alias("value")).write.text(path)
    kept, rejects = rd.split_labeled(spark, path)
    one = F.count("*").alias("count")
    good = kept.groupBy(F.col("label_pii").cast("string").alias("outcome")).agg(one)
    return good.union(rejects.groupBy(F.col("reject_reason").alias("outcome")).agg(one))


# --- streams ---------------------------------------------------------------------


def document_stream(spark, folder) -> DataFrame:
    path = f"{folder}/documents.parquet"
    documents = si.read_parquet_stream(spark, path, cp.DOCUMENTS_SCHEMA)
    return si.by_day(cp.seeded(documents))


def event_stream(spark, folder) -> DataFrame:
    path = f"{folder}/events.parquet"
    events = si.read_parquet_stream(spark, path, cp.EVENTS_SCHEMA, max_bytes=1 << 30)
    return cp.shape_requests(events)


@query
def stream_audit(spark, folder):
    path, state = shared_folder(spark, "stream"), shared_folder(spark, "state")
    si.append_stream(cp.audit_seeded(document_stream(spark, folder)), path, state).awaitTermination()
    rows = rd.read_audit_table(spark, path)
    return rows.select("id", "timestamp", digest("output_text"), "flagged", joined("risk_labels"))


def ingested(spark, folder) -> tuple[str, str, str, str]:
    source, table = shared_folder(spark, "source"), shared_folder(spark, "table")
    bad, state = shared_folder(spark, "bad"), shared_folder(spark, "state")
    rows = blanked(spark, folder).select("id", *rd.CONVERSATION_FIELDS)
    lines = rows.select("id", F.to_json(F.struct(*rd.CONVERSATION_FIELDS)).alias("value"))
    # every eleventh line is cut off
    cut = F.when(F.col("id") % 11 == 0, F.expr("left(value, length(value) - 2)"))
    lines.select(F.coalesce(cut, F.col("value")).alias("value")).write.text(source)
    stream = si.read_json_stream(spark, source, glob="part-*", quarantine=True)
    jobs, commits = shared_folder(spark, "jobs"), shared_folder(spark, "commits")
    si.ingest(stream, table, bad, state, jobs=jobs, commits=commits).awaitTermination()
    return table, bad, jobs, commits


@query
def stream_ingest(spark, folder):
    table, _, _, commits = ingested(spark, folder)
    rows = si.read_ingested(spark, table, commits)
    return rows.select("request_id", "input_text", digest("output_text"), joined("risk_labels"))


@query
def stream_quarantine(spark, folder):
    _, bad, _, commits = ingested(spark, folder)
    rows = si.read_rejected(spark, bad, commits)
    return rows.groupBy("reject_reason").agg(F.count("*").alias("count"))


@query
def ingest_jobs(spark, folder):
    """The last state of each ingested row's job."""
    _, _, jobs, commits = ingested(spark, folder)
    updates = si.read_jobs(spark, jobs, commits)
    last = updates.groupBy("job_id").agg(F.max_by(F.struct("status", "error"), "seq").alias("u"))
    return last.groupBy("u.status", "u.error").agg(F.count("*").alias("count"))


@query
def stream_quota(spark, folder):
    path, state = shared_folder(spark, "stream"), shared_folder(spark, "state")
    verdicts = quota_stream(event_stream(spark, folder), QUOTA_LIMIT, DAY_SECONDS)
    writer = verdicts.writeStream.format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", state).outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    return verdict_columns(spark.read.schema(verdicts.schema).parquet(path))


@query
def stream_daily(spark, folder):
    """Totals per day; the last update of a day is its final value."""
    path, state = shared_folder(spark, "stream"), shared_folder(spark, "state")
    totals = daily_totals(cp.audit_seeded(document_stream(spark, folder)))

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(
            f"{path}/n={number}"
        )

    writer = totals.writeStream.foreachBatch(save).option("checkpointLocation", state)
    writer.outputMode("update").trigger(availableNow=True).start().awaitTermination()
    schema = "day date, count bigint, flagged bigint, avg_toxicity double, batch int, n int"
    updates = spark.read.schema(schema).parquet(path)
    newest = updates.groupBy("day").agg(
        F.max(F.struct("batch", "count", "flagged", "avg_toxicity")).alias("u")
    )
    final = newest.select(day_text("day"), "u.count", "u.flagged", "u.avg_toxicity")
    return rounded(final, "avg_toxicity")


def drained(rows: DataFrame, state: str, mode: str) -> None:
    """Run a stream whose answer is its state."""
    writer = rows.writeStream.format("noop").option("checkpointLocation", state).outputMode(mode)
    writer.trigger(availableNow=True).start().awaitTermination()


@query
def stream_latency(spark, folder):
    state = shared_folder(spark, "state")
    drained(sl.stream_latencies(event_stream(spark, folder)), state, "update")
    return sl.read_latencies(spark, state)


def job_ledger(spark, folder, **options) -> DataFrame:
    """The ledger after a replay of all updates in three parts, from one checkpoint, in order of time."""
    state, source = shared_folder(spark, "state"), shared_folder(spark, "updates")
    updates = cp.job_updates(spark, folder)
    for low, high in (("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2025-01-01")):
        part = updates.filter((F.col("ts") >= F.lit(low).cast("timestamp")) & (F.col("ts") < F.lit(high).cast("timestamp")))
        part.write.mode("append").parquet(source)
        stream = si.read_parquet_stream(spark, source, updates.schema)
        drained(sj.stream_jobs(stream, **options), state, "update")
    return sj.read_ledger(spark, state)


@query
def stream_jobs(spark, folder):
    """Equal to ``job_latest``: no job ends long enough ago to be forgotten."""
    jobs = job_ledger(spark, folder, ttl_seconds=100 * DAY_SECONDS)
    times = ("submitted_at", "started_at", "finished_at", "updated_at")
    return jobs.select("job_id", "status", *[stamp(c) for c in times], "error")


@query
def stream_job_counts(spark, folder):
    """Jobs by status that are left of one pass, a day after they ended."""
    state = shared_folder(spark, "state")
    updates = cp.job_updates(spark, folder)
    path = shared_folder(spark, "updates")
    updates.write.parquet(path)
    stream = si.read_parquet_stream(spark, path, updates.schema)
    drained(sj.stream_jobs(stream, ttl_seconds=DAY_SECONDS), state, "update")
    return rq.job_status_counts(sj.read_ledger(spark, state))


@query
def stream_quota_live(spark, folder):
    """The clients whose windows are left after the log was replayed."""
    state = shared_folder(spark, "state")
    verdicts = quota_stream(event_stream(spark, folder), QUOTA_LIMIT, 3600, evict=True)
    drained(verdicts, state, "append")
    return live_windows(spark, state).select("identity", stamp("start"), "seen")


def running_totals(spark, folder) -> DataFrame:
    path, state = shared_folder(spark, "totals"), shared_folder(spark, "state")
    st.keep_totals(cp.audit_seeded(document_stream(spark, folder)), path, state).awaitTermination()
    return st.read_totals(spark, path)


@query
def stream_overview(spark, folder):
    row = st.running_overview(running_totals(spark, folder), cp.audited(spark, folder), cp.AS_OF)
    return rounded(
        row, "avg_toxicity", "refusal_rate", "self_harm_rate", "jailbreak_rate", "bias_rate",
        "pii_rate", "flagged_rate",
    )


@query
def stream_risk_counts(spark, folder):
    return st.running_counts(running_totals(spark, folder))
