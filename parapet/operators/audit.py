"""The audit transform: detect, label, explain, redact. One narrow plan, no shuffle.

Expensive text scans sit in projections of their own, so that Catalyst keeps one
evaluation of each and later steps only read small columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions import detectors as d
from parapet.functions import risk
from parapet.functions.scoring import Scorer, guarded, no_score
from parapet.functions.text import filled
from parapet.lexicon import TOXICITY_THRESHOLD
from parapet.schemas import AUDIT_COLUMNS


def detect(
    df: DataFrame,
    text: str = "output_text",
    toxicity: Scorer = no_score,
    sentiment: Scorer = no_score,
) -> DataFrame:
    """Add every signal with its evidence to ``df``."""
    source = F.col(text)
    scored = df.withColumns(
        {
            "_lowered": F.lower(source),
            "_emails": d.emails(source),
            "_phones": d.phones(source),
            "toxicity_score": guarded(toxicity, source),
            "sentiment_score": guarded(sentiment, source),
        }
    )
    lowered = F.col("_lowered")
    matched = scored.withColumn("_descriptor", d.bias_descriptor(lowered)).withColumns(
        {
            "refusal_phrase": d.refusal_phrase(lowered),
            "self_harm_match": d.self_harm_match(lowered),
            "jailbreak_phrase": d.jailbreak_phrase(lowered),
            "bias_match": d.bias_match(lowered, F.col("_descriptor")),
            "pii_data": d.pii_data(F.col("_emails"), F.col("_phones")),
            "pii_types": d.pii_types(F.col("_emails"), F.col("_phones")),
        }
    )
    return matched.withColumns(
        {
            "has_pii": F.size("pii_types") > 0,
            "is_refusal": F.col("refusal_phrase").isNotNull(),
            "self_harm": F.col("self_harm_match").isNotNull(),
            "jailbreak": F.col("jailbreak_phrase").isNotNull(),
            "bias": F.col("bias_match").isNotNull(),
        }
    ).drop("_lowered", "_descriptor")


def label(df: DataFrame, threshold: float = TOXICITY_THRESHOLD) -> DataFrame:
    """Add ``risk_labels``, ``risk_explanations`` and ``flagged`` to a detected frame.

    The verdict comes out of a one-row generator. Catalyst would otherwise copy the whole
    detector expression into a filter on the verdict, far below, and run every text
    scan once more; filters on the input columns still pass through to the scan.
    """
    toxic = risk.is_toxic(F.col("toxicity_score"), threshold)
    labels = risk.label_array(
        {
            "toxicity": toxic,
            "pii": F.col("has_pii"),
            "self_harm": F.col("self_harm"),
            "jailbreak": F.col("jailbreak"),
            "bias": F.col("bias"),
            "refusal": F.col("is_refusal"),
        }
    )
    explained = risk.explanation_array(
        F.col("toxicity_score"),
        threshold,
        toxic,
        F.col("pii_types"),
        F.col("refusal_phrase"),
        F.col("self_harm_match"),
        F.col("jailbreak_phrase"),
        F.col("bias_match"),
    )
    judged = df.withColumns({"_labels": labels, "_reasons": explained})
    verdict = F.struct(
        F.col("_labels").alias("risk_labels"),
        F.col("_reasons").alias("risk_explanations"),
        risk.is_flagged(F.col("_labels")).alias("flagged"),
    )
    return judged.select(*df.columns, F.inline_outer(F.array(verdict)))


def evaluate(
    df: DataFrame,
    text: str = "output_text",
    toxicity: Scorer = no_score,
    sentiment: Scorer = no_score,
    threshold: float = TOXICITY_THRESHOLD,
) -> DataFrame:
    """Signals, labels, explanations and verdict, without redaction."""
    return label(detect(df, text, toxicity, sentiment), threshold).drop("_emails", "_phones")


def redact(df: DataFrame, text: str = "output_text") -> DataFrame:
    """Replace personal data in ``text``; add ``redaction_count``/``redaction_applied``."""
    found = df
    if "_emails" not in df.columns:
        found = df.withColumns({"_emails": d.emails(F.col(text)), "_phones": d.phones(F.col(text))})
    emails, phones = F.col("_emails"), F.col("_phones")
    stripped = found.withColumn("_no_emails", d.without_emails(F.col(text), emails))
    counted = stripped.withColumn(
        "_phone_count", d.redacted_phone_count(F.col("_no_emails"), emails, phones)
    )
    return counted.withColumns(
        {
            text: d.without_phones(F.col("_no_emails"), F.col("_phone_count")),
            "redaction_count": F.coalesce(F.size(emails) + F.col("_phone_count"), F.lit(0)).cast(
                "int"
            ),
        }
    ).withColumn("redaction_applied", F.col("redaction_count") > 0).drop(
        "_emails", "_phones", "_no_emails", "_phone_count"
    )


def audit(
    df: DataFrame,
    toxicity: Scorer = no_score,
    sentiment: Scorer = no_score,
    threshold: float = TOXICITY_THRESHOLD,
    redact_pii: bool = True,
    batch_time: Column | str | None = None,
) -> DataFrame:
    """Conversation rows to rows of the audit table; without an ``id`` that is null.

    ``batch_time`` is the timestamp text for rows that have none; a batch should
    pass a literal so that a retried task writes the same value.
    """
    if "_corrupt_record" in df.columns:
        raise ValueError("set malformed rows aside first (see split_valid)")
    if "id" not in df.columns:
        df = df.withColumn("id", F.lit(None).cast("bigint"))
    detected = label(detect(df, "output_text", toxicity, sentiment), threshold)
    if redact_pii:
        stored = redact(detected)
    else:
        stored = detected.withColumns(
            {"redaction_count": F.lit(0), "redaction_applied": F.lit(False)}
        )
    if batch_time is None:
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    else:
        now = batch_time if isinstance(batch_time, Column) else F.lit(batch_time)
    return with_time(
        stored.withColumn("timestamp", filled(F.col("timestamp"), now)).select(*AUDIT_COLUMNS)
    )


def with_time(df: DataFrame) -> DataFrame:
    """Add the parsed ``ts`` (null when unparseable) and its ``audit_date``."""
    return df.withColumn("ts", F.try_to_timestamp("timestamp")).withColumn(
        "audit_date", F.to_date("ts")
    )


def batch_summary(df: DataFrame) -> DataFrame:
    """How many rows were processed and how many are flagged."""
    return df.agg(
        F.count("*").alias("processed"),
        F.count_if("flagged").alias("flagged"),
    )


def result_view(df: DataFrame) -> DataFrame:
    """The 14 result fields of an audited row."""
    return df.select(
        F.col("id").alias("record_id"),
        "flagged",
        "risk_labels",
        "risk_explanations",
        "toxicity_score",
        "has_pii",
        "pii_types",
        "is_refusal",
        "self_harm",
        "jailbreak",
        "bias",
        "sentiment_score",
        "redaction_applied",
        "redaction_count",
    )
