"""Paged and top-k views. Order is newest first, ties broken by the larger id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions.risk import risk_reason, status_label, titles
from parapet.functions.text import filled
from parapet.lexicon import LOG_ROWS_MAX, PAGE_SIZE_MAX, PAGE_TITLES, REPORT_ROWS_MAX
from parapet.operators.filters import AuditFilter, equals


def newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.desc("id")]


def page(
    df: DataFrame, number: int = 1, size: int = 25, filters: AuditFilter | None = None,
    most: int = PAGE_SIZE_MAX,
) -> DataFrame:
    """One page of the listing; a top-(offset + size) selection per task, no full sort.

    Every task still keeps ``offset + size`` rows: use ``page_after`` for deep pages.
    To read whole rows of a large stored table, pass the page to ``late_rows``.
    """
    if number < 1 or not 1 <= size <= most:
        raise ValueError(f"page must be >= 1 and size within 1..{most}")
    rows = (filters or AuditFilter()).apply(df).orderBy(*newest_first())
    return rows.offset((number - 1) * size).limit(size)


def late_rows(df: DataFrame, chosen: DataFrame, most: int = REPORT_ROWS_MAX) -> DataFrame:
    """The full rows of a stored table for a selection of at most ``most`` of them.

    Choosing rows needs only narrow columns, so a first job finds ids and times; the
    second reads the wide text columns, but just for the days and times found: whole
    partitions, and row groups of the time-sorted files, are skipped. Rows match on id and
    time together, as an imported store may repeat ids; a missing time matches a missing one.
    """
    keys = chosen.select("id", "timestamp", "audit_date").limit(most + 1).collect()
    if len(keys) > most:
        raise ValueError(f"a selection holds at most {most} rows")
    if not keys:
        return df.limit(0)
    dated = sorted({k["audit_date"] for k in keys if k["audit_date"] is not None})
    days = F.col("audit_date").isin(dated)
    if any(k["audit_date"] is None for k in keys):
        days = days | F.col("audit_date").isNull()
    times = [k["timestamp"] for k in keys if k["timestamp"] is not None]
    span = F.col("timestamp").between(min(times), max(times)) if times else F.lit(False)
    if len(times) < len(keys):
        span = span | F.col("timestamp").isNull()
    pairs = df.sparkSession.createDataFrame(
        sorted({(k["id"], k["timestamp"]) for k in keys}, key=str), "_id bigint, _time string"
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("timestamp").eqNullSafe(F.col("_time"))
    near = df.filter(days & span)
    return near.join(F.broadcast(pairs), same, "left_semi").orderBy(*newest_first())


def page_after(
    df: DataFrame, timestamp: str, id_: int, size: int = 25, filters: AuditFilter | None = None,
    most: int = PAGE_SIZE_MAX,
) -> DataFrame:
    """The page behind the row ``(timestamp, id)``; costs the same at any depth."""
    if not 1 <= size <= most:
        raise ValueError(f"size must be within 1..{most}")
    behind = (F.col("timestamp") < timestamp) | (
        (F.col("timestamp") == timestamp) & (F.col("id") < id_)
    )
    rows = (filters or AuditFilter()).apply(df).filter(behind)
    return rows.orderBy(*newest_first()).limit(size)


def page_count(df: DataFrame, size: int, filters: AuditFilter | None = None) -> DataFrame:
    """Matching rows and the number of pages, at least one."""
    total = (filters or AuditFilter()).apply(df).agg(F.count("*").alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size))
    return total.withColumn("pages", pages.cast("bigint"))


def latest(
    df: DataFrame,
    limit: int = 100,
    flagged: bool | None = None,
    project_name: str | None = None,
    model_name: str | None = None,
    user_id: str | None = None,
    most: int = LOG_ROWS_MAX,
) -> DataFrame:
    """The newest rows; the limit is clamped to 1..``most``, by default as the log view does."""
    rows = AuditFilter(
        flagged=flagged, project_name=project_name, model_name=model_name, user_id=user_id
    ).apply(df)
    return rows.orderBy(*newest_first()).limit(min(max(limit, 1), most))


def by_id(df: DataFrame, id_: int) -> DataFrame:
    return df.filter(equals("id", id_))


def flagged_of_page(page_rows: DataFrame, limit: int = 10) -> DataFrame:
    """The page's newest flagged rows in display form."""
    rows = page_rows.filter("flagged").orderBy(*newest_first()).limit(limit)
    return rows.select(
        "id",
        filled(F.col("timestamp"), "-").alias("timestamp"),
        filled(F.col("project_name"), "-").alias("project"),
        titles(F.col("risk_labels"), PAGE_TITLES).alias("labels"),
        filled(F.get("risk_explanations", F.lit(0)), "No explanation provided").alias(
            "explanation"
        ),
    )


# The dashboard table, in its column order.
DISPLAY_COLUMNS = [
    "timestamp",
    "project_name",
    "model_name",
    "user_id",
    "input_text",
    "output_text",
    "toxicity_score",
    "has_pii",
    "is_refusal",
    "self_harm",
    "jailbreak",
    "bias",
    "sentiment_score",
    "flagged",
    "risk_reason",
]


def display_rows(df: DataFrame) -> DataFrame:
    """The 15 dashboard columns."""
    return df.withColumn("risk_reason", risk_reason(F.col("risk_labels"))).select(*DISPLAY_COLUMNS)


def record_details(df: DataFrame) -> DataFrame:
    """Display fields of single records, ``N/A`` for missing ones."""
    shown = {
        name: filled(F.col(name), "N/A")
        for name in ("project_name", "model_name", "user_id", "request_id")
    }
    return df.select(
        "id",
        *[c.alias(n) for n, c in shown.items()],
        filled(F.array_join("tags", ", "), "N/A").alias("tags"),
        risk_reason(F.col("risk_labels")).alias("risk_reason"),
        status_label(F.col("flagged")).alias("status"),
        "risk_explanations",
        F.when(
            F.col("redaction_applied"),
            F.format_string("applied (%d match(es))", F.col("redaction_count")),
        ).alias("redaction_note"),
        "input_text",
        "output_text",
    )


def option_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-empty values of one column (array items for arrays)."""
    kind = dict(df.dtypes)[column]
    value = F.explode(column) if kind.startswith("array") else F.col(column)
    values = df.select(value.alias("value"))
    return values.filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct().orderBy(
        "value"
    )
