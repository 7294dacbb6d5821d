"""Aggregates over the audit table.

All of them combine per task before the shuffle, so a hot project, label or day shrinks to
one row per task. Maxima of text columns plan as sort aggregates, the others as hash ones.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions.risk import status_label
from parapet.functions.text import fixed
from parapet.lexicon import HISTOGRAM_BINS
from parapet.operators.filters import present


def _overall():
    """Single-task window; only ever used over one row per label."""
    return Window.partitionBy(F.lit(0))


def _rate(flag: str) -> Column:
    return F.coalesce(F.avg(F.col(flag).cast("int")), F.lit(0.0))


def recent_cutoff(as_of: str, hours: int = 24) -> str:
    """The text cutoff ``hours`` before an ISO time."""
    return (datetime.fromisoformat(as_of) - timedelta(hours=hours)).isoformat()


def recent_count(as_of: str, hours: int = 24) -> Column:
    """Aggregate: rows whose timestamp text is at or after the cutoff."""
    return F.count_if(F.col("timestamp") >= recent_cutoff(as_of, hours))


def overview(df: DataFrame, as_of: str) -> DataFrame:
    """One row of totals and rates; zeros (and a null latest time) for an empty table."""
    return df.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.col("flagged").cast("bigint")), F.lit(0)).alias("flagged"),
        F.coalesce(F.avg("toxicity_score"), F.lit(0.0)).alias("avg_toxicity"),
        _rate("is_refusal").alias("refusal_rate"),
        _rate("self_harm").alias("self_harm_rate"),
        _rate("jailbreak").alias("jailbreak_rate"),
        _rate("bias").alias("bias_rate"),
        _rate("has_pii").alias("pii_rate"),
        F.max("timestamp").alias("latest_timestamp"),
        recent_count(as_of).alias("recent_24h"),
    ).withColumn(
        "flagged_rate",
        F.coalesce(F.try_divide(F.col("flagged"), F.col("total")), F.lit(0.0)),
    )


def label_counts(df: DataFrame, column: str = "risk_labels", name: str = "label") -> DataFrame:
    """How often each non-empty array item occurs."""
    items = df.select(F.explode(column).alias(name)).filter(present(name))
    return items.groupBy(name).agg(F.count("*").alias("count"))


def metrics_document(df: DataFrame, as_of: str) -> DataFrame:
    """The overview with the label counts as one map column.

    Labels come from a fixed list, so the map stays small.
    """
    numbers = overview(df, as_of)
    entries = F.sort_array(F.collect_list(F.struct("label", "count")))
    counts = label_counts(df).agg(F.map_from_entries(entries).alias("risk_counts"))
    return beside(numbers, counts)


def beside(*rows: DataFrame) -> DataFrame:
    """One-row frames side by side, by union and aggregate instead of a cross join."""
    packed = [r.select(F.struct(*r.columns).alias(f"p{i}")) for i, r in enumerate(rows)]
    merged = packed[0]
    for other in packed[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    names = merged.columns
    single = merged.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    return single.select(*[f"{n}.*" for n in names])


_META_FIELDS = {"projects": "project_name", "models": "model_name", "users": "user_id"}


def meta_values(df: DataFrame) -> DataFrame:
    """Every distinct project, model, user, tag and label as ``(field, value)`` rows.

    One scan. The long form keeps working when users or tags run into the billions,
    where one array of them would not fit a row.
    """

    def tagged(field: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), value.alias("value"))

    def items(name: str) -> Column:
        return F.transform(F.array_distinct(name), lambda value: tagged(name, value))

    scalars = F.array(*[tagged(f, F.col(c)) for f, c in _META_FIELDS.items()])
    lists = [items("tags"), items("risk_labels")]
    cells = df.select(F.inline(F.concat(scalars, *lists)))
    # blank names are no choice, but the lists keep whatever they hold
    kept = F.col("value").isNotNull() & (
        (F.col("value") != "") | F.col("field").isin("tags", "risk_labels")
    )
    return cells.filter(kept).distinct()


def meta_document(df: DataFrame) -> DataFrame:
    """The distinct values as one row of sorted arrays.

    One row has to hold them all; ``meta_values`` is the form for very many values.
    """
    fields = [*_META_FIELDS, "tags", "risk_labels"]
    return meta_values(df).agg(
        *[
            F.sort_array(F.collect_set(F.when(F.col("field") == f, F.col("value")))).alias(f)
            for f in fields
        ]
    )


def kpis(df: DataFrame) -> DataFrame:
    """Dashboard headline numbers with their display forms."""
    refusals = F.avg(F.col("is_refusal").cast("int")) * 100
    self_harm = F.avg(F.col("self_harm").cast("int")) * 100
    return df.agg(
        F.count("*").alias("total_audited"),
        F.count_if("flagged").alias("flagged_risks"),
        refusals.alias("refusal_rate"),
        self_harm.alias("self_harm_rate"),
        F.avg("toxicity_score").alias("avg_toxicity"),
    ).withColumns(
        {
            "refusal_rate": F.concat(fixed(F.col("refusal_rate"), 1), F.lit("%")),
            "self_harm_rate": F.concat(fixed(F.col("self_harm_rate"), 1), F.lit("%")),
            "avg_toxicity": fixed(F.col("avg_toxicity"), 3),
        }
    )


def shown_of_total(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows passing the filter and rows in all, in one pass."""
    return df.agg(F.count_if(predicate).alias("shown"), F.count("*").alias("total"))


def toxicity_histogram(df: DataFrame) -> DataFrame:
    """Five right-closed bins; empty bins stay, out-of-range scores do not count."""
    score = F.col("toxicity_score")
    counts = []
    for i, (_, low, high) in enumerate(HISTOGRAM_BINS):
        above = score >= low if i == 0 else score > low
        counts.append(F.count_if(above & (score <= high)).alias(f"b{i}"))
    cells = ", ".join(f"{i}, '{name}', b{i}" for i, (name, _, _) in enumerate(HISTOGRAM_BINS))
    return df.agg(*counts).selectExpr(
        f"stack({len(HISTOGRAM_BINS)}, {cells}) as (bin, toxicity_bin, count)"
    )


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(status_label(F.col("flagged")).alias("status")).agg(
        F.count("*").alias("count")
    )


def signal_breakdown(df: DataFrame) -> DataFrame:
    """Label counts with their share of all label hits, in percent."""
    share = F.col("count") / F.sum("count").over(_overall()) * 100
    return (
        label_counts(df, name="signal")
        .withColumn("percent", F.rint(share * 10) / 10)
        .orderBy(F.desc("count"), "signal")
    )


def label_bars(df: DataFrame) -> DataFrame:
    """Bar width per label: share of the largest count in percent, at least 8."""
    share = F.col("count") / F.max("count").over(_overall()) * 100
    return label_counts(df).withColumn(
        "width", F.greatest(F.lit(8), F.floor(share + 0.5)).cast("int")
    )


def daily_volume(df: DataFrame) -> DataFrame:
    """Rows per calendar day, with zeros between the first and the last day.

    Grouping by ``audit_date``, the table's partition column, reads no row data but the
    day itself. The gaps are filled from the counted days, one row each.
    """
    counted = (
        df.filter(F.col("audit_date").isNotNull())
        .groupBy(F.col("audit_date").alias("first"))
        .agg(F.count("*").alias("rows"))
    )
    following = F.lead("first").over(_overall().orderBy("first"))
    gaps = counted.withColumn("last", F.coalesce(F.date_sub(following, 1), "first"))
    days = gaps.select("first", "rows", F.explode(F.sequence("first", "last")).alias("day"))
    return days.select(
        "day", F.when(F.col("day") == F.col("first"), F.col("rows")).otherwise(0).alias("count")
    )
