"""Running metrics over a stream: mergeable partial totals, written batch by batch and merged when read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parapet.operators.filters import present
from parapet.operators.metrics import recent_cutoff

_FLAGS = ("is_refusal", "self_harm", "jailbreak", "bias", "has_pii")
_SUMS = ["rows", "flagged", "scored", "score", *_FLAGS, *[f"{f}_known" for f in _FLAGS]]
SCHEMA = (
    "audit_date date, hour string, label string, rows bigint, flagged bigint, scored bigint, score double, "
    + ", ".join(f"{f} bigint, {f}_known bigint" for f in _FLAGS)
    + ", latest string, batch_id bigint"
)


def partial_totals(audited: DataFrame) -> DataFrame:
    """Counts and sums by day, hour and label: a row with a null label for all rows of the hour.

    Rows multiply by their labels in the task only; one aggregate combines them before the shuffle.
    The hour is the first 13 letters of the stored time, so that a cutoff compares as on the table.
    """
    all_and_each = F.concat(F.array(F.lit(None).cast("string")), F.filter(F.coalesce("risk_labels", F.array()), lambda v: v != ""))
    rows = audited.select(
        "audit_date", F.left("timestamp", F.lit(13)).alias("hour"), "timestamp", "flagged", "toxicity_score", *_FLAGS,
        F.explode(all_and_each).alias("label"),
    )
    own = F.col("label").isNull()
    sums = {"rows": F.count("*"), "flagged": F.count_if(own & F.col("flagged"))}
    sums["scored"] = F.count_if(own & F.col("toxicity_score").isNotNull())
    sums["score"] = F.coalesce(F.sum(F.when(own, F.col("toxicity_score"))), F.lit(0.0))
    for flag in _FLAGS:
        sums[flag] = F.count_if(own & F.col(flag))
        sums[f"{flag}_known"] = F.count_if(own & F.col(flag).isNotNull())
    sums["latest"] = F.max(F.when(own, F.col("timestamp")))
    return rows.groupBy("audit_date", "hour", "label").agg(*[value.alias(name) for name, value in sums.items()])


def add_totals(audited: DataFrame, path: str, batch: int) -> None:
    """Write the totals of one micro-batch; a batch that is repeated replaces its own."""
    partial_totals(audited).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch}"))


def keep_totals(audited: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follow an audited stream with ``add_totals``."""
    writer = audited.writeStream.foreachBatch(lambda batch, number: add_totals(batch, path, number))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of all batches, merged: one row for each day, hour and label."""
    parts = spark.read.schema(SCHEMA).parquet(path)
    sums = [F.sum(name).alias(name) for name in _SUMS]
    return parts.groupBy("audit_date", "hour", "label").agg(*sums, F.max("latest").alias("latest"))


def compact_totals(spark: SparkSession, source: str, target: str) -> None:
    """The totals of a stopped stream as one batch of a new folder, numbered as the last one was.

    A stream that goes on from its checkpoint then writes to ``target``: its next batch has a new number, and a
    repeat of the last batch would have to be of the same rows, so the last batch stays by itself.
    """
    parts = spark.read.schema(SCHEMA).parquet(source)
    last = parts.agg(F.max("batch_id")).first()[0]
    if last is None:
        return
    names = [f.split()[0] for f in SCHEMA.split(", ")][:-1]
    before = parts.filter(F.col("batch_id") < last).groupBy("audit_date", "hour", "label").agg(
        *[F.sum(name).alias(name) for name in _SUMS], F.max("latest").alias("latest")
    )
    # below all batch numbers of a stream
    before.select(*names).coalesce(1).write.mode("errorifexists").parquet(os.path.join(target, "batch_id=-1"))
    own = parts.filter(F.col("batch_id") == last).select(*names)
    own.coalesce(1).write.mode("errorifexists").parquet(os.path.join(target, f"batch_id={last}"))


def running_overview(totals: DataFrame, table: DataFrame, as_of: str) -> DataFrame:
    """``metrics.overview`` from the totals; one row, zeros for none.

    Rows of the last 24 hours are whole hours of the totals, but for the hour that the cutoff falls into: its rows
    are counted in ``table``, the stored rows, of which only that hour's are read.
    """
    cutoff = recent_cutoff(as_of)
    hour = cutoff[:13]
    own = totals.filter(F.col("label").isNull()).select(*_SUMS, "hour", "latest")
    inside = table.filter(F.col("timestamp").startswith(hour) & (F.col("timestamp") >= cutoff))
    none = F.lit(None).cast("string")
    zeros = [F.lit(0).cast("double" if n == "score" else "bigint").alias(n) for n in _SUMS]
    edge = inside.select(*zeros, none.alias("hour"), none.alias("latest"))
    later = F.when(F.col("hour") > hour, F.col("rows")).when(F.col("hour").isNull(), F.lit(1)).otherwise(F.lit(0))
    whole = own.union(edge).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _SUMS], F.max("latest").alias("latest_timestamp"),
        F.coalesce(F.sum(later), F.lit(0)).cast("bigint").alias("recent_24h"),
    )

    def rate(part: str, all_: str):
        return F.coalesce(F.try_divide(F.col(part), F.col(all_)), F.lit(0.0))

    names = dict(zip(("refusal_rate", "self_harm_rate", "jailbreak_rate", "bias_rate", "pii_rate"), _FLAGS))
    return whole.select(
        F.col("rows").alias("total"), "flagged", rate("score", "scored").alias("avg_toxicity"),
        *[rate(flag, f"{flag}_known").alias(name) for name, flag in names.items()],
        "latest_timestamp", "recent_24h", rate("flagged", "rows").alias("flagged_rate"),
    )


def running_counts(totals: DataFrame) -> DataFrame:
    """``metrics.label_counts`` from the totals."""
    own = totals.filter(present("label"))
    return own.groupBy("label").agg(F.sum("rows").alias("count"))


def running_daily(totals: DataFrame) -> DataFrame:
    """Rows, flagged rows and mean toxicity by day, as ``volume.daily_totals`` has them."""
    own = totals.filter(F.col("label").isNull() & F.col("audit_date").isNotNull())
    days = own.groupBy(F.col("audit_date").alias("day")).agg(*[F.sum(n).alias(n) for n in ("rows", "flagged", "scored", "score")])
    return days.select("day", F.col("rows").alias("count"), "flagged", F.try_divide("score", "scored").alias("avg_toxicity"))
