"""Running totals over an audited stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(audited: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Rows, flagged rows and mean toxicity per calendar day.

    The watermark bounds the state: a day is final once the stream is that far past
    its end. Rows without a parseable time belong to no day.
    """
    dated = audited.filter(F.col("ts").isNotNull()).withWatermark("ts", watermark)
    return (
        dated.groupBy(F.window("ts", "1 day"))
        .agg(
            F.count("*").alias("count"),
            F.count_if("flagged").alias("flagged"),
            F.avg("toxicity_score").alias("avg_toxicity"),
        )
        .select(F.to_date("window.start").alias("day"), "count", "flagged", "avg_toxicity")
    )
