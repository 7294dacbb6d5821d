"""What the stateful streams share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parapet.session import ROCKSDB


def keep_in_rocksdb(spark: SparkSession) -> None:
    """State with several variables or timers is kept by this provider only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def state_rows(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The rows of a state variable as of the last micro-batch, read in parallel from its store."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()


def registered_timers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(key, expiration_timestamp_ms)`` of timers that are still to fire."""
    return spark.read.format("statestore").option("path", checkpoint).option("readRegisteredTimers", True).load()
