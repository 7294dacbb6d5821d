"""Newest latencies of each path over a stream: a bounded list per key in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parapet.lexicon import LATENCY_SAMPLE
from parapet.operators.requests import latency_percentiles_by
from parapet.streaming.state import keep_in_rocksdb, state_rows

# Lists that the requests of one path are dealt out to, so that a busy path is no single task.
SALTS = 8
_NO_TIME = -(1 << 62)


class _Newest(StatefulProcessor):
    def __init__(self, sample: int):
        self._sample = sample

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getListState("newest", "us bigint, seq bigint, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["us", "seq", "value"]
        newest = pd.DataFrame(list(self._held.get()), columns=names)
        for batch in rows:  # at most a batch and the list are in memory
            both = pd.concat([newest, batch[names]]) if len(newest) else batch[names]
            order = np.lexsort((both["seq"].to_numpy(np.int64), both["us"].to_numpy(np.int64)))
            newest = both.iloc[order[-self._sample :]]
        values = [None if pd.isna(v) else float(v) for v in newest["value"]]
        self._held.put(list(zip(newest["us"].astype(int).tolist(), newest["seq"].astype(int).tolist(), values)))
        yield pd.DataFrame({"path": [key[0]], "salt": [key[1]], "held": [len(newest)]})

    def close(self) -> None:
        pass


def stream_latencies(log: DataFrame, sample: int = LATENCY_SAMPLE, salts: int = SALTS) -> DataFrame:
    """Keep the newest ``sample`` latencies of each path of ``(path, ts, event_id, latency_ms)``.

    The rows of a path are dealt out to ``salts`` lists; each holds its newest ones, so together they hold the
    newest of the path. Rows without a time are older than others. Gives one row for each list touched,
    with the number it holds; ``read_latencies`` answers from the lists themselves.
    """
    keep_in_rocksdb(log.sparkSession)
    time = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(_NO_TIME))
    keyed = log.select(
        F.coalesce("path", F.lit("")).alias("path"), F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int").alias("salt"),
        time.alias("us"), F.col("event_id").cast("bigint").alias("seq"), F.col("latency_ms").cast("double").alias("value"),
    )
    return keyed.groupBy("path", "salt").transformWithStateInPandas(
        _Newest(sample), outputStructType="path string, salt int, held int", outputMode="Update", timeMode="None"
    )


def read_latencies(spark: SparkSession, checkpoint: str, sample: int = LATENCY_SAMPLE) -> DataFrame:
    """Percentiles by path from the state that ``stream_latencies`` keeps under ``checkpoint``."""
    held = state_rows(spark, checkpoint, "newest")
    log = held.select("key.path", "list_element.us", "list_element.seq", "list_element.value")
    return latency_percentiles_by(log, sample=sample, time="us", order="seq", value="value")
