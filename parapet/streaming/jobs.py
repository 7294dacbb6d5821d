"""A live ledger of jobs: ten values a job, dropped some time after it has finished."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parapet.lexicon import JOB_TTL_SECONDS
from parapet.streaming.state import keep_in_rocksdb, state_rows

# The latest update, and the latest of each kind, as (time, sequence number); null for none.
_STATE = (
    "job_id string, status string, us bigint, seq bigint, error string, queued_us bigint, queued_seq bigint,"
    " started_us bigint, started_seq bigint, finished_us bigint, finished_seq bigint"
)
_TIMES = ("submitted_at", "started_at", "finished_at", "updated_at")
#: Times in microseconds.
_OUTPUT = f"job_id string, status string, {', '.join(f'{name} bigint' for name in _TIMES)}, error string, live boolean"
#: Lists that the jobs are dealt out to by a hash. Each call into Python has its price, so jobs share them.
BUCKETS = 1024
#: Where the state holds the latest update of a kind.
_PLACES = {"queued": 4, "processing": 6, "completed": 8, "failed": 8}


def _after(kind: tuple, queued: tuple) -> bool:
    return kind[0] is not None and queued[0] is not None and kind > queued


def _deadline(job: tuple, ttl_ms: int) -> int | None:
    """When the job may go, in milliseconds: some time after its end, or after updates of a job that never began."""
    queued, finished = job[4:6], job[8:10]
    if queued[0] is None:
        return job[1] // 1000 + 1 + ttl_ms
    return finished[0] // 1000 + 1 + ttl_ms if _after(finished, queued) else None


def _updated(job: tuple, status: str, us: int, seq: int, error: str | None) -> tuple:
    at = us, seq
    if job[1] is None or at > job[1:3]:
        job = (status, *at, error, *job[4:])
    place = _PLACES.get(status)
    if place and (job[place] is None or at > job[place : place + 2]):
        job = (*job[:place], *at, *job[place + 2 :])
    return job


class _Ledger(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._jobs = handle.getListState("jobs", _STATE)

    def _held(self, watermark: int) -> tuple[dict[str, tuple], dict[str, tuple]]:
        """The jobs of the list, and those of them that are due by now."""
        held = {name: tuple(job) for name, *job in self._jobs.get()}
        ends = {name: _deadline(job, self._ttl_ms) for name, job in held.items()}
        due = {name: held.pop(name) for name, end in ends.items() if end is not None and end <= watermark}
        return held, due

    def _hold(self, jobs: dict[str, tuple]) -> None:
        if jobs:
            self._jobs.put([(name, *job) for name, job in jobs.items()])
        else:
            self._jobs.clear()
        # One timer is enough: it looks for the next end when it fires.
        ends = [end for job in jobs.values() if (end := _deadline(job, self._ttl_ms)) is not None]
        if ends:
            self._handle.registerTimer(min(ends))

    def _told(self, jobs: dict[str, tuple], live: bool) -> Iterator[pd.DataFrame]:
        rows = []
        for name, job in jobs.items():
            queued, started, finished = job[4:6], job[6:8], job[8:10]
            if queued[0] is not None:
                later = (kind[0] if _after(kind, queued) else None for kind in (started, finished))
                rows.append((name, job[0], queued[0], *later, job[1], job[3], live))
        if rows:
            found = pd.DataFrame(rows, columns=["job_id", "status", *_TIMES, "error", "live"], dtype=object)
            yield found.astype(dict.fromkeys(_TIMES, "Int64") | {"live": bool})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # the timers of this micro-batch fire only behind its rows
        jobs, due = self._held(timerValues.getCurrentWatermarkInMs())
        yield from self._told(due, False)
        touched = set()
        for batch in rows:
            error = batch["error"].astype(object).where(batch["error"].notna(), None)
            for name, *update in zip(batch["job_id"], batch["status"], batch["us"].tolist(), batch["seq"].tolist(), error):
                jobs[name] = _updated(jobs.get(name, (None,) * 10), *update)
                touched.add(name)
        self._hold(jobs)
        yield from self._told({name: jobs[name] for name in touched}, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # jobs that were taken up again since have another end, or none
        jobs, due = self._held(timerValues.getCurrentWatermarkInMs())
        self._hold(jobs)
        yield from self._told(due, False)

    def close(self) -> None:
        pass


def stream_jobs(
    updates: DataFrame, ttl_seconds: int = JOB_TTL_SECONDS, late: str = "1 minute", buckets: int = BUCKETS
) -> DataFrame:
    """Follow jobs over a stream of updates ``(job_id, status, ts, seq, error)``, as ``latest_jobs`` does.

    Each micro-batch gives the present state of the jobs it touches. A job is forgotten ``ttl_seconds`` after its
    end in event time, and told once more with ``live`` false; so are updates of jobs that never were queued, in
    silence. Only the time of the updates counts, so a replay forgets what live traffic would. Updates
    more than ``late`` behind the newest may be dropped; those without a time, status or job are.
    The state is ``buckets`` lists of jobs, and a micro-batch rewrites the lists it touches; a checkpoint keeps its number.
    """
    keep_in_rocksdb(updates.sparkSession)
    timed = updates.select(
        F.col("job_id").cast("string").alias("job_id"), "status", F.col("ts").cast("timestamp").alias("ts"),
        F.col("seq").cast("bigint").alias("seq"), F.col("error").cast("string").alias("error"),
    ).dropna(subset=["job_id", "status", "ts", "seq"])
    keyed = timed.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
    told = keyed.groupBy("bucket").transformWithStateInPandas(
        _Ledger(ttl_seconds * 1000), outputStructType=_OUTPUT, outputMode="Update", timeMode="EventTime"
    )
    return told.withColumns({name: F.timestamp_micros(name) for name in _TIMES})


def read_ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The jobs that ``stream_jobs`` now knows, from its state, with the columns of ``latest_jobs``."""
    jobs = state_rows(spark, checkpoint, "jobs").select("list_element.*")
    queued = F.struct("queued_us", "queued_seq")

    def moment(us: Column) -> Column:
        return F.timestamp_micros(us)

    def later(kind: str) -> Column:
        us = F.col(f"{kind}_us")
        return F.when(us.isNotNull() & (F.struct(us, f"{kind}_seq") > queued), moment(us))

    return jobs.filter(F.col("queued_us").isNotNull()).select(
        "job_id", "status", moment(F.col("queued_us")).alias("submitted_at"), later("started").alias("started_at"),
        later("finished").alias("finished_at"), moment(F.col("us")).alias("updated_at"), "error",
    )


def look_up(spark: SparkSession, checkpoint: str, job_id: str) -> DataFrame:
    """One job's state; no row if it is unknown or forgotten."""
    return read_ledger(spark, checkpoint).filter(F.col("job_id") == job_id)
