"""Request-log operators: identity, counters, latency, job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.functions.text import fixed, strip
from parapet.lexicon import (
    EXEMPT_PATHS,
    EXEMPT_PREFIXES,
    JOB_STATUSES,
    JOB_TTL_SECONDS,
    LATENCY_SAMPLE,
    SPACE_CLASS,
)
from parapet.operators.metrics import beside
from parapet.session import cut_lineage


def client_identity(
    api_key: Column, authorization: Column, forwarded_for: Column, client_ip: Column
) -> Column:
    """Pseudonym of the caller: 16 hex digits of the SHA-256 of key or address.

    The key is the API-key header, else a two-part ``Bearer`` authorization; the
    address is the first forwarded one, else the peer's.
    """
    words = F.split(strip(authorization), f"[{SPACE_CLASS}]+")
    bearer = F.when((F.size(words) == 2) & (F.lower(words[0]) == "bearer"), words[1])
    # a header counts as sent when it is not empty, even if only spaces remain of it
    sent = F.when(api_key != "", strip(api_key)).otherwise(bearer)
    key = F.nullif(sent, F.lit(""))
    first_hop = F.when(forwarded_for != "", strip(F.split(forwarded_for, ",")[0]))
    address = F.coalesce(first_hop, client_ip, F.lit("unknown"))
    raw = F.coalesce(F.concat(F.lit("key:"), key), F.concat(F.lit("ip:"), address))
    return F.substring(F.sha2(raw.cast("binary"), 256), 1, 16)


def is_exempt(path: Column) -> Column:
    """Paths the quota does not apply to."""
    exempt = path.isin(EXEMPT_PATHS)
    for prefix in EXEMPT_PREFIXES:
        exempt = exempt | path.startswith(prefix)
    return F.coalesce(exempt, F.lit(False))


def request_totals(log: DataFrame) -> DataFrame:
    """Requests, server errors and their rate."""
    return log.agg(
        F.count("*").alias("request_count"), F.count_if(F.col("status_code") >= 500).alias(
            "error_count"
        )
    ).withColumn(
        "error_rate",
        F.coalesce(F.try_divide(F.col("error_count"), F.col("request_count")), F.lit(0.0)),
    )


def status_code_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.col("status_code").cast("string").alias("status_code")).agg(
        F.count("*").alias("count")
    )


def latency_percentiles(
    log: DataFrame,
    ratios: dict[str, float] | None = None,
    sample: int = LATENCY_SAMPLE,
    time: str = "ts",
    order: str = "event_id",
    value: str = "latency_ms",
) -> DataFrame:
    """Nearest-rank percentiles of the newest ``sample`` requests; 0 for none.

    The sample is a per-task top-k, so only ``sample`` rows ever meet in one task.
    The rank is ``(n - 1) * ratio`` rounded half to even.
    """
    newest = log.orderBy(F.desc(time), F.desc(order)).limit(sample).select(value)
    return _picked(newest.agg(F.sort_array(F.collect_list(value)).alias("v")), ratios, [])


def _picked(ranked: DataFrame, ratios: dict[str, float] | None, keys: list[str]) -> DataFrame:
    ratios = ratios or {"latency_ms_p50": 0.50, "latency_ms_p95": 0.95}

    def at(ratio: float) -> Column:
        return F.get("v", F.rint((F.size("v") - 1) * F.lit(ratio)).cast("int"))

    # picked first, as the rounding mentions its argument many times
    picked = ranked.select(*keys, *[at(r).alias(n) for n, r in ratios.items()])
    return picked.select(
        *keys, *[F.coalesce(fixed(F.col(n), 2).cast("double"), F.lit(0.0)).alias(n) for n in ratios]
    )


# Tasks' shares of one key's newest rows meet in so many groups first.
_SHARES = 256


def latency_percentiles_by(
    log: DataFrame,
    keys: tuple[str, ...] = ("path",),
    ratios: dict[str, float] | None = None,
    sample: int = LATENCY_SAMPLE,
    time: str = "ts",
    order: str = "event_id",
    value: str = "latency_ms",
) -> DataFrame:
    """``latency_percentiles`` of each service or path: over its own newest ``sample`` requests.

    A task gives at most ``sample`` rows of a key to the shuffle (the group limit below the exchange). As a key
    with a third of all rows sends that many from every task, the shares of some tasks meet
    before those of all: no group grows with the number of rows, and only by ``_SHARES`` with that of tasks.
    """
    conf = log.sparkSession.conf
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(conf.get(limit)) < sample:  # above it Spark would cut groups behind the shuffle only
        conf.set(limit, sample)
    rows = log.select(
        *keys, F.col(time).alias("_time"), F.col(order).alias("_order"), F.col(value).alias("_value"),
        (F.spark_partition_id() % _SHARES).alias("_share"),
    )
    for group in ([*keys, "_share"], list(keys)):
        newest = Window.partitionBy(*group).orderBy(F.desc("_time"), F.desc("_order"))
        rows = rows.withColumn("_place", F.row_number().over(newest)).filter(F.col("_place") <= sample).drop("_place")
    known = F.when(~F.isnan(F.col("_value").cast("double")), F.col("_value"))
    return _picked(rows.groupBy(*keys).agg(F.sort_array(F.collect_list(known)).alias("v")), ratios, list(keys))


def percentiles_of_all(
    log: DataFrame, ratios: dict[str, float] | None = None, value: str = "latency_ms"
) -> DataFrame:
    """Nearest-rank percentiles over the whole log, exact; 0 for none.

    Equal values are counted first; the counts are range-partitioned by value and stored, so each
    partition's total gives the rank it starts at, and only the partitions that hold a wanted
    rank are looked into. Null values take no part.
    """
    ratios = ratios or {"latency_ms_p50": 0.50, "latency_ms_p95": 0.95}
    counts = log.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v"))
    ordered = counts.agg(F.count("*").alias("n")).repartitionByRange("v")
    ordered = cut_lineage(ordered.withColumn("part", F.spark_partition_id()), "ranks")
    totals = ordered.groupBy("part").agg(F.sum("n").alias("n")).collect()  # one row per partition
    total, before, starts = sum(r["n"] for r in totals), 0, []
    for r in sorted(totals, key=lambda r: r["part"]):
        starts.append((r["part"], before, before + r["n"]))
        before += r["n"]
    columns = []
    inside = Window.partitionBy("part").orderBy("v")
    for name, ratio in ratios.items():
        rank = round((total - 1) * ratio) if total else 0  # half to even
        part, start, _ = next((s for s in starts if s[1] <= rank < s[2]), (-1, 0, 0))
        own = ordered.filter(F.col("part") == part).withColumn("upto", F.sum("n").over(inside))
        found = own.filter(F.col("upto") > rank - start).agg(F.min("v")).first()[0]
        columns.append(F.coalesce(fixed(F.lit(found).cast("double"), 2).cast("double"), F.lit(0.0)).alias(name))
    return log.sparkSession.range(1).select(*columns)


def runtime_snapshot(log: DataFrame, jobs: DataFrame) -> DataFrame:
    """The runtime section of the metrics document, one row: requests, latency, jobs.

    All parts are single rows but the counts by status code, one row for each code.
    """
    codes = status_code_counts(log).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status_code", "count")))).alias("status_codes")
    )
    whole = beside(request_totals(log), latency_percentiles(log))
    return beside(beside(whole, codes), job_status_counts(jobs))


def latest_jobs(updates: DataFrame, seq: str = "seq") -> DataFrame:
    """Current state of each job from its updates ``(job_id, status, ts, seq, error)``.

    One aggregate, combined per task before the shuffle, so a job with a huge number
    of updates costs no more than others. A ``queued`` update creates a job anew:
    jobs without one do not exist, and older start or finish times do not count.
    """
    at = F.struct("ts", seq)
    status = F.col("status")

    def last(*names: str) -> Column:
        return F.max(F.when(status.isin(*names), at))

    facts = updates.groupBy("job_id").agg(
        F.max(F.struct("ts", seq, "status", "error")).alias("last"),
        last("queued").alias("queued"),
        last("processing").alias("started"),
        last("completed", "failed").alias("finished"),
    )
    created = facts.filter(F.col("queued").isNotNull())
    return created.select(
        "job_id",
        F.col("last.status").alias("status"),
        F.col("queued.ts").alias("submitted_at"),
        F.when(F.col("started") > F.col("queued"), F.col("started.ts")).alias("started_at"),
        F.when(F.col("finished") > F.col("queued"), F.col("finished.ts")).alias("finished_at"),
        F.col("last.ts").alias("updated_at"),
        F.col("last.error").alias("error"),
    )


def job_status_counts(jobs: DataFrame) -> DataFrame:
    """One row with a count per known status, zeros included."""
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in JOB_STATUSES])


def live_jobs(jobs: DataFrame, as_of: Column, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """Drop jobs that finished more than the retention time before ``as_of``."""
    cutoff = as_of - F.expr(f"interval {int(ttl_seconds)} seconds")
    return jobs.filter(F.col("finished_at").isNull() | (F.col("finished_at") >= cutoff))
