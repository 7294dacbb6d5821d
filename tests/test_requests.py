import random

import pytest
from pyspark.sql import functions as F

from parapet.operators import requests as rq
from parapet.operators.quota import quota_verdicts, with_quota_status

WINDOW, LIMIT = 60, 3


def brute_force(rows):
    """The sequential rule, one request at a time."""
    state, out = {}, {}
    for who, us, number in sorted(rows):
        start, count = state.get(who, (us, 0))
        if us - start >= WINDOW * 1_000_000:
            start, count = us, 0
        count += 1
        state[who] = (start, count)
        reset = max(0, int(WINDOW - (us - start) / 1e6))
        out[number] = (count, count <= LIMIT, max(0, LIMIT - count), reset)
    return out


def log_rows(seed, clients, total, span_us):
    """Random requests; the first client sends a third of them, with equal times and gaps."""
    rng, rows = random.Random(seed), []
    for number in range(total):
        who = "hot" if rng.random() < 0.34 else f"c{rng.randrange(clients)}"
        us = rng.randrange(span_us)
        kind = rng.random()
        if kind < 0.2:
            us -= us % 1_000_000
        elif kind < 0.3:
            us -= us % (WINDOW * 1_000_000)
        rows.append((who, us, number))
    return rows


def as_log(spark, rows):
    df = spark.createDataFrame(rows, "identity string, us long, event_id long")
    return df.withColumn("ts", F.timestamp_micros("us")).repartition(5)


def verdicts(df):
    rows = df.collect()
    return {r["event_id"]: (r["n"], r["allowed"], r["remaining"], r["reset_s"]) for r in rows}


@pytest.mark.parametrize("span", [30_000_000, 3_000_000_000])
@pytest.mark.parametrize("hot_rows,slot", [(10**9, 10**6), (200, 10**6), (5, 7_000_000)])
def test_quota_equals_brute_force(spark, span, hot_rows, slot):
    rows = log_rows(7, 12, 1500, span)
    got = quota_verdicts(as_log(spark, rows), limit=LIMIT, window_seconds=WINDOW,
                         hot_rows=hot_rows, slot_us=slot)
    assert verdicts(got) == brute_force(rows)


def test_quota_state_crosses_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = log_rows(3, 4, 600, 600_000_000)
        got = quota_verdicts(as_log(spark, rows), limit=LIMIT, window_seconds=WINDOW)
        assert verdicts(got) == brute_force(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_second_request_is_denied(spark):
    rows = [("a", 0, 1), ("a", 1_500_000, 2), ("a", 60_000_000, 3), ("b", 0, 4)]
    got = verdicts(quota_verdicts(as_log(spark, rows), limit=1, window_seconds=60))
    assert got == {1: (1, True, 0, 60), 2: (2, False, 0, 58), 3: (1, True, 0, 60),
                   4: (1, True, 0, 60)}


def test_denied_requests_end_in_429(spark):
    rows = [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 4)]
    log = as_log(spark, rows).withColumn("status_code", F.lit(200))
    log = log.withColumn("path", F.when(F.col("event_id") == 1, "/health").otherwise("/audit"))
    got = with_quota_status(log, rq.is_exempt(F.col("path")), limit=1, window_seconds=60)
    codes = {r["event_id"]: r["status_code"] for r in got.collect()}
    assert codes == {1: 200, 2: 200, 3: 429, 4: 200}


def test_identity(spark):
    import hashlib

    cases = [
        (" k1 ", "Bearer other", "1.2.3.4", "9.9.9.9", "key:k1"),
        (None, "bearer  tok ", None, "9.9.9.9", "key:tok"),
        (None, "Basic abc", " 1.2.3.4 , 5.6.7.8", "9.9.9.9", "ip:1.2.3.4"),
        ("", "Bearer a b", "", "9.9.9.9", "ip:9.9.9.9"),
        (None, None, None, None, "ip:unknown"),
        ("  ", "Bearer tok", None, "9.9.9.9", "ip:9.9.9.9"),
    ]
    df = spark.createDataFrame(
        [(i, *c[:4]) for i, c in enumerate(cases)],
        "i int, k string, a string, f string, ip string",
    )
    columns = [F.col(c) for c in ("k", "a", "f", "ip")]
    rows = df.select("i", rq.client_identity(*columns).alias("h")).collect()
    for r in rows:
        want = hashlib.sha256(cases[r["i"]][4].encode()).hexdigest()[:16]
        assert r["h"] == want, cases[r["i"]]


def test_exempt_paths(spark):
    paths = ["/health", "/healthz", "/readyz", "/docs", "/redoc/x", "/openapi.json", "/audit",
             "/healthy", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in df.select(rq.is_exempt(F.col("path"))).collect()] == [
        True, True, True, True, True, True, False, False, False]


def latency_log(spark, values):
    rows = [(i, i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id long, s long, latency_ms double")
    return df.withColumn("ts", F.timestamp_seconds("s"))


def percentile(values, ratio):
    ordered = sorted(values)
    return round(float(ordered[int(round((len(ordered) - 1) * ratio))]), 2)


@pytest.mark.parametrize("size", [1, 2, 3, 6, 11, 2500])
def test_percentiles(spark, size):
    rng = random.Random(size)
    values = [rng.choice([2.675, 1.005, rng.random() * 5000]) for _ in range(size)]
    row = rq.latency_percentiles(latency_log(spark, values)).first()
    newest = values[-2000:]
    assert row == (percentile(newest, 0.5), percentile(newest, 0.95))


def test_no_requests(spark):
    empty = latency_log(spark, [1.0]).filter("event_id < 0").withColumn("status_code", F.lit(200))
    assert rq.latency_percentiles(empty).first() == (0.0, 0.0)
    assert rq.request_totals(empty).first() == (0, 0, 0.0)


def test_request_totals(spark):
    log = spark.createDataFrame([(200,), (500,), (503,), (429,)], "status_code int")
    assert rq.request_totals(log).first() == (4, 2, 0.5)
    assert {r[0]: r[1] for r in rq.status_code_counts(log).collect()} == {
        "200": 1, "500": 1, "503": 1, "429": 1}


def test_jobs(spark):
    updates = spark.createDataFrame(
        [
            ("a", "queued", 1, 1, None), ("a", "processing", 2, 2, None),
            ("a", "completed", 3, 3, None),
            ("b", "processing", 1, 1, None), ("b", "queued", 2, 2, None),
            ("c", "completed", 1, 1, None),
            ("d", "queued", 1, 1, None), ("d", "failed", 1, 2, "boom"),
        ],
        "job_id string, status string, t long, seq long, error string",
    ).withColumn("ts", F.timestamp_seconds("t"))
    jobs = rq.latest_jobs(updates)
    rows = {r["job_id"]: r for r in jobs.collect()}
    assert set(rows) == {"a", "b", "d"}  # c was never queued
    assert rows["a"]["status"] == "completed" and rows["a"]["started_at"] is not None
    assert rows["b"]["status"] == "queued" and rows["b"]["started_at"] is None
    assert rows["d"]["error"] == "boom" and rows["d"]["finished_at"] is not None
    assert rq.job_status_counts(jobs).first() == (1, 0, 1, 1)
    kept = rq.live_jobs(jobs, F.timestamp_seconds(F.lit(12)), ttl_seconds=10)
    assert sorted(r["job_id"] for r in kept.collect()) == ["a", "b"]


def test_quota_without_identity_or_time(spark):
    rows = [(None, 1, 1), (None, 2, 2), ("", 1, 3), ("", None, 4), (None, None, 5)]
    log = spark.createDataFrame(rows, "identity string, s long, event_id long")
    log = log.withColumn("ts", F.timestamp_seconds("s"))
    for hot_rows in (100, 0):
        got = quota_verdicts(log, limit=1, window_seconds=60, hot_rows=hot_rows).collect()
        found = {r["event_id"]: (r["identity"], r["n"], r["allowed"], r["remaining"]) for r in got}
        assert found == {
            1: (None, 1, True, 0), 2: (None, 2, False, 0), 3: ("", 1, True, 0),
            4: ("", None, None, None), 5: (None, None, None, None),
        }


def test_percentiles_of_all_values(spark):
    import random

    from parapet.operators.requests import percentiles_of_all

    rng = random.Random(4)
    values = [rng.choice((0.5, round(rng.random() * 100, 2))) for _ in range(501)]
    log = spark.createDataFrame([(v,) for v in values] + [(None,)], "latency_ms double").repartition(7)
    row = percentiles_of_all(log, {"low": 0.0, "p50": 0.5, "p95": 0.95, "high": 1.0}).first()
    order = sorted(values)
    assert tuple(row) == tuple(order[round(500 * p)] for p in (0.0, 0.5, 0.95, 1.0))
    assert tuple(percentiles_of_all(log.filter("latency_ms < 0")).first()) == (0.0, 0.0)
