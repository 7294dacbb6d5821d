import json
import random

import pytest
from pyspark.sql import functions as F

from parapet.operators.audit import audit
from parapet.operators import metrics as mt
from parapet.operators.normalize import to_conversations
from parapet.operators.quota import quota_verdicts
from parapet.streaming import ingest as si
from parapet.streaming import totals as st
from parapet.operators.requests import latency_percentiles_by, latest_jobs
from parapet.streaming.jobs import look_up, read_ledger, stream_jobs
from parapet.streaming.latency import read_latencies, stream_latencies
from parapet.streaming.quota import live_windows, stream_quota
from parapet.streaming.state import registered_timers
from parapet.streaming.volume import daily_totals

COLUMNS = ["request_id", "output_text", "flagged", "risk_labels", "tags"]


def write_lines(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def records(start, stop):
    texts = ["mail a@b.com", "fine", "I cannot", "women are evil"]
    return [
        json.dumps({"input_text": "q", "output_text": texts[i % 4], "request_id": f"{i:03d}",
                    "tags": ["s"], "timestamp": f"2024-01-{i % 5 + 1:02d}T00:00:00"})
        for i in range(start, stop)
    ]


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*COLUMNS).collect())


def test_ingest_matches_batch_and_is_idempotent(spark, tmp_path):
    source, table, bad = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "q")
    state = str(tmp_path / "state")
    write_lines(source, "1.json", records(0, 10) + ['{"input_text": "x", "output_text": " "}'])
    write_lines(source, "2.json", records(10, 15) + ['{"broken', ""])

    def run():
        stream = si.read_json_stream(spark, str(source), max_files=1, quarantine=True)
        si.ingest(stream, table, bad, state, jobs=str(tmp_path / "jobs")).awaitTermination()

    run()
    got = si.read_ingested(spark, table)
    clean = to_conversations(
        spark.read.schema("input_text string, output_text string, request_id string, tags string,"
                          " timestamp string").json(str(source))
    ).filter("request_id is not null").withColumn("id", F.lit(0))
    assert rows(got) == rows(audit(clean))
    reasons = spark.read.json(bad).groupBy("reject_reason").count().collect()
    assert {r[0]: r[1] for r in reasons} == {"output_text is required": 1, "malformed record": 1}
    numbers = [r["id"] for r in got.select("id").collect()]
    assert len(set(numbers)) == 15

    jobs = si.read_jobs(spark, str(tmp_path / "jobs"))
    last = jobs.groupBy("job_id").agg(F.max_by("status", "seq").alias("status")).groupBy("status").count()
    assert {r[0]: r[1] for r in last.collect()} == {"completed": 15, "failed": 2}

    # a later file continues from the checkpoint; nothing is audited twice
    write_lines(source, "3.json", records(15, 18))
    run()
    assert si.read_ingested(spark, table).count() == 18


def test_malformed_lines_stop_a_plain_stream(spark, tmp_path):
    source = tmp_path / "in"
    write_lines(source, "1.json", records(0, 3) + ['{"input_text": "x", "output_text": "415-555-0'])

    def start(**options):
        raw = si.read_json_stream(spark, str(source), **options)
        audited = audit(to_conversations(raw).withColumn("id", F.lit(1).cast("bigint")))
        return si.append_stream(audited, str(tmp_path / "out"), str(tmp_path / "state"))

    with pytest.raises(Exception):
        start().awaitTermination()
    with pytest.raises(ValueError, match="malformed"):
        start(quarantine=True)


def test_append_stream_and_totals(spark, tmp_path):
    source = tmp_path / "in"
    write_lines(source, "1.json", records(0, 10))
    write_lines(source, "2.json", records(10, 20))

    def stream():
        raw = si.read_json_stream(spark, str(source), max_files=1)
        return audit(to_conversations(raw).withColumn("id", F.col("request_id").cast("bigint")))

    path = str(tmp_path / "out")
    si.append_stream(stream(), path, str(tmp_path / "s1")).awaitTermination()
    table = spark.read.parquet(path)
    assert table.count() == 20 and "audit_date" in table.columns

    query = (
        daily_totals(stream()).writeStream.format("memory").queryName("totals")
        .outputMode("complete").option("checkpointLocation", str(tmp_path / "s2"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {str(r["day"]): (r["count"], r["flagged"]) for r in spark.table("totals").collect()}
    want = {
        str(r["audit_date"]): (r["n"], r["f"])
        for r in table.groupBy("audit_date").agg(
            F.count("*").alias("n"), F.count_if("flagged").alias("f")).collect()
    }
    assert got == want


def replay(spark, df, folder, cuts, order="event_id"):
    """Write ``df`` to ``folder`` in parts, in order; each becomes one micro-batch of a stream of one file a time."""
    for low, high in zip(cuts, cuts[1:]):
        part = df.filter((F.col(order) >= low) & (F.col(order) < high))
        part.coalesce(1).write.mode("append").parquet(folder)
    return si.read_parquet_stream(spark, folder, df.schema, max_bytes=1)


def drained(rows, tmp_path, mode="append"):
    """Run a stream to its end; gives its checkpoint and the parts it wrote, by micro-batch."""
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", state).outputMode(mode)
    writer.trigger(availableNow=True).start().awaitTermination()
    return state, out


@pytest.mark.parametrize("evict", [False, True])
def test_quota_stream_equals_batch(spark, tmp_path, evict):
    """Verdicts are those of the batch; with eviction the state holds just the windows that may still count."""
    rng = random.Random(5)
    times = sorted(rng.randrange(2_000_000_000) for _ in range(300))
    events = [(rng.choice(["hot", "hot", "a", "b", "c"]), t, i) for i, t in enumerate(times)]
    events += [(f"once{i}", t, 300 + i) for i, t in enumerate(sorted(rng.sample(times, 20)))]
    events = [(who, t, i) for i, (who, t, _) in enumerate(sorted(events, key=lambda e: e[1]))]
    df = spark.createDataFrame(events, "identity string, us long, event_id long")
    df = df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    log = replay(spark, df, str(tmp_path / "events"), (0, 110, 111, 220, 320))
    verdicts = stream_quota(log, limit=4, window_seconds=60, evict=evict, late="10 seconds")
    state, out = drained(verdicts, tmp_path)
    names = ["identity", "event_id", "n", "allowed", "remaining", "reset_s", "quota"]
    got = sorted(tuple(r) for r in spark.read.schema(verdicts.schema).parquet(out).select(*names).collect())
    want = quota_verdicts(df, limit=4, window_seconds=60).select(*names).collect()
    assert got == sorted(tuple(r) for r in want)
    last = {}
    for who, us, _ in events:
        if who not in last or us - last[who][0] >= 60_000_000:
            last[who] = [us, 0]
        last[who][1] += 1
    mark = events[-1][1] // 1000 - 10_000
    kept = {w: tuple(v) for w, v in last.items() if not evict or -(-(v[0] + 180_000_000) // 1000) > mark}
    assert len(kept) < len(last) if evict else len(kept) == 24
    found = live_windows(spark, state).select("identity", F.unix_micros("start"), "seen").collect()
    assert {r[0]: (r[1], r[2]) for r in found} == kept
    if evict:
        assert registered_timers(spark, state).count() >= len(kept)


STATUSES = ["queued", "processing", "completed", "failed"]


def plain_ledger(batches, ttl_us, late_us):
    """Jobs after updates ``(job, status, us, seq, error)`` batch by batch, forgotten between these."""
    jobs, newest = {}, None
    for batch in batches:
        for job, status, us, seq, error in batch:
            jobs.setdefault(job, []).append((us, seq, status, error))
        newest = max([newest or 0, *(u[2] for u in batch)])
        mark = newest // 1000 - late_us // 1000
        for job, updates in list(jobs.items()):
            queued = max((u for u in updates if u[2] == "queued"), default=None)
            ended = [u for u in updates if u[2] in ("completed", "failed") and (queued is None or u > queued)]
            end = max(updates)[0] if queued is None else max(ended)[0] if ended else None
            if end is not None and end // 1000 + 1 + ttl_us // 1000 <= mark:
                del jobs[job]
    found = {}
    for job, updates in jobs.items():
        queued = max((u for u in updates if u[2] == "queued"), default=None)
        if queued:
            later = lambda *s: max((u[0] for u in updates if u[2] in s and u > queued), default=None)  # noqa: B023, E731
            last = max(updates)
            found[job] = (last[2], queued[0], later("processing"), later("completed", "failed"), last[0], last[3])
    return found


def ledger_rows(df):
    micros = [F.unix_micros(c) for c in ("submitted_at", "started_at", "finished_at", "updated_at")]
    return {r[0]: tuple(r)[1:] for r in df.select("job_id", "status", *micros, "error").collect()}


def random_updates(seed, many=400, jobs=25, span=4_000_000_000):
    rng = random.Random(seed)
    times = sorted(rng.randrange(span) for _ in range(many))
    return [
        (f"j{rng.randrange(jobs)}", rng.choice(STATUSES), us, i, f"e{i}" if rng.random() < 0.3 else None)
        for i, us in enumerate(times)
    ]


@pytest.mark.parametrize("ttl", [100, 10**7])
def test_job_ledger(spark, tmp_path, ttl):
    updates = random_updates(ttl)
    df = spark.createDataFrame(updates, "job_id string, status string, us long, seq long, error string")
    df = df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    cuts = (0, 150, 151, 300, 400)
    stream = replay(spark, df, str(tmp_path / "in"), cuts, "seq")
    rows = stream_jobs(stream, ttl_seconds=ttl, late="5 seconds")
    state, out = drained(rows, tmp_path, "update")
    wanted = plain_ledger([updates[a:b] for a, b in zip(cuts, cuts[1:])], ttl * 1_000_000, 5_000_000)
    found = ledger_rows(read_ledger(spark, state))
    assert found == wanted
    told = spark.read.schema(rows.schema).parquet(out)
    if ttl == 100:
        gone = {r["job_id"] for r in told.filter("not live").collect()}
        assert gone and gone - set(found)
        for job in sorted(gone - set(found))[:2]:
            assert look_up(spark, state, job).count() == 0
    else:
        assert found == ledger_rows(latest_jobs(df))
        assert told.filter("not live").count() == 0
    one = sorted(found)[0]
    assert ledger_rows(look_up(spark, state, one)) == {one: found[one]}


def test_job_updates_out_of_order_and_incomplete(spark, tmp_path):
    """Updates of one micro-batch in any order, and of earlier ones; some lack their time, status or job."""
    updates = random_updates(7, 120, 6, 50_000_000)
    mixed = random.Random(1).sample(updates, len(updates))
    rows = [(*u, i) for i, u in enumerate(mixed)]
    rows += [("j1", None, 1, 900, None, 120), (None, "queued", 1, 901, None, 121), ("j2", "queued", None, 902, None, 122)]
    df = spark.createDataFrame(rows, "job_id string, status string, us long, seq long, error string, place int")
    df = df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    stream = replay(spark, df, str(tmp_path / "in"), (0, 50, 123), "place")
    state, _ = drained(stream_jobs(stream, late="1 hour"), tmp_path, "update")
    assert ledger_rows(read_ledger(spark, state)) == plain_ledger([updates], 10**15, 10**15)


@pytest.mark.parametrize("ttl", [100, 10**7])
def test_jobs_share_lists(spark, tmp_path, ttl):
    """Calls into Python depend on the number of lists and not on that of jobs; the ledger is the same."""
    updates = random_updates(3, 900, 300)
    df = spark.createDataFrame(updates, "job_id string, status string, us long, seq long, error string")
    df = df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    cuts = (0, 400, 401, 900)
    stream = replay(spark, df, str(tmp_path / "in"), cuts, "seq")
    state, _ = drained(stream_jobs(stream, ttl_seconds=ttl, late="5 seconds", buckets=4), tmp_path, "update")
    wanted = plain_ledger([updates[a:b] for a, b in zip(cuts, cuts[1:])], ttl * 1_000_000, 5_000_000)
    assert ledger_rows(read_ledger(spark, state)) == wanted
    held = spark.read.format("statestore").option("path", state).option("stateVarName", "jobs").load()
    assert held.select("key").distinct().count() <= 4


@pytest.mark.parametrize("salts", [1, 3])
def test_latencies_by_path(spark, tmp_path, salts):
    rng = random.Random(salts)
    rows = [
        (rng.choice(["/a", "/a", "/b", "/c", None]), None if i % 50 == 7 else rng.randrange(10**9), i,
         None if i % 31 == 5 else float("nan") if i % 37 == 3 else rng.random() * 100)
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "path string, us long, event_id long, latency_ms double")
    df = df.withColumn("ts", F.timestamp_micros("us")).drop("us").repartition(5)
    plain = {}
    for path in {r[0] for r in rows}:
        newest = sorted((-1 if r[1] is None else r[1], r[2], r[3]) for r in rows if r[0] == path)[-40:]
        values = sorted(v for *_, v in newest if v is not None and v == v)
        pick = [values[round((len(values) - 1) * ratio)] if values else 0.0 for ratio in (0.5, 0.95)]
        plain[path] = tuple(float(f"{v:.2f}") for v in pick)
    batch = latency_percentiles_by(df, sample=40)
    assert {r[0]: tuple(r)[1:] for r in batch.collect()} == plain
    stream = replay(spark, df, str(tmp_path / "in"), (0, 250, 251, 600))
    state, _ = drained(stream_latencies(stream, sample=40, salts=salts), tmp_path, "update")
    plain[""] = plain.pop(None)
    assert {r[0]: tuple(r)[1:] for r in read_latencies(spark, state, sample=40).collect()} == plain
    most = spark.read.format("statestore").option("path", state).option("stateVarName", "newest").load()
    assert most.groupBy("key").count().agg(F.max("count")).first()[0] <= 40


def test_group_limit_stands_below_the_exchange(spark):
    df = spark.range(10**6).selectExpr("string(id % 7) as path", "timestamp_micros(id) as ts", "id as event_id", "1.0D as latency_ms")
    plan = latency_percentiles_by(df)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange")[-1]
    assert "WindowGroupLimit" in below and below.index("WindowGroupLimit") < below.index("Range")


def audited_stream(spark, folder):
    raw = si.read_json_stream(spark, folder, max_files=1)
    return audit(to_conversations(raw).withColumn("id", F.col("request_id").cast("bigint")))


def same_answers(spark, totals, table):
    for hours in ("2024-01-04T00:00:00", "2024-01-05T00:00:01", "2024-01-03T23:30:00"):
        wanted = mt.overview(table, hours)
        found = st.running_overview(totals, table, hours)
        assert found.columns == wanted.columns and found.dtypes == wanted.dtypes
        assert near(found.first(), wanted.first())
    counts = lambda df: {r["label"]: r["count"] for r in df.collect()}
    assert counts(st.running_counts(totals)) == counts(mt.label_counts(table))
    days = {r["day"]: (r["count"], r["flagged"]) for r in st.running_daily(totals).collect()}
    table_days = table.groupBy("audit_date").agg(F.count("*").alias("n"), F.count_if("flagged").alias("f"))
    assert days == {r["audit_date"]: (r["n"], r["f"]) for r in table_days.collect()}


def near(a, b):
    return all(x == y or (isinstance(x, float) and abs(x - y) < 1e-9) for x, y in zip(a, b))


def test_running_totals_survive_repeats_and_compaction(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(4):
        write_lines(source, f"{i}.json", records(10 * i, 10 * i + 7 + i))
    path, state, table = str(tmp_path / "totals"), str(tmp_path / "state"), str(tmp_path / "table")
    si.append_stream(audited_stream(spark, str(source)), table, str(tmp_path / "s1")).awaitTermination()
    st.keep_totals(audited_stream(spark, str(source)), path, state).awaitTermination()
    stored = spark.read.parquet(table)
    same_answers(spark, st.read_totals(spark, path), stored)

    # the last micro-batch runs again, as after a failure behind its write
    commits = tmp_path / "state" / "commits"
    last = max(int(n.name) for n in commits.iterdir() if n.name.isdigit())
    (commits / str(last)).unlink()
    (commits / f".{last}.crc").unlink(missing_ok=True)
    st.keep_totals(audited_stream(spark, str(source)), path, state).awaitTermination()
    same_answers(spark, st.read_totals(spark, path), stored)

    smaller = str(tmp_path / "smaller")
    st.compact_totals(spark, path, smaller)
    same_answers(spark, st.read_totals(spark, smaller), stored)
    write_lines(source, "9.json", records(60, 65))  # the stream goes on in the new folder
    st.keep_totals(audited_stream(spark, str(source)), smaller, state).awaitTermination()
    si.append_stream(audited_stream(spark, str(source)), table, str(tmp_path / "s1")).awaitTermination()
    same_answers(spark, st.read_totals(spark, smaller), spark.read.parquet(table))


def test_totals_of_nothing(spark, tmp_path):
    rows = audit(to_conversations(spark.createDataFrame([], si.RAW_CONVERSATION_SCHEMA)).withColumn("id", F.lit(1).cast("bigint")))
    st.add_totals(rows, str(tmp_path / "t"), 0)
    totals = st.read_totals(spark, str(tmp_path / "t"))
    assert st.running_overview(totals, rows, "2024-01-01T00:00:00").first() == mt.overview(rows, "2024-01-01T00:00:00").first()
    assert st.running_counts(totals).collect() == []


@pytest.mark.parametrize("place", ["table", "quarantine", "jobs", "commit"])
def test_a_crash_leaves_all_of_a_batch_or_nothing(spark, tmp_path, monkeypatch, place):
    """Readers see the first batch alone after a crash within the second, wherever it strikes, then both."""
    source, state = tmp_path / "in", str(tmp_path / "state")
    table, bad, jobs, commits = (str(tmp_path / n) for n in ("t", "q", "j", "c"))
    write_lines(source, "1.json", records(0, 10) + ['{"input_text": "x", "output_text": " "}'])

    def run():
        stream = si.read_json_stream(spark, str(source), max_files=1, quarantine=True)
        si.ingest(stream, table, bad, state, jobs=jobs, commits=commits).awaitTermination()

    def seen():
        last = si.read_jobs(spark, jobs, commits).select("job_id").distinct().count()
        return si.read_ingested(spark, table, commits).count(), si.read_rejected(spark, bad, commits).count(), last

    assert si.last_commit(spark, commits) == -1
    run()
    assert seen() == (10, 1, 11)
    write_lines(source, "2.json", records(10, 15) + ['{"broken', '{"output_text": "y"}'])
    name = {"table": "write_day_batches", "quarantine": "job_updates", "jobs": "commit", "commit": "commit"}[place]
    real = getattr(si, name)

    def crash(*args):
        if place in ("table", "commit"):
            real(*args)  # strikes behind the write
        raise RuntimeError("crash")

    monkeypatch.setattr(si, name, crash)
    with pytest.raises(Exception, match="crash"):
        run()
    assert seen() == ((15, 3, 18) if place == "commit" else (10, 1, 11))
    monkeypatch.setattr(si, name, real)
    run()
    assert seen() == (15, 3, 18)
    assert si.read_ingested(spark, table, commits).columns == si.read_ingested(spark, table).columns
