"""Deep pages by the index against the offset form."""

import random

import pytest
from pyspark.sql import functions as F

from parapet.operators import listing as ls
from parapet.operators import paging as pg
from tests.plans import total_of

SCHEMA = "id long, timestamp string, audit_date date, flagged boolean"


def stored(spark, folder, rows, parts=3):
    df = spark.createDataFrame(rows, "id long, timestamp string, flagged boolean")
    df = df.withColumn("audit_date", F.to_date(F.try_to_timestamp("timestamp")))
    df.repartition(parts).sortWithinPartitions("timestamp").write.partitionBy("audit_date").mode("append").parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder)


def times(rng, many):
    out = []
    for _ in range(many):
        kind = rng.randrange(6)
        if kind == 0:
            out.append(None)
        elif kind == 1:
            out.append("2024-01-02T10:00:00")  # one moment of very many rows
        elif kind == 2:
            out.append(f"2024-01-02T10:00:00.{rng.randrange(10**6):06d}")  # one second
        elif kind == 3:
            out.append(f"2024-01-0{rng.randrange(1, 6)}T{rng.randrange(24):02d}:30:{rng.randrange(60):02d}")
        elif kind == 4:
            out.append(rng.choice(["2024-01-03", "2024-01-03T05", "", "soon", "2024-01-03T05:00:00+02:00"]))
        else:
            out.append(f"2024-01-04T07:0{rng.randrange(3)}:00.{rng.randrange(3)}")
    return out


@pytest.mark.parametrize("leaf, seed", [(5, 1), (40, 2), (10**6, 3)])
def test_every_page_equals_the_offset_form(spark, tmp_path, leaf, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(1 << 19), 400)
    rows = [(None if i == ids[7] else i, t, rng.random() < 0.3) for i, t in zip(ids, times(rng, 400))]
    df = stored(spark, str(tmp_path / "t"), rows)
    pg.write_page_index(df.filter("coalesce(id, 0) % 3 != 0"), str(tmp_path / "i"), leaf)
    pg.write_page_index(df.filter("coalesce(id, 0) % 3 = 0"), str(tmp_path / "i"), leaf if seed != 2 else 3)
    index = pg.read_page_index(spark, str(tmp_path / "i"))
    assert pg.page_total(index) == 400 and pg.page_total(index, True) == sum(r[2] for r in rows)
    ordered = [tuple(r) for r in df.orderBy(*ls.newest_first()).select("id", "timestamp").collect()]
    marked = [tuple(r) for r in df.filter("flagged").orderBy(*ls.newest_first()).select("id", "timestamp").collect()]
    for number, size, flagged in [(1, 7, False), (9, 7, False), (23, 13, False), (31, 13, False), (32, 13, False), (4, 100, False), (3, 11, True), (8, 13, True)]:
        wanted = (marked if flagged else ordered)[(number - 1) * size : number * size]
        page = pg.page_at(df, index, number, size, flagged)
        assert [tuple(r) for r in page.select("id", "timestamp").collect()] == wanted, (number, size, flagged)


def test_deep_page_reads_one_day(spark, tmp_path):
    """Page 100,000 of 26 days of 100,000 rows."""
    folder, where = str(tmp_path / "t"), str(tmp_path / "i")
    day = F.col("id") % 26
    moment = F.expr("timestamp '2024-01-01 00:00:00'") + F.make_dt_interval(day.cast("int"), F.lit(0), F.lit(0), (F.col("id") / 26 % 86400).cast("decimal(18,0)"))
    rows = spark.range(2_600_000).select(
        "id", F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.to_date(moment).alias("audit_date"),
        (F.col("id") % 5 == 0).alias("flagged"),
    )
    rows.repartition(8, "audit_date").sortWithinPartitions("audit_date", "timestamp").write.partitionBy("audit_date").parquet(folder)
    df = spark.read.schema(SCHEMA).parquet(folder)
    pg.write_page_index(df, where)
    index = pg.read_page_index(spark, where)
    page = pg.page_at(df, index, 100_000, 25)
    got = [r["id"] for r in page.collect()]
    assert got == [r["id"] for r in ls.page(df, 100_000, 25).collect()]
    assert total_of(page, "Scan parquet", "numFiles") == 1
    assert total_of(page, "Scan parquet", "numOutputRows") <= 100_000


def test_page_bounds(spark, tmp_path):
    df = stored(spark, str(tmp_path / "t"), [(1, "2024-01-01T00:00:00", True)])
    pg.write_page_index(df, str(tmp_path / "i"))
    index = pg.read_page_index(spark, str(tmp_path / "i"))
    assert pg.page_at(df, index, 2).collect() == []
    assert pg.page_at(df, index.limit(0), 1).collect() == []
    with pytest.raises(ValueError):
        pg.page_at(df, index, 0)
