"""Point lookups in a table of many files."""

import os

import pytest
from pyspark.sql import functions as F

from parapet.operators import listing as ls
from parapet.operators.filters import AuditFilter
from parapet.plans import corpus as cp
from parapet.sources import writers as wr
from parapet.sources.readers import read_audit_table
from tests.plans import total_of

COPIES = 24


@pytest.fixture(scope="module")
def table(spark, data, tmp_path_factory):
    """Many files whose ranges of ids, requests and users all overlap."""
    path = str(tmp_path_factory.mktemp("lookup") / "t")
    rows = cp.audit_seeded(cp.seeded_input(spark, data)).cache()
    for i in range(COPIES):
        part = rows.withColumns({
            "id": F.col("id") * COPIES + i, "request_id": F.format_string("req-%d-%d", "id", F.lit(i)),
            "user_id": F.format_string("user-%d-%d", F.col("id") % 50, F.lit(i)),
        })
        wr.write_audit_table(part.withColumn("audit_date", F.lit("2024-01-01").cast("date")), path)
    yield read_audit_table(spark, path), path
    rows.unpersist()


@pytest.mark.parametrize("column, value", [("id", 42 * COPIES + 5), ("request_id", "req-42-5"), ("user_id", "user-7-5")])
def test_few_row_groups_are_read(table, column, value):
    df, _ = table
    found = df.filter(F.col(column) == value).select("id", column)
    rows = found.collect()
    plain = df.select("id", column).collect()
    assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in plain if r[column] == value) and rows
    assert total_of(found, "Scan parquet", "numOutputRows") <= len(plain) / COPIES * 4


def test_lookups_and_filters_agree(table):
    df, _ = table
    assert [r["request_id"] for r in ls.by_id(df, 42 * COPIES + 5).collect()] == ["req-42-5"]
    assert ls.by_id(df, 10**9).collect() == []
    assert AuditFilter(user_id="user-7-5").apply(df).count() == df.filter("user_id like 'user-7-5'").count()


def test_filters_stay_small(table):
    _, path = table
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert sum(sizes) / len(sizes) < 600_000
