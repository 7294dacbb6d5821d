"""Every registered query against its SQL twin, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from parapet.plans.oracles import ORACLES
from parapet.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return connection


TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def cells(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, sql, name):
    df = entry_points.queries()[name](spark, data)
    result = sql.execute(entry_points.oracle_sql()[name])
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    assert {name: TYPES[kind] for name, kind in df.dtypes} == types
    assert cells(df.columns, df.collect()) == cells(names, result.fetchall())


def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.columns == ["project_name", "label", "count"] and rows.count() > 0


def test_every_twin_has_a_query():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
