import pytest
from pyspark.sql import functions as F

from parapet.functions import text as tx
from parapet.operators import normalize as nz
from parapet.operators.audit import with_time
from parapet.sources.readers import from_rows, payload_rows


def test_tag_forms(spark):
    texts = [(None,), (" a, b ,,c　",), ('["x ", "", "y"]',), ("[broken",), ("",)]
    rows = nz.normalize_tags(spark.createDataFrame(texts, "tags string")).collect()
    assert [r[0] for r in rows] == [[], ["a", "b", "c"], ["x", "y"], ["[broken"], []]
    arrays = spark.createDataFrame([([" a", None, " "],), (None,)], "tags array<string>")
    assert [r[0] for r in nz.normalize_tags(arrays).collect()] == [["a"], []]
    numbers = spark.createDataFrame([(5,), (None,)], "tags int")
    assert [r[0] for r in nz.normalize_tags(numbers).collect()] == [["5"], []]
    floats = spark.createDataFrame([(float("nan"),)], "tags double")
    assert nz.normalize_tags(floats).first()[0] == []


def test_from_rows_forms(spark):
    rows = from_rows(
        spark,
        [
            {"input_text": "a", "output_text": "b", "tags": "x, y"},
            ("c", "d"),
            {"output_text": 5, "tags": 7},
            {"input_text": "e", "tags": float("nan"), "user_id": 9},
        ],
    ).collect()
    assert [r["tags"] for r in rows] == [["x", "y"], [], ["7"], []]
    assert rows[2]["input_text"] == "" and rows[2]["output_text"] == "5"
    assert rows[3]["user_id"] == "9"
    with pytest.raises(ValueError, match="Unsupported"):
        from_rows(spark, [5])


def test_defaults_rules(spark):
    df = from_rows(
        spark,
        [
            {"input_text": "a", "output_text": "b", "project_name": None},
            {"input_text": "a", "output_text": "b", "project_name": "", "tags": ["t"]},
        ],
    )
    weak = nz.fill_missing(df, tags=["d"], project_name="p").collect()
    assert [r["project_name"] for r in weak] == ["p", ""]
    assert [r["tags"] for r in weak] == [["d"], ["t"]]
    strong = nz.fill_falsy(df, tags=["d"], project_name="p").collect()
    assert [r["project_name"] for r in strong] == ["p", "p"]
    with pytest.raises(ValueError):
        nz.fill_missing(df, nonsense="x")


def test_timestamp_default_and_parse(spark):
    df = spark.createDataFrame([(None,), ("",), ("2024-05-01T10:00:00",), ("junk",)],
                               "timestamp string")
    rows = with_time(nz.fill_timestamp(df, "2024-01-01T00:00:00")).collect()
    assert [r["timestamp"] for r in rows][:2] == ["2024-01-01T00:00:00"] * 2
    assert [str(r["audit_date"]) for r in rows] == [
        "2024-01-01", "2024-01-01", "2024-05-01", "None"]


def test_lists_round_trip(spark):
    values = [(None,), ("",), ("[]",), ('["a", "b"]',), ("plain",), ("[bad",), ('{"a": 1}',)]
    df = spark.createDataFrame(values, "v string")
    got = [r[0] for r in df.select(tx.decode_list(F.col("v"))).collect()]
    assert got == [[], [], [], ["a", "b"], ["plain"], ["[bad"], ['{"a": 1}']]
    lists = spark.createDataFrame([(['a"b', "c\\d", "é", "x, y"],), ([],), (None,)],
                                  "v array<string>")
    texts = [r[0] for r in lists.select(tx.encode_list(F.col("v"))).collect()]
    assert texts == ['["a\\"b", "c\\\\d", "\\u00E9", "x, y"]', "[]", "[]"]
    again = lists.select(tx.decode_list(tx.encode_list(F.col("v")))).collect()
    assert [r[0] for r in again] == [['a"b', "c\\d", "é", "x, y"], [], []]


def test_flags(spark):
    df = spark.createDataFrame([(" Yes ",), ("T",), ("0",), (None,), ("on",)], "v string")
    assert [r[0] for r in df.select(tx.decode_flag(F.col("v"))).collect()] == [
        True, True, False, False, False]
    numbers = spark.createDataFrame([(1.5,), (0.0,), (None,)], "v double")
    assert [r[0] for r in numbers.select(tx.decode_number_flag(F.col("v"))).collect()] == [
        True, False, False]


def test_strip_is_unicode(spark):
    df = spark.createDataFrame([("  a b\x1f ",), ("　",), ("x",)], "v string")
    assert [r[0] for r in df.select(tx.strip(F.col("v"))).collect()] == ["a b", "", "x"]


def test_quarantine(spark):
    df = from_rows(spark, [("a", "b"), (" ", "b"), ("a", "　"), ("", "")])
    valid, rejected = nz.split_valid(df)
    assert valid.count() == 1
    assert sorted(r["reject_reason"] for r in rejected.collect()) == [
        "input_text is required",
        "input_text is required; output_text is required",
        "output_text is required",
    ]


def test_missing_columns_and_decoding(spark):
    old = spark.createDataFrame(
        [(1, "1", '["pii"]', None)],
        "id int, flagged string, risk_labels string, redaction_count string",
    )
    row = nz.ensure_columns(nz.decode_row(old)).first()
    assert row["flagged"] is True and row["risk_labels"] == ["pii"]
    assert row["redaction_count"] == 0 and row["tags"] == [] and row["self_harm"] is False
    assert row["project_name"] == ""


def test_dense_ids(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumnRenamed("id", "v")
    rows = nz.assign_ids(df, first=5).collect()
    assert sorted(r["id"] for r in rows) == list(range(5, 1005))


def test_union_is_a_bag(spark):
    a = from_rows(spark, [("a", "b")])
    assert nz.union_all(a, a, a).count() == 3


def test_payload(spark):
    text = '[{"input_text": "a", "output_text": "b", "tags": [" x "]}, {"output_text": "c"}]'
    rows = payload_rows(spark.createDataFrame([(text,)], "records string"), "records").collect()
    assert [(r["input_text"], r["output_text"], r["tags"]) for r in rows] == [
        ("a", "b", ["x"]), ("", "c", [])]
