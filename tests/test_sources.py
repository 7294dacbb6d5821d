import pytest
from pyspark.sql import functions as F

from parapet.operators import audit as au
from parapet.operators import incidents as inc
from parapet.operators.filters import AuditFilter
from parapet.sources import readers as rd
from parapet.sources import writers as wr


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    path = put(
        tmp_path,
        "a.csv",
        'user_id,output_text,input_text,tags\n'
        '007,"line one\nline ""two""",hi,"pii, example"\n'
        ",,x,\n",
    )
    with pytest.raises(Exception):
        rd.read_csv(spark, path).collect()  # a line break in a field needs multi_line
    rows = rd.read_csv(spark, path, multi_line=True).orderBy("input_text").collect()
    assert rows[0]["user_id"] == "007" and rows[0]["output_text"] == 'line one\nline "two"'
    assert rows[0]["tags"] == ["pii", "example"] and rows[0]["project_name"] is None
    # blank cells: null for meta fields, '' for texts
    assert rows[1]["user_id"] is None and rows[1]["output_text"] == "" and rows[1]["tags"] == []


def test_csv_without_required_columns(spark, tmp_path):
    path = put(tmp_path, "a.csv", "tags,user_id\nx,y\n")
    with pytest.raises(ValueError, match="Missing required columns: input_text, output_text"):
        rd.read_csv(spark, path)


def test_csv_with_differing_headers_fails(spark, tmp_path):
    put(tmp_path, "a.csv", "input_text,output_text\na,b\n")
    put(tmp_path, "b.csv", "output_text,input_text\nb,a\n")
    with pytest.raises(Exception, match="(?i)header"):
        rd.read_csv(spark, str(tmp_path)).collect()


def test_jsonl(spark, tmp_path):
    path = put(
        tmp_path,
        "a.jsonl",
        '{"input_text": "a", "output_text": "b", "tags": ["x", " y "], "user_id": 7}\n'
        "\n"
        '{"output_text": "c", "tags": "p,q", "extra": 1}\n',
    )
    rows = rd.read_jsonl(spark, path).orderBy("output_text").collect()
    assert [r["tags"] for r in rows] == [["x", "y"], ["p", "q"]]
    assert rows[0]["user_id"] == "7" and rows[1]["input_text"] == ""
    bad = put(tmp_path, "bad.jsonl", '{"input_text": "a"\n')
    with pytest.raises(Exception):
        rd.read_jsonl(spark, bad).collect()


def test_payload_file(spark, tmp_path):
    path = put(tmp_path, "p.json",
               '{"records": [{"input_text": "a", "output_text": "b"},\n'
               ' {"input_text": "c", "output_text": "d", "tags": ["t"]}]}')
    rows = rd.read_payload(spark, path).orderBy("input_text").collect()
    assert [(r["output_text"], r["tags"]) for r in rows] == [("b", []), ("d", ["t"])]


def test_broken_payloads(spark, tmp_path):
    broken = put(tmp_path, "p.json", '{"records": [{"input_text": "a", "output_text": "call 4')
    with pytest.raises(Exception):
        rd.read_payload(spark, broken).collect()
    rows = ['[{"output_text": "x", "tags": "a, b"}, {"output_text": "y"}]', '[{"output_text": "z', "[]", None, "7"]
    df = spark.createDataFrame(list(enumerate(rows)), "n int, body string")
    with pytest.raises(Exception):
        rd.payload_rows(df, "body").collect()
    records, rejects = rd.split_payload(df, "body")
    assert sorted((r["n"], r["output_text"], tuple(r["tags"])) for r in records.collect()) == [
        (0, "x", ("a", "b")), (0, "y", ()),
    ]
    assert sorted((r["n"], r["body"]) for r in rejects.collect()) == [(1, rows[1]), (3, None), (4, "7")]


def test_upload(spark, tmp_path):
    csv = put(tmp_path, "u.csv", "input_text,output_text,project_name\na,b,\na,b,own\n")
    rows = rd.read_upload(spark, csv, tags=["t"], project_name="given").collect()
    assert sorted(r["project_name"] for r in rows) == ["given", "own"]
    assert all(r["tags"] == ["t"] for r in rows)
    lines = put(tmp_path, "u.jsonl", '{"output_text": "b", "project_name": ""}\n')
    assert rd.read_upload(spark, lines, project_name="given").first()["project_name"] == "given"


def test_labeled(spark, tmp_path):
    path = put(tmp_path, "l.jsonl", '{"output_text": "x", "label_pii": true}\n')
    row = rd.read_labeled(spark, path).first()
    assert row["label_pii"] and not row["label_bias"] and row["input_text"] == ""


def test_labels_by_truth(spark, tmp_path):
    values = ["true", "1", '"yes"', "2.5", "false", "0", '""', "null", "[]"]
    lines = [f'{{"input_text": "{i}", "label_pii": {v}}}' for i, v in enumerate(values)]
    path = put(tmp_path, "l.jsonl", "\n".join(lines) + "\n")
    rows = sorted(rd.read_labeled(spark, path).collect(), key=lambda r: int(r["input_text"]))
    assert [r["label_pii"] for r in rows] == [True] * 4 + [False] * 5
    bad = put(tmp_path, "bad.jsonl", lines[0] + "\n" + lines[1][:-3] + "\n")
    with pytest.raises(Exception):
        rd.read_labeled(spark, bad).collect()
    kept, rejects = rd.split_labeled(spark, bad)
    assert kept.count() == 1 and [r["line"] for r in rejects.collect()] == [lines[1][:-3]]


def test_broken_baseline_fails(spark, tmp_path):
    from parapet.operators.evaluation import gate

    path = put(tmp_path, "m.json", '{"signals": {"pii": {"precision": 1.0, "rec')
    with pytest.raises(Exception):
        rd.read_metrics(spark, path).collect()
    empty = rd.read_metrics(spark, put(tmp_path, "e.json", "{}"))
    with pytest.raises(ValueError, match="no signals"):
        gate(empty, empty)


@pytest.fixture(scope="module")
def audited(spark):
    rows = [
        {"input_text": "a", "output_text": 'x@y.com, "quoted"\nline', "request_id": str(i),
         "tags": ["t", "é"], "timestamp": f"2024-01-0{i % 3 + 1}T00:00:00"}
        for i in range(30)
    ] + [{"input_text": "a", "output_text": "fine", "request_id": "99", "timestamp": "junk"}]
    df = rd.from_rows(spark, rows).withColumn("id", F.col("request_id").cast("bigint"))
    return au.audit(df).cache()


def test_table_append_and_pruning(spark, audited, tmp_path):
    path = str(tmp_path / "table")
    wr.write_audit_table(audited, path)
    wr.write_audit_table(audited, path)
    table = rd.read_audit_table(spark, path)
    assert table.count() == 62 and table.filter("audit_date is null").count() == 2
    assert sorted(table.columns) == sorted(audited.columns)
    chosen = AuditFilter(start_date="2024-01-02", end_date="2024-01-02", prune_days=True)
    pruned = chosen.apply(table)
    assert pruned.count() == 20
    plan = pruned.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(audit_date" in plan
    read = plan.split("ReadSchema:")[1]
    assert "output_text" not in read and "id:bigint" in read


def test_append_batch(spark, audited, tmp_path):
    path = str(tmp_path / "table")
    for batch in (0, 3, 3):
        wr.append_batch(audited, path, batch)
    table = rd.read_audit_table(spark, path)
    ids = [r["id"] for r in table.select("id").collect()]
    assert len(ids) == len(set(ids)) == 62 and table.columns == audited.columns
    assert sorted(i - (3 << 40) for i in ids if i > 3 << 40) == list(range(1, 32))
    wr.compact(spark, path, str(tmp_path / "compact"))
    assert sorted(r["id"] for r in rd.read_audit_table(spark, str(tmp_path / "compact")).collect()) == sorted(ids)


def test_csv_export(spark, audited, tmp_path):
    path = str(tmp_path / "export")
    wr.export_csv(audited, path, AuditFilter(flagged=True))
    rows = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    assert rows.count() == 30
    row = rows.filter("id = '3'").first()
    assert row["risk_labels"] == '["pii"]' and row["flagged"] == "1" and row["bias"] == "0"
    assert row["tags"] == '["t", "\\u00E9"]'
    assert row["output_text"] == '[REDACTED_EMAIL], "quoted"\nline'
    assert row["project_name"] is None

    again = rd.read_exported(spark, path)
    assert again.dtypes == [(n, t) for n, t in audited.dtypes]
    texts = ["id", "output_text", "flagged", "risk_labels", "tags", "ts"]
    want = audited.filter("flagged").select(*texts).collect()
    assert sorted(map(str, again.select(*texts).collect())) == sorted(map(str, want))


def test_missing_fields_of_records(spark):
    lines = ['{"input_text": null, "output_text": "a"}', '{"output_text": {"input_text": 1}}', "{}", "[1]", "junk", None, '{"input_text": "a']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    found = {r["i"]: r["m"] for r in df.select("i", rd.missing_fields(F.col("t")).alias("m")).collect()}
    both = ["input_text", "output_text"]
    assert found == {0: [], 1: ["input_text"], 2: both, 3: both, 4: both, 5: both, 6: both}


def test_json_report_is_written_and_read_back(spark, tmp_path):
    rows = rd.from_rows(spark, [("q\n\u2028", "I cannot\r\nhelp"), ("q", "mail a@b.com"), ("q", "fine")])
    table = au.audit(rows.withColumn("id", F.monotonically_increasing_id()), batch_time="2024-01-01T00:00:00")
    documents = inc.report_documents(table, "2024-01-02T00:00:00")
    path = str(tmp_path / "report")
    wr.write_documents(documents, path)
    found = sorted((r["kind"], r["document"]) for r in rd.read_documents(spark, path).collect())
    assert found == sorted((r["kind"], r["document"]) for r in documents.collect())
    assert [k for k, _ in found].count("summary") == 1
    with pytest.raises(Exception, match="already exists"):
        wr.write_documents(documents, path)
