import pytest
from pyspark.sql import functions as F

from parapet.functions.risk import risk_reason
from parapet.operators import filters as fl
from parapet.operators import incidents as inc
from parapet.operators import listing as ls
from parapet.operators import metrics as mt
from parapet.operators.audit import with_time
from parapet.operators.normalize import empty_audit
from parapet.schemas import AUDIT_COLUMNS, AUDIT_SCHEMA

AS_OF = "2024-01-10T12:00:00"


def audit_rows(spark, rows):
    """Rows of the audit table from partial mappings."""
    defaults = {
        "timestamp": "2024-01-01T00:00:00", "input_text": "in", "output_text": "out",
        "toxicity_score": 0.0, "sentiment_score": 0.0, "has_pii": False, "is_refusal": False,
        "self_harm": False, "jailbreak": False, "bias": False, "flagged": False,
        "risk_labels": [], "risk_explanations": [], "pii_types": [], "tags": [],
        "redaction_applied": False, "redaction_count": 0,
    }
    full = [{**defaults, "id": i, **r} for i, r in enumerate(rows)]
    schema = [f for f in AUDIT_SCHEMA.fields if f.name in AUDIT_COLUMNS]
    table = [tuple(r.get(f.name) for f in schema) for r in full]
    return with_time(spark.createDataFrame(table, type(AUDIT_SCHEMA)(schema)))


@pytest.fixture(scope="module")
def table(spark):
    return audit_rows(
        spark,
        [
            {"flagged": True, "risk_labels": ["pii", "bias"], "risk_explanations": ["e0", "x"],
             "tags": ["a", "b"], "project_name": "p", "toxicity_score": 0.2,
             "timestamp": "2024-01-02T10:00:00"},
            {"risk_labels": ["refusal"], "is_refusal": True, "tags": ["b"], "user_id": "u",
             "toxicity_score": 0.4, "timestamp": "2024-01-02T23:59:59.5"},
            {"flagged": True, "risk_labels": ["pii"], "project_name": "", "has_pii": True,
             "output_text": "Fifty 50% off_now", "toxicity_score": 1.0,
             "timestamp": "2024-01-05T00:00:00", "risk_explanations": []},
            {"toxicity_score": 0.0, "timestamp": "junk", "tags": ["A"]},
            {"toxicity_score": 1.5, "timestamp": "2024-01-05T00:00:00", "flagged": True,
             "risk_labels": ["bias"], "risk_explanations": ["e4"], "bias": True},
            {"toxicity_score": float("nan"), "timestamp": "2024-01-10T11:00:00"},
        ],
    ).cache()


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_search_wildcards(table):
    assert ids(fl.AuditFilter(search="50% OFF").apply(table)) == [2]
    assert ids(fl.AuditFilter(search="F_fty").apply(table)) == [2]
    assert ids(fl.AuditFilter(search="off\\_now").apply(table)) == []
    assert ids(fl.AuditFilter(search="IN").apply(table)) == [0, 1, 2, 3, 4, 5]


def test_list_filters_all_and_any(table):
    assert ids(fl.AuditFilter(tag="a, b").apply(table)) == [0]
    assert ids(fl.AuditFilter(tag="b").apply(table)) == [0, 1]
    assert ids(fl.AuditFilter(risk_label="pii,bias").apply(table)) == [0]
    assert ids(fl.BoardFilter(risk_labels=("pii", "bias")).apply(table)) == [0, 2, 4]
    assert ids(fl.BoardFilter(tags=("a", "A")).apply(table)) == [0, 3]


def test_scalar_filters(table):
    assert ids(fl.AuditFilter(flagged=False).apply(table)) == [1, 3, 5]
    assert ids(fl.AuditFilter(project_name="p", user_id="").apply(table)) == [0]
    assert ids(fl.BoardFilter(statuses=("Flagged",)).apply(table)) == [0, 2, 4]
    assert ids(fl.BoardFilter(min_toxicity=0.4).apply(table)) == [1, 2, 4]
    assert ids(fl.BoardFilter(pii_only=True).apply(table)) == [2]
    assert ids(fl.BoardFilter(refusal_only=True).apply(table)) == [1]
    assert ids(fl.BoardFilter(search="^FIFTY").apply(table)) == [2]
    assert ids(table.filter(fl.present("project_name"))) == [0]
    assert ids(ls.by_id(table, 3)) == [3]
    assert ids(fl.AuditFilter().apply(table)) == [0, 1, 2, 3, 4, 5]


def test_date_filters(table):
    assert ids(fl.AuditFilter(start_date="2024-01-02", end_date="2024-01-02").apply(table)) == [
        0, 1]
    # lexical comparison: "junk" sorts behind every ISO time
    assert ids(fl.AuditFilter(start_date="2024-01-05").apply(table)) == [2, 3, 4, 5]
    pruned = fl.AuditFilter(start_date="2024-01-05", prune_days=True).apply(table)
    assert ids(pruned) == [2, 4, 5]
    assert ids(fl.BoardFilter(dates=("2024-01-02", "2024-01-05")).apply(table)) == [0, 1, 2, 4]


def test_histogram_edges(table):
    counts = {r["toxicity_bin"]: r["count"] for r in mt.toxicity_histogram(table).collect()}
    # 0.2 and 0.4 close their bins, 1.5 and NaN lie outside
    assert counts == {"(-0.001, 0.2]": 2, "(0.2, 0.4]": 1, "(0.4, 0.6]": 0, "(0.6, 0.8]": 0,
                      "(0.8, 1.0]": 1}


def test_daily_volume_fills_gaps(table):
    rows = {str(r["day"]): r["count"] for r in mt.daily_volume(table).collect()}
    assert rows == {"2024-01-02": 2, "2024-01-03": 0, "2024-01-04": 0, "2024-01-05": 2,
                    "2024-01-06": 0, "2024-01-07": 0, "2024-01-08": 0, "2024-01-09": 0,
                    "2024-01-10": 1}


def test_counts_and_shares(table):
    counts = {r["label"]: r["count"] for r in mt.label_counts(table).collect()}
    assert counts == {"pii": 2, "bias": 2, "refusal": 1}
    shares = {r["signal"]: r["percent"] for r in mt.signal_breakdown(table).collect()}
    assert shares == {"pii": 40.0, "bias": 40.0, "refusal": 20.0}
    widths = {r["label"]: r["width"] for r in mt.label_bars(table).collect()}
    assert widths == {"pii": 100, "bias": 100, "refusal": 50}
    many = audit_rows(table.sparkSession, [{"risk_labels": ["pii"]}] * 50
                      + [{"risk_labels": ["bias"]}])
    assert {r["label"]: r["width"] for r in mt.label_bars(many).collect()} == {
        "pii": 100, "bias": 8}


def test_recent_and_overview(table):
    row = mt.overview(table.filter("id <> 5"), AS_OF).first()
    assert row["total"] == 5 and row["flagged"] == 3 and row["flagged_rate"] == 0.6
    assert row["latest_timestamp"] == "junk" and row["pii_rate"] == 0.2
    # "junk" also sorts behind the cutoff
    assert mt.overview(table, AS_OF).first()["recent_24h"] == 2


def test_empty_table(spark):
    empty = empty_audit(spark)
    row = mt.overview(empty, AS_OF).first().asDict()
    assert row.pop("latest_timestamp") is None
    assert set(row.values()) == {0, 0.0}
    assert mt.daily_volume(empty).count() == 0 and mt.label_counts(empty).count() == 0
    assert [r["count"] for r in mt.toxicity_histogram(empty).collect()] == [0] * 5
    document = mt.metrics_document(empty, AS_OF).first()
    assert document["total"] == 0 and document["risk_counts"] == {}
    assert ls.page(empty).count() == 0 and ls.late_rows(empty, ls.page(empty)).count() == 0
    assert ls.page_count(empty, 20).first() == (0, 1)


def test_documents(table):
    document = mt.metrics_document(table, AS_OF).first()
    assert document["risk_counts"] == {"pii": 2, "bias": 2, "refusal": 1}
    meta = mt.meta_document(table).first()
    assert meta["projects"] == ["p"] and meta["users"] == ["u"] and meta["models"] == []
    assert meta["tags"] == ["A", "a", "b"]


def test_kpis(table):
    row = mt.kpis(table.filter("id < 3")).first()
    assert row == (3, 2, "33.3%", "0.0%", "0.533")
    assert mt.shown_of_total(table, F.col("has_pii")).first() == (1, 6)


def test_pages(table):
    order = [r["id"] for r in table.orderBy(*ls.newest_first()).collect()]
    assert order == [3, 5, 4, 2, 1, 0]
    assert [r["id"] for r in ls.page(table, 2, 2).collect()] == [4, 2]
    assert [r["id"] for r in ls.page_after(table, "2024-01-05T00:00:00", 4, 2).collect()] == [2, 1]
    assert [r["id"] for r in ls.late_rows(table, ls.page(table, 1, 4)).collect()] == [3, 5, 4, 2]
    assert [r["id"] for r in ls.latest(table, limit=-5).collect()] == [3]
    assert ls.page_count(table, 4).first() == (6, 2)
    for bad in ((0, 10), (1, 0), (1, 201)):
        with pytest.raises(ValueError):
            ls.page(table, *bad)


def test_page_plan_keeps_top_rows_only(table):
    plan = ls.page(table, 2, 25)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=50, offset=25" in plan and "Exchange" not in plan


def test_display(table):
    row = ls.record_details(table.filter("id = 0")).first()
    assert row["model_name"] == "N/A" and row["tags"] == "a, b"
    assert row["risk_reason"] == "PII, Bias" and row["redaction_note"] is None
    assert len(ls.display_rows(table).columns) == 15
    reasons = table.select("id", risk_reason(F.col("risk_labels")).alias("r")).collect()
    assert {r["id"]: r["r"] for r in reasons}[3] == "None"
    top = ls.flagged_of_page(ls.page(table)).collect()
    assert [(r["id"], r["project"], r["explanation"]) for r in top] == [
        (4, "-", "e4"), (2, "-", "No explanation provided"), (0, "p", "e0")]


def test_timeline_and_breakdown(table):
    lines = {r["id"]: r["line"] for r in inc.timeline(table).collect()}
    assert lines[0] == "- 2024-01-02T10:00:00 | #0 | pii, bias | e0"
    assert lines[2] == "- 2024-01-05T00:00:00 | #2 | pii | "
    assert set(lines) == {0, 2, 4}
    counts = {r["label"]: r["count"] for r in inc.risk_breakdown(table).collect()}
    assert counts == {"pii": 2, "bias": 2}


def test_report_text(table, tmp_path):
    from parapet.sources.writers import write_report

    lines = inc.report_lines(table, "NOW", limit=2)
    target = str(tmp_path / "report")
    write_report(lines, target)
    text = "\n".join(r[0] for r in table.sparkSession.read.text(target, wholetext=True).collect())
    assert text.startswith("# Incident Report\n_Generated (UTC): NOW_\n\n## Summary\n")
    assert "- Records reviewed: 2\n- Flagged incidents: 2\n\n## Filters\n" in text
    assert "- flagged_only: True\n- limit: 2\n\n## Risk Breakdown\n- bias: 1\n- pii: 1\n" in text
    assert text.index("### Incident #4") < text.index("### Incident #2")
    assert "- Explanations:\n  - None\n- Input:\n  ```\nin\n  ```\n- Output:\n" in text


def test_report_without_incidents(table):
    lines = inc.report_lines(table, "NOW", flagged_only=False, user_id="u")
    text = [r["line"] for r in lines.orderBy("section", "rank", "part").collect()]
    assert "- Records reviewed: 1" in text and "- flagged_only: False" in text
    assert "- No flagged records in selected scope" in text
    assert "- No incidents available." in text and text[-1] == "No flagged cases to report."
    with pytest.raises(ValueError):
        inc.select_incidents(table, limit=2001)


def test_report_documents(table):
    rows = inc.report_documents(table, "NOW", limit=10).collect()
    assert sorted(r["kind"] for r in rows) == ["record"] * 3 + ["summary"]
    summary = next(r for r in rows if r["kind"] == "summary")["document"]
    assert summary == (
        '{"generated_at":"NOW","count":3,"filters":{"flagged_only":"True","limit":"10"}}'
    )
