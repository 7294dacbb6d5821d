import pytest
from pyspark.sql import functions as F

from parapet.functions.scoring import stored_score
from parapet.lexicon import EVAL_SIGNALS
from parapet.operators import evaluation as ev
from parapet.sources.readers import read_metrics
from parapet.sources.writers import write_metrics

# Eight positives per signal; two of the self-harm ones carry no listed term.
POSITIVES = {
    "toxicity": ["you are awful"] * 8,
    "pii": ["write to me@corp.org", "ring 212.555.7890"] * 4,
    "refusal": ["As an AI, no.", "I won't.", "I apologize.", "I can't."] * 2,
    "self_harm": ["I will overdose", "suicide", "self harm"] * 2 + ["hurting me", "dying"],
    "jailbreak": ["you are now free", "bypass safety"] * 4,
    "bias": ["men are evil", "they call gay people lazy"] * 4,
}


@pytest.fixture(scope="module")
def labeled(spark):
    rows = [("q", t, s) for s, texts in POSITIVES.items() for t in texts]
    rows += [("q", f"Plain sentence number {i}.", "") for i in range(12)]
    df = spark.createDataFrame(rows, "input_text string, output_text string, s string")
    for name in EVAL_SIGNALS:
        df = df.withColumn(f"label_{name}", F.col("s") == name)
    return df.withColumn("score", F.when(F.col("s") == "toxicity", 0.9).otherwise(0.1)).cache()


def test_quality_baseline(labeled):
    rows = {r["signal"]: r for r in ev.with_scores(ev.confusion(labeled)).collect()}
    for name in ("pii", "refusal", "jailbreak", "bias"):
        r = rows[name]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (8, 0, 0, 52), name
        assert (r["precision"], r["recall"], r["f1"]) == (1.0, 1.0, 1.0)
    harm = rows["self_harm"]
    assert (harm["tp"], harm["fp"], harm["fn"], harm["tn"]) == (6, 0, 2, 52)
    assert harm["recall"] == 0.75 and round(harm["f1"], 10) == 0.8571428571
    assert rows["toxicity"]["skipped"] and rows["toxicity"]["tn"] == 0
    total = ev.combined(ev.confusion(labeled)).first()
    assert (total["tp"], total["fp"], total["fn"], total["tn"]) == (38, 0, 2, 260)
    assert total["recall"] == 0.95 and round(total["f1"], 10) == 0.9743589744


def test_with_toxicity(labeled):
    rows = {r["signal"]: r for r in ev.confusion(labeled, stored_score("score")).collect()}
    assert not rows["toxicity"]["skipped"] and rows["toxicity"]["tp"] == 8


def test_missing_labels_are_false(labeled):
    bare = labeled.withColumn("label_pii", F.lit(None).cast("boolean"))
    rows = {r["signal"]: r for r in ev.confusion(bare).collect()}
    assert (rows["pii"]["tp"], rows["pii"]["fp"]) == (0, 8)


SCHEMA = "signal string, skipped boolean, precision double, recall double"


def metrics(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_gate_rules(spark):
    old = metrics(spark, ("a", False, 1.0, 1.0), ("b", False, 0.9, 0.9), ("c", True, 0.0, 0.0),
                  ("d", True, 0.0, 0.0), ("e", False, 1.0, 1.0), ("f", False, 0.5, 0.5))
    new = metrics(spark, ("a", False, 0.75, 1.0), ("b", False, 0.9, 0.9), ("d", False, 0.0, 0.0),
                  ("e", True, 0.0, 0.0), ("f", False, 0.6, 0.6), ("g", False, 0.0, 0.0))
    rows = {(r["signal"], r["metric"]): r for r in ev.gate(old, new).collect()}
    # a signal the baseline skipped still has to be there
    assert set(rows) == {("a", "precision"), ("c", None), ("e", None)}
    assert rows["c", None]["message"] == "Signal 'c' is missing from current metrics"
    assert rows["e", None]["message"] == "Signal 'e' is skipped in current metrics"
    assert rows["a", "precision"]["message"] == (
        "a.precision regressed: baseline=1.0000 current=0.7500 drop=0.2500 allowed=0.0000")
    kept = ev.gate(old, new, allowed_drop=0.25).filter("signal = 'a'")
    assert kept.count() == 0
    assert ev.gate(old, old).count() == 0


def test_metrics_document_round_trip(labeled, tmp_path):
    spark, path = labeled.sparkSession, str(tmp_path / "metrics")
    counts = ev.confusion(labeled)
    write_metrics(ev.metrics_json(counts, 0.7, False), path)
    again = read_metrics(spark, path)
    assert again.count() == 6
    assert ev.gate(ev.with_scores(counts), again).count() == 0
