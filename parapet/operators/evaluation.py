"""Detector quality against labels, and the gate against a stored baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions.risk import is_toxic
from parapet.functions.scoring import Scorer, no_score
from parapet.lexicon import EVAL_SIGNALS, TOXICITY_THRESHOLD
from parapet.operators.audit import detect
from parapet.operators.metrics import beside

_PREDICTIONS = {
    "pii": "has_pii",
    "refusal": "is_refusal",
    "self_harm": "self_harm",
    "jailbreak": "jailbreak",
    "bias": "bias",
}


def predict(
    df: DataFrame,
    toxicity: Scorer | None = None,
    threshold: float = TOXICITY_THRESHOLD,
    text: str = "output_text",
) -> DataFrame:
    """Replace the texts by one ``guess_<signal>`` flag each.

    Labels that live in another table should be joined to this narrow result, so that
    the join does not move the texts. Without a toxicity scorer that guess is null.
    """
    found = detect(df, text, toxicity or no_score)
    guesses = {n: F.col(c) for n, c in _PREDICTIONS.items()}
    toxic = is_toxic(F.col("toxicity_score"), threshold)
    guesses["toxicity"] = F.lit(None).cast("boolean") if toxicity is None else toxic
    kept = [c for c in df.columns if c not in (text, "input_text")]
    return found.select(*kept, *[g.alias(f"guess_{n}") for n, g in guesses.items()])


def count_guesses(df: DataFrame, skip_toxicity: bool) -> DataFrame:
    """``(signal, skipped, tp, fp, tn, fn)`` from ``guess_`` and ``label_`` flags.

    All counts of all signals come from one aggregate row, turned upright at the
    end, so rows are not multiplied by the number of signals before the shuffle.
    """
    counts, cells = [], []
    for name in EVAL_SIGNALS:
        if name == "toxicity" and skip_toxicity:
            cells.append("'toxicity', true, 0L, 0L, 0L, 0L")
            continue
        guess = F.col(f"guess_{name}")
        truth = F.coalesce(F.col(f"label_{name}"), F.lit(False))
        for cell, hit in (
            ("tp", guess & truth),
            ("fp", guess & ~truth),
            ("tn", ~guess & ~truth),
            ("fn", ~guess & truth),
        ):
            counts.append(F.count_if(hit).alias(f"{name}_{cell}"))
        cells.append(f"'{name}', false, {name}_tp, {name}_fp, {name}_tn, {name}_fn")
    return _upright(df.agg(*counts), cells)


def confusion(
    labeled: DataFrame,
    toxicity: Scorer | None = None,
    threshold: float = TOXICITY_THRESHOLD,
    text: str = "output_text",
) -> DataFrame:
    """Confusion counts of rows that carry their labels; toxicity is skipped if unscored."""
    return count_guesses(predict(labeled, toxicity, threshold, text), toxicity is None)


def _upright(row: DataFrame, cells: list[str]) -> DataFrame:
    return row.selectExpr(
        f"stack({len(cells)}, {', '.join(cells)}) as (signal, skipped, tp, fp, tn, fn)"
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def with_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1; 0 where a denominator is 0."""
    both = F.col("precision") + F.col("recall")
    return counts.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    ).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both))


def combined(counts: DataFrame) -> DataFrame:
    """Micro-averaged scores over the signals that were not skipped."""
    kept = counts.filter(~F.col("skipped"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "tn", "fn")]
    return with_scores(kept.agg(*sums)).select(
        F.lit("combined").alias("signal"),
        F.lit(False).alias("skipped"),
        "tp", "fp", "tn", "fn", "precision", "recall", "f1",
    )


def metrics_json(counts: DataFrame, threshold: float, enable_toxicity: bool) -> DataFrame:
    """The nested metrics document, one row; ``counts`` has one row per signal."""
    fields = ["skipped", "tp", "fp", "tn", "fn", "precision", "recall", "f1"]
    scored = with_scores(counts)
    entry = F.struct("signal", F.struct(*fields))
    nested = scored.agg(F.map_from_entries(F.collect_list(entry)).alias("signals"))
    total = combined(counts).select(F.struct(*fields).alias("combined"))
    return beside(nested, total).withColumns(
        {"threshold": F.lit(threshold), "enable_toxicity": F.lit(enable_toxicity)}
    )


def gate(baseline: DataFrame, current: DataFrame, allowed_drop: float = 0.0) -> DataFrame:
    """Failures of the current metrics against the baseline; no rows means passed.

    A signal fails when it is missing or skipped now, or when its precision or
    recall fell by more than ``allowed_drop``. Signals the baseline skipped pass,
    unless they are missing. A baseline without signals is an error, not a pass.
    """
    if baseline.isEmpty():
        raise ValueError("the baseline holds no signals")
    old = baseline.select(
        "signal",
        F.col("skipped").alias("old_skipped"),
        F.col("precision").alias("old_precision"),
        F.col("recall").alias("old_recall"),
    )
    new = current.select("signal", "skipped", "precision", "recall", F.lit(1).alias("found"))
    joined = old.join(new, "signal", "left")
    missing = F.col("found").isNull()
    skipped = F.coalesce("skipped", F.lit(False))
    judged = joined.filter(missing | ~F.coalesce("old_skipped", F.lit(False)))

    def check(metric: str) -> Column:
        before = F.coalesce(f"old_{metric}", F.lit(0.0))
        after = F.coalesce(metric, F.lit(0.0))
        return F.struct(
            F.lit(metric).alias("metric"),
            before.alias("baseline"),
            after.alias("current"),
            (before - after).alias("drop"),
            F.lit("regressed").alias("reason"),
        )

    def whole(reason: str) -> Column:
        none = F.lit(None).cast("double")
        return F.array(
            F.struct(
                F.lit(None).cast("string").alias("metric"),
                none.alias("baseline"),
                none.alias("current"),
                none.alias("drop"),
                F.lit(reason).alias("reason"),
            )
        )

    drops = F.filter(
        F.array(check("precision"), check("recall")), lambda x: x["drop"] > allowed_drop
    )
    failures = F.when(missing, whole("missing")).when(skipped, whole("skipped")).otherwise(drops)
    rows = judged.select("signal", F.inline(failures))
    numbers = F.format_string(
        "%s.%s regressed: baseline=%.4f current=%.4f drop=%.4f allowed=%.4f",
        "signal", "metric", "baseline", "current", "drop", F.lit(allowed_drop),
    )
    state = F.concat(F.lit("Signal '"), "signal", F.lit("' is "), "reason")
    state = F.concat(state, F.lit(" "), F.when(F.col("reason") == "missing", "from").otherwise("in"))
    return rows.withColumns(
        {
            "allowed": F.lit(allowed_drop),
            "message": F.when(F.col("reason") == "regressed", numbers).otherwise(
                F.concat(state, F.lit(" current metrics"))
            ),
        }
    )
