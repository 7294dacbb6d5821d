"""Risk labels, explanations and their display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet import lexicon as lx
from parapet.functions.text import fixed


def is_toxic(score: Column, threshold: float) -> Column:
    # NaN sorts above every number in Spark, yet must not count as toxic
    return F.coalesce((score >= threshold) & ~F.isnan(score), F.lit(False))


def label_array(fired: dict[str, Column]) -> Column:
    """Ordered label array from one boolean per label."""
    return F.array_compact(F.array(*[F.when(fired[n], F.lit(n)) for n in lx.RISK_LABELS]))


def is_flagged(labels: Column) -> Column:
    return F.arrays_overlap(labels, F.array(*[F.lit(n) for n in lx.TRIGGER_LABELS]))


def explanation_array(
    score: Column,
    threshold: float,
    toxic: Column,
    pii_types: Column,
    refusal: Column,
    self_harm: Column,
    jailbreak: Column,
    bias: Column,
) -> Column:
    """Ordered explanations; the last four arguments are the matched evidence."""

    def quoted(start: str, match: Column) -> Column:
        # null evidence makes the whole concat null, which array_compact drops
        return F.concat(F.lit(f"{start}: '"), match, F.lit("'"))

    # The message formats
    messages = {
        "toxicity": F.when(
            toxic,
            F.concat(F.lit("toxicity_score "), fixed(score, 2), F.lit(f" >= {threshold:.2f}")),
        ),
        "pii": F.when(
            F.size(pii_types) > 0,
            F.concat(F.lit("PII detected ("), F.array_join(pii_types, ", "), F.lit(")")),
        ),
        "refusal": quoted("refusal phrase matched", refusal),
        "self_harm": quoted("self-harm keyword matched", self_harm),
        "jailbreak": quoted("jailbreak phrase matched", jailbreak),
        "bias": quoted("bias match", bias),
    }
    return F.array_compact(F.array(*[messages[n] for n in lx.EXPLANATION_ORDER]))


def status_label(flagged: Column) -> Column:
    return F.when(flagged, F.lit("Flagged")).otherwise(F.lit("Safe"))


def titles(labels: Column, names: dict[str, str] = lx.RISK_TITLES) -> Column:
    """Label names as display titles; unknown labels stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform(labels, lambda x: F.coalesce(F.try_element_at(table, x), x))


def risk_reason(labels: Column) -> Column:
    """Titles joined by commas, or ``None`` for an empty or missing list."""
    joined = F.array_join(titles(labels), ", ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("None"))
