"""Quality rules: base counts and robust multivariate outliers per language and source.

Everything here is DataFrame operations; no Python code runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import SPACES, let, sent_if_few, words
from parapet.session import cut_lineage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30

#: Transformed statistics are kept as whole thousandths, so that sums are exact in any order.
SCALE = 1000
#: The least standard deviation of each statistic, in the order of ``STATISTICS``: log word length, and logs of
#: symbols, repeated lines and repeated words per hundred words.
FLOORS = (0.07, 0.6, 0.6, 1.0)
STATISTICS = ("x1", "x2", "x3", "x4")
#: Half of a group's rows have to agree: the largest share of outliers that can be borne.
SUPPORT = 0.5
STEPS = 4
#: Turns the covariance of the nearer half of four normal variables into that of all:
#: the half over the chi-square probability with six degrees of freedom of the four-degree median.
CONSISTENCY = 2.1146
#: Squared distance beyond which a row is an outlier: the 0.9999 quantile of chi-square with four degrees.
CUTOFF = 23.513
#: Distances are compared in steps of this part of a standard deviation.
BINS = 64


def _repeated_words(text_words: Column) -> Column:
    """Number of words inside windows of eight words that occur twice or more in the array."""

    def covered(ordered: Column) -> Column:
        def again(x, i):
            before = F.get(ordered, i - 1)["h"] == x["h"]
            after = F.get(ordered, i + 1)["h"] == x["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        starts = F.array_sort(F.transform(F.filter(ordered, again), lambda x: x["i"]))
        return let(starts, lambda at: F.aggregate(
            F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0), lambda a, b: a + b,
        ))

    def repeats(windows: Column) -> Column:
        pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(F.array_sort(pairs), covered)
        )

    def all_windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    counted = let(
        F.transform(text_words, lambda w: F.xxhash64(w)), lambda hashes: let(all_windows(hashes), repeats)
    )
    return F.when(F.size(text_words) >= WINDOW, counted).otherwise(F.lit(0))


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACES, "") != "")

    def measure(own: Column) -> Column:
        return F.struct(F.size(own).cast("long").alias("n"), _repeated_words(own).cast("long").alias("r"))

    # A generator of one row keeps the optimizer from repeating the counts where they are used.
    rows = docs.withColumn("_m", F.explode(F.array(let(words(F.col("text")), measure))))
    rows = rows.withColumns({
        "n_words": F.col("_m.n"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("_m.r"),
    }).drop("_m")
    few = F.col("n_words") < MIN_WORDS
    return rows.withColumn(
        "base_failed", few | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    )


def statistics(rows: DataFrame) -> DataFrame:
    """Add the transformed statistics ``x1`` to ``x4`` of rows that have words."""

    def thousandths(value: Column) -> Column:
        return F.round(value * SCALE).cast("long")

    def per_hundred(name: str) -> Column:
        return thousandths(F.log(1 + F.try_divide(100 * F.col(name), F.col("n_words"))))

    return rows.withColumns({
        "x1": thousandths(F.log(F.try_divide(F.col("word_chars"), F.col("n_words")))),
        "x2": per_hundred("n_symbols"),
        "x3": per_hundred("n_dup_lines"),
        "x4": per_hundred("n_repeat_words"),
    })


#: Groups whose estimates are sent to all tasks; 20 numbers each, so about ten megabytes. More are joined by shuffle.
BROADCAST_GROUPS = 50_000


def _with_groups(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """Join stored values of each key; with few enough keys, rows stay where they are."""
    return rows.join(sent_if_few(groups, BROADCAST_GROUPS), "key", how)


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATISTICS)) for j in range(i + 1)]


def _squared_distance() -> Column:
    """The Mahalanobis distance, by forward substitution with the lower factor ``l``."""
    solved: list[Column] = []
    for i, x in enumerate(STATISTICS):
        rest = F.col(x) / SCALE - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l{i}{i}"))
    total = solved[0] * solved[0]
    for value in solved[1:]:
        total = total + value * value
    return total


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and the floors as a diagonal covariance."""
    first = rows.groupBy("key").agg(
        *[(F.percentile(x, F.lit(0.5)) / SCALE).alias(f"m{i}") for i, x in enumerate(STATISTICS)]
    )
    factor = {f"l{i}{j}": F.lit(FLOORS[i] if i == j else 0.0) for i, j in _pairs()}
    return first.withColumns(factor)


def _estimate(near: DataFrame) -> DataFrame:
    """Mean and lower factor of the regularised covariance of each group."""
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(STATISTICS)]
    sums += [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"s{i}{j}") for i, j in _pairs()]
    found = near.groupBy("key").agg(F.count("*").cast("double").alias("n"), *sums)
    means = {f"m{i}": F.col(f"s{i}") / F.col("n") / SCALE for i in range(len(STATISTICS))}
    spread = {}
    for i, j in _pairs():
        own = F.col(f"s{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * (F.col(f"s{j}") / F.col("n"))
        own = own / (SCALE * SCALE) * CONSISTENCY
        spread[f"c{i}{j}"] = F.greatest(own, F.lit(0.0)) + FLOORS[i] * FLOORS[i] if i == j else own
    found = found.withColumns(means).withColumns(spread)
    for i, j in _pairs():  # Cholesky, row by row
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        found = found.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    return found.select("key", *means, *[f"l{i}{j}" for i, j in _pairs()])


def minimum_covariance(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Robust mean and covariance factor per ``key``: a regularised minimum covariance determinant.

    From medians and floors on, each concentration step takes the half of a group's rows that is nearest
    by the last estimate, and estimates mean and covariance from that half; no such step raises the
    determinant. The half ends at a step of ``1 / BINS`` of a deviation, with all rows on that step,
    so it depends on neither order nor partitions, and tables of distances have bounded size.
    """
    estimate = cut_lineage(_start(rows), "estimate")
    for _ in range(steps):
        far = _with_groups(rows, estimate).select(
            "key", *STATISTICS, F.floor(F.sqrt(_squared_distance()) * BINS).alias("bin")
        )
        # Counts by step first: then the median needs one row for each step and not each row.
        bounds = far.groupBy("key", "bin").agg(F.count("*").alias("many"))
        bounds = bounds.groupBy("key").agg(F.percentile("bin", F.lit(SUPPORT), F.col("many")).alias("most"))
        near = _with_groups(far, cut_lineage(bounds, "bounds")).filter("bin <= most")
        estimate = cut_lineage(_estimate(near), "estimate")
    return estimate


def judged(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """Counts of each document and the verdict ``kept``, with ``distance`` (squared; null if base failed).

    Rows that pass the base rules are measured against the robust estimate of their language and source, and
    rejected beyond ``cutoff``. Null is a language or source of its own. A null or empty text has
    no words and fails the base rules; groups of one row or of equal rows keep them, as the floors keep
    covariances regular; repeated rows are judged each; an empty table gives no rows. Of the other
    columns only ``doc_id`` is returned.
    """
    key = F.to_json(F.struct("lang", "source"))
    rows = counts(docs.select("doc_id", key.alias("key"), "text")).drop("text")
    rows = cut_lineage(statistics(rows), "statistics")
    estimate = minimum_covariance(rows.filter("not base_failed").select("key", *STATISTICS), steps)
    known = _with_groups(rows, estimate, "left")
    distance = F.when(~F.col("base_failed"), _squared_distance())
    return known.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(distance <= cutoff, F.lit(False)).alias("kept"), distance.alias("distance"),
    )


def accepted(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns."""
    key = F.to_json(F.struct("lang", "source"))
    marks = [f"_{x}" for x in STATISTICS]
    rows = statistics(counts(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("key"), "text")))
    rows = cut_lineage(rows.filter("not base_failed").select("_row", "key", *STATISTICS), "statistics")
    estimate = minimum_covariance(rows.select("key", *STATISTICS), steps)
    kept = _with_groups(rows, estimate).filter(_squared_distance() <= cutoff)
    return kept.select("_row.*")
