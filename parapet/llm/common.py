"""What several of the operators share: words, text blocks, exact ranks over many tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters between words: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of an order hash, and rows that one task ranks at a time.
ORDER_BITS = 60
CELL_ROWS = 1 << 14

#: Characters that Python code works on at a time.
BLOCK_CHARS = 1 << 21


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none if it is null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside a lambda Spark would compute an outer expression again for each element;
    a one-element array binds it to a name first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def sent_if_few(df: DataFrame, most: int) -> DataFrame:
    """A stored table marked for broadcast if it has at most ``most`` rows; else joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key``, a 64-bit hash, may be among ``keys``; few of the others pass.

    For what goes to a join without rows that find nothing there. The leading bits of the keys are marked in at most 2**20
    words of 64 bits, sixteen bits a key up to four million keys; beyond, more rows pass, and the join drops them as ever.
    """
    bits = min(20, max(4, math.ceil(math.log2(max(1, keys.count()) / 4))))
    word = F.shiftrightunsigned(F.col(key), 64 - bits)
    bit = F.shiftrightunsigned(F.col(key), 58 - bits).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    marks = keys.groupBy(word.alias("_word")).agg(F.bit_or(one).alias("_marks"))
    marked = F.call_function("shiftrightunsigned", F.col("_marks"), bit).bitwiseAND(F.lit(1)) == 1
    return df.withColumn("_word", word).join(F.broadcast(marks), "_word").filter(marked).drop("_word", "_marks")


def order_hash(*columns: Column) -> Column:
    """A number of ``ORDER_BITS`` bits that puts rows into an even, repeatable order."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - ORDER_BITS)


def spread_repeats(df: DataFrame, group: list[str], order: str, row: str) -> DataFrame:
    """Give rows of a much repeated ``order`` value places all over the range.

    Rows with one key share an order value, so ``ranked`` could not split them. Values of more
    than ``CELL_ROWS`` rows in a group get a value from ``row``, a number of the row. The table of
    such values has at most one row for each ``CELL_ROWS`` of ``df``.
    """
    keys = [*group, order]
    often = df.groupBy(*keys).count().filter(F.col("count") > CELL_ROWS).drop("count")
    df = df.join(often.withColumn("_often", F.lit(True)), keys, "left")
    own = F.when(F.col("_often"), order_hash(F.col(order), F.col(row))).otherwise(F.col(order))
    return df.withColumn(order, own).drop("_often")


def ranked(
    df: DataFrame, group: list[str], order: str, ties: list[str], rows: int, size: str | None = None
) -> DataFrame:
    """Add ``rank`` (from 0) and, given ``size``, ``before`` (sum over earlier rows).

    Rows are ordered within ``group`` by ``order`` (see ``order_hash``), then ``ties``. A group is cut
    into cells by the leading bits of ``order``, so that no task ranks a whole large group:
    rows are ranked within cells, and cells get the totals of the cells before them.
    ``group`` must not be null; ``rows`` is the number of rows, for the number of cells.
    """
    bits = max(8, math.ceil(math.log2(max(1, rows) / CELL_ROWS)))
    df = df.withColumn("_cell", F.shiftrightunsigned(F.col(order), ORDER_BITS - bits))
    keys = [*group, "_cell"]
    inside = Window.partitionBy(*keys).orderBy(order, *ties)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    cells = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    total = [F.count(F.lit(1)).alias("_n")] + ([F.sum(size).alias("_s")] if size else [])
    starts = df.groupBy(*keys).agg(*total)
    starts = starts.select(
        *keys,
        F.coalesce(F.sum("_n").over(cells), F.lit(0)).alias("_n"),
        *([F.coalesce(F.sum("_s").over(cells), F.lit(0)).alias("_s")] if size else []),
    )
    df = df.withColumn("_r", F.row_number().over(inside) - 1)
    if size:
        df = df.withColumn("_b", F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    df = df.join(starts, keys).withColumn("rank", F.col("_n") + F.col("_r"))
    if size:
        df = df.withColumn("before", F.col("_s") + F.col("_b")).drop("_s", "_b")
    return df.drop("_cell", "_r", "_n")


def blocks(lengths: list[int], most: int = BLOCK_CHARS, rows: int = 1 << 30) -> Iterator[slice]:
    """Cut a batch into runs of rows of about ``most`` characters and at most ``rows`` rows.

    A longer row stands alone.
    """
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (held + n > most or i - start >= rows):
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def mixed(x: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of each unsigned 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
