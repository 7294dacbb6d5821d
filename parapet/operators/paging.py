"""Jumping to any page of the listing by an index of row counts.

A page's place is found by descending a tree of counts: days, hours, minutes, and finer where many rows
share a minute. Only the rows of the leaves that hold the page are read and sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.lexicon import PAGE_SIZE_MAX
from parapet.operators.listing import newest_first

#: Rows that a leaf may hold before it is cut finer.
LEAF_ROWS = 100_000
#: Letters of the key that tell day, hour, minute, second, millisecond, microsecond and whole time apart.
_LEVELS = (11, 14, 17, 20, 24, 27, 1 << 20)
_FIRST_LEAF = 2
_BLOCK_BITS = 16
#: Behind every text that begins with what stands before it.
_LAST = "\U0010ffff"

INDEX_SCHEMA = "audit_date date, bucket string, block bigint, rows bigint, flagged bigint"


def _key() -> Column:
    """The stored time in an order of its own: missing ones behind all others."""
    return F.coalesce(F.concat(F.lit("1"), F.col("timestamp")), F.lit("0"))


def page_counts(df: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows, and flagged ones, by day and leaf: a beginning of the time, and a block of ids where that is all of it.

    Counts combine per task. Minutes of more than ``leaf_rows`` rows are counted again by second, those of
    more by millisecond, and so on, and at last by block of 65,536 ids. A table without such minutes is
    read once, two narrow columns wide.
    """
    counts = [F.count("*").alias("rows"), F.count_if("flagged").alias("flagged")]
    rows = df.select("audit_date", _key().alias("_key"), "id", "flagged")
    leaves: list[DataFrame] = []
    for level in _LEVELS[_FIRST_LEAF:]:
        bucket = F.left("_key", F.lit(level)).alias("bucket")
        found = rows.groupBy("audit_date", bucket).agg(*counts)
        leaves.append(found.filter(F.col("rows") <= leaf_rows).withColumn("block", F.lit(None).cast("bigint")))
        many = found.filter(F.col("rows") > leaf_rows).select(F.col("audit_date").alias("_day"), F.col("bucket").alias("_bucket"))
        if many.isEmpty():
            break
        same = F.col("audit_date").eqNullSafe(F.col("_day")) & (F.left("_key", F.lit(level)) == F.col("_bucket"))
        rows = rows.join(many, same, "left_semi")
    else:
        block = F.shiftright(F.coalesce("id", F.lit(-1 << 62)), _BLOCK_BITS).alias("block")
        leaves.append(rows.groupBy("audit_date", F.col("_key").alias("bucket"), block).agg(*counts))
    merged = leaves[0]
    for other in leaves[1:]:
        merged = merged.unionByName(other)
    return merged.select(*[field.split()[0] for field in INDEX_SCHEMA.split(", ")])


def write_page_index(df: DataFrame, path: str, leaf_rows: int = LEAF_ROWS) -> None:
    """Add the counts of ``df`` to the index under ``path``, sorted by time.

    The rows of each new batch are added once; counts of one leaf are summed when read.
    """
    found = page_counts(df, leaf_rows).repartitionByRange("bucket").sortWithinPartitions("bucket", "block")
    found.write.mode("append").parquet(path)


def read_page_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


@dataclass(frozen=True)
class _Place:
    """The leaf that holds a rank, and how many rows come before the leaf."""

    bucket: str
    block: int | None
    before: int
    whole: bool  # the bucket is all of a key, not a beginning

    @property
    def top(self) -> str:
        """The greatest key of the leaf."""
        return self.bucket if self.whole else self.bucket + _LAST


def _find(index: DataFrame, rank: int, measure: str) -> _Place | None:
    """Descend from days to the leaf that holds the row of a rank (from 0); each step reads one node's children."""
    inside, before = index, 0
    for level in _LEVELS:
        children = inside.groupBy(F.left("bucket", F.lit(level)).alias("bucket")).agg(
            F.sum(measure).alias("n"), F.count("block").alias("blocks"), F.max(F.length("bucket")).alias("longest")
        )
        for child in children.orderBy(F.desc("bucket")).collect():
            if rank < before + child["n"]:
                break
            before += child["n"]
        else:
            return None
        prefix = child["bucket"]
        whole = len(prefix) < level
        inside = inside.filter(F.col("bucket") == prefix if whole else F.col("bucket").startswith(prefix))
        if child["longest"] > level:
            # a leaf of this beginning among finer ones, from another batch: all of it is one leaf
            if not inside.filter(F.length("bucket") <= level).isEmpty():
                return _Place(prefix, None, before, whole)
            continue
        if not child["blocks"] or not inside.filter(F.col("block").isNull()).isEmpty():
            return _Place(prefix, None, before, whole)
        break
    for block in inside.groupBy("block").agg(F.sum(measure).alias("n")).orderBy(F.desc("block")).collect():
        if rank < before + block["n"]:
            return _Place(prefix, block["block"], before, whole)
        before += block["n"]
    return None


def page_total(index: DataFrame, flagged: bool = False) -> int:
    return index.agg(F.sum("flagged" if flagged else "rows")).first()[0] or 0


def page_at(
    df: DataFrame, index: DataFrame, number: int, size: int = 25, flagged: bool = False, most: int = PAGE_SIZE_MAX
) -> DataFrame:
    """``listing.page`` of any depth, of all rows or of the flagged ones, from a table and its index.

    Days, and row groups of files sorted by time, that hold none of the page are not read; what is read and
    sorted are the leaves at its ends and the rows between them.
    """
    if number < 1 or not 1 <= size <= most:
        raise ValueError(f"page must be >= 1 and size within 1..{most}")
    measure, offset = "flagged" if flagged else "rows", (number - 1) * size
    total = page_total(index, flagged)
    first = _find(index, offset, measure) if offset < total else None
    if first is None:
        return df.limit(0)
    last = _find(index, min(offset + size, total) - 1, measure)
    rows = df.filter("flagged") if flagged else df
    days = index.filter(F.col("bucket").between(last.bucket, first.top) & (F.col(measure) > 0))
    dated = [r[0] for r in days.select("audit_date").distinct().collect()]  # the days of one page
    on = F.col("audit_date").isin([d for d in dated if d is not None])
    rows = rows.filter(on | F.col("audit_date").isNull() if None in dated else on)
    # the same bounds on the time itself, which files are sorted by
    if last.bucket.startswith("1"):
        rows = rows.filter(F.col("timestamp").between(last.bucket[1:], first.top[1:]))
    elif first.bucket.startswith("1"):
        rows = rows.filter((F.col("timestamp") <= first.top[1:]) | F.col("timestamp").isNull())
    else:
        rows = rows.filter(F.col("timestamp").isNull())
    low = F.coalesce("id", F.lit(-1 << 62))
    if first.block is not None:  # ids above the first block come before the page
        rows = rows.filter((_key() != first.bucket) | (low < (first.block + 1) << _BLOCK_BITS))
    if last.block is not None:
        rows = rows.filter((_key() != last.bucket) | (low >= last.block << _BLOCK_BITS))
    return rows.orderBy(*newest_first()).offset(offset - first.before).limit(size)
