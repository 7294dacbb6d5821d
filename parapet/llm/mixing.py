"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.llm.common import ORDER_BITS, WORD, ranked, spread_repeats
from parapet.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
SLOTS = 1 << 17
LONGEST_BLOCK = 1024
#: Points are multiples of the golden ratio modulo one, as whole numbers of ``POINT_BITS`` bits.
POINT_BITS = 31
GOLDEN = 1327217885
_CELL_BITS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Add ``number``, ``weight`` and ``target`` to ``(source, source_size)``.

    Weights repeat over sources by code point, null last. All targets together are ``share`` times all
    sizes. A source stops at ``passes`` times its size and the excess is shared out
    again by weight: so targets are ``level * weight`` but for those stopped, at one common level.
    Sources are taken by the level at which they stop; the level is known at the first
    that does not. These windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    number = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    rows = sources.withColumns({"number": number, "weight": weight})
    most = F.col("source_size") * passes
    stop = most / F.col("weight")
    by_stop = Window.orderBy("stop", "number")
    earlier = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    later = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    rows = rows.withColumns({"most": most, "stop": stop})
    level = (total - F.coalesce(F.sum("most").over(earlier), F.lit(0))) / F.sum("weight").over(later)
    rows = rows.withColumn("level", level)
    stopped = F.col("level") >= F.col("stop")
    common = F.max(F.when(~stopped, F.col("level"))).over(Window.partitionBy())
    target = F.when(stopped, F.col("most").cast("double")).otherwise(F.col("weight") * common)
    return rows.withColumn("target", target).select("source", "source_size", "number", "weight", "target")


def block_length(total: float) -> int:
    """Tokens in a block: such that there are ``SLOTS`` slots, up to ``LONGEST_BLOCK``."""
    return max(1, min(LONGEST_BLOCK, int(total) // SLOTS))


def slots(shares: DataFrame, total: float, block: int) -> DataFrame:
    """The schedule: ``(slot, number, rank)``, the source of each slot and the rank among its slots.

    Slot ``i`` has the point ``i * GOLDEN`` modulo ``2**POINT_BITS``; a source owns the points of its
    part of the cumulative targets. Every stretch of slots so has each source about as often as
    its share says.
    """
    count = math.ceil(total / block)
    top = 1 << POINT_BITS
    after = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.floor(F.sum("target").over(after) / F.lit(float(total)) * top)
    last = F.col("number") == F.max("number").over(Window.partitionBy())
    edges = shares.select("number", F.when(last, F.lit(top)).otherwise(edge).alias("high"))
    low = F.coalesce(F.lag("high").over(Window.orderBy("number")), F.lit(0))
    edges = edges.withColumn("low", low).filter("low < high")
    # A source is found by cells of points that its part touches.
    size = top >> _CELL_BITS
    cells = F.sequence(F.floor(F.col("low") / size), F.floor((F.col("high") - 1) / size))
    edges = edges.withColumn("cell", F.explode(cells))
    spark = shares.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, count >> 20)
    point = (F.col("id") % top) * GOLDEN % top
    points = spark.range(0, count, 1, tasks).select(F.col("id").alias("slot"), point.alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / size))
    owned = (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))
    found = points.join(edges, "cell").filter(owned).select("slot", "number")
    bits = max(1, math.ceil(math.log2(max(2, count))))
    found = found.withColumn("_order", F.shiftleft("slot", ORDER_BITS - bits))
    return ranked(found, ["number"], "_order", [], count).select("slot", "number", "rank")


def shuffle_order(epoch: int, doc_id: Column) -> Column:
    """The place of a document in the shuffle of a pass: 60 bits of an md5."""
    name = F.concat(F.lit(f"{epoch}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, ORDER_BITS // 4), 16, 10).cast("long")


def schedule(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES):
    """Sources with targets, and the pieces of documents in their slots.

    ``rows`` holds ``(row, doc_id, source, size)``, ``row`` being unique. Each pass over a source shuffles
    its documents anew; passes follow each other as one stream of tokens, cut into equal blocks. Block
    ``b`` of a source fills the source's slot of rank ``b``. Pieces are
    ``(slot, row, epoch, start, length)`` with ``start`` in the document.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = cut_lineage(targets(sizes, weights, share, passes), "targets")
    total = shares.agg(F.sum("target")).first()[0] or 0.0
    count, block = rows.count(), block_length(total)
    known = rows.join(shares, rows["source"].eqNullSafe(shares["source"])).select(
        "row", "doc_id", "size", "number", "source_size", "target"
    ).filter("size > 0")
    streams = None
    for epoch in range(passes):
        # Later passes are read only where the target goes beyond the ones before.
        own = known.filter(F.col("target") > F.col("source_size") * epoch) if epoch else known
        own = own.withColumns({
            "epoch": F.lit(epoch), "_order": shuffle_order(epoch, F.col("doc_id")),
        })
        streams = own if streams is None else streams.union(own)
    streams = spread_repeats(streams, ["number", "epoch"], "_order", "row")
    streams = ranked(streams, ["number", "epoch"], "_order", ["doc_id", "row"], count, "size")
    start = F.col("before") + F.col("epoch") * F.col("source_size")
    streams = streams.select("row", "number", "epoch", "size", start.alias("at"))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    parts = streams.withColumn("rank", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("rank") * block)
    end = F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * block)
    parts = parts.select(
        "row", "number", "epoch", "rank", (begin - F.col("at")).alias("start"), (end - begin).alias("length")
    )
    if not total:
        return shares, parts.select(F.lit(0).cast("long").alias("slot"), "row", "epoch", "start", "length")
    pieces = parts.join(slots(shares, total, block), ["number", "rank"])
    return shares, pieces.select("slot", "row", "epoch", "start", "length")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source", n_words("text").alias("size")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: what the mix takes of each document.

    A null text has no words and is never taken; null is a source of its own; null or repeated ids and
    repeated rows count each; an empty table gives no rows; further columns are ignored.
    """
    rows = cut_lineage(_rows(docs), "sizes")
    shares, pieces = schedule(rows, weights, share, passes)
    taken = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    known = rows.join(shares, rows["source"].eqNullSafe(shares["source"]))
    return known.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each pass that takes them.

    A text taken in part, at the end of its source's last block, is cut after the words taken;
    ``n_chars`` follows the text, if there is such a column.
    """
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # out of the way of names used here
    stored = cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), given.alias("given")), "mix")
    rows = stored.select("row", "given.doc_id", "given.source", n_words("given.text").alias("size"))
    rows = cut_lineage(rows, "sizes")
    _, pieces = schedule(rows, weights, share, passes)
    taken = pieces.groupBy("row", "epoch").agg(F.sum("length").alias("taken"))
    taken = taken.join(rows.select("row", "size"), "row").select(
        "row", "taken", (F.col("taken") < F.col("size")).alias("cut")
    )
    # Cut behind each word, so that a part is a word with the separators before it.
    marks = F.split("given.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    part = F.array_join(F.slice(marks, 1, F.col("taken").cast("int")), "")
    out = stored.join(taken, "row").withColumn("new", F.when(F.col("cut"), part).otherwise(F.col("given.text")))
    changes = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        length = F.length("new").cast(docs.schema["n_chars"].dataType)
        changes["n_chars"] = F.when(F.col("cut"), length).otherwise(F.col("given.n_chars"))
    return out.select(*[changes.get(c, F.col("given").getField(c)).alias(c) for c in docs.columns])
