"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.llm.components import components
from parapet.session import cut_lineage

SEED = 42
HALF = 32


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: ASCII letters and spaces only


def _shingles(words: list[bytes], size: int) -> list[bytes]:
    runs = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    return [b" ".join(run) for run in runs] if words else []


def _majority(hashes: np.ndarray) -> int:
    """The number whose bits are set where they are in over half of the hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(bits)
    return int.from_bytes(np.packbits(over).tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text, as a signed number; 0 without words."""
    parts = _shingles(_split(text), shingle)
    if not parts:
        return 0
    return _majority(np.frombuffer(b"".join([xxhash.xxh64_digest(part, SEED) for part in parts]), ">u8"))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp)`` of each document; ``text_hash`` tells equal ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), shingle) for text in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def _segments(fp: Column, many: int) -> list[tuple[Column, int]]:
    """The 64 bits cut into ``many`` numbers from the top, each with its width; the first ones take what is over."""
    out, below = [], 64
    for i in range(many):
        width = 64 // many + (i < 64 % many)
        below -= width
        out.append((F.shiftrightunsigned(fp, below).bitwiseAND(F.lit((1 << width) - 1)), width))
    return out


def _key(segment: int, value: Column) -> Column:
    # Segment 0 keeps its number, the others are marked by bits above it.
    return value.bitwiseOR(F.lit(segment << HALF))


def _ball(segment: int, value: Column, width: int) -> Column:
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << bit).cast("long") for bit in range(width)])
    return F.transform(flips, lambda flip: _key(segment, value.bitwiseXOR(flip)))


def links(
    prints: DataFrame, most: int = 3, within: tuple[str, ...] = (), apart: str | None = None, once: bool = True
) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of distinct fingerprints at most ``most`` bits apart.

    A multi-index: of bits that differ, at most ``most`` in all, one of ``most // 2 + 1`` segments has one or none:
    two halves for three bits, three segments for five. So all such pairs are found. Each fingerprint enters the
    table under all its segments (two at least), and looks up the ball of radius one around each. Matches are
    verified by their complete distance inside the join, so only true links leave it. Pairs have equal values
    in the columns ``within`` and keep them; with ``apart``, a column fixed for each fingerprint, only those that
    differ in it are given. A pair met under several segments is given ``once``, or each time.
    """
    extra = [apart] if apart else []
    fp = prints.select(*within, *extra, "fp").distinct()
    segments = _segments(F.col("fp"), max(2, most // 2 + 1))
    table = fp.select(
        *[F.col(c).alias(f"_{c}") for c in (*within, *extra)], F.col("fp").alias("b"),
        F.explode(F.array(*[_key(i, s) for i, (s, _) in enumerate(segments)])).alias("key"),
    )
    probes = [_ball(i, s, width) for i, (s, width) in enumerate(segments)]
    probe = fp.select(*within, *extra, F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("key"))
    match = (probe["key"] == table["key"]) & (F.col("a") < F.col("b"))
    for c in within:
        match = match & (F.col(c) == F.col(f"_{c}"))
    if apart:
        match = match & (F.col(apart) != F.col(f"_{apart}"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    found = probe.join(table, match & near).select(*within, "a", "b")
    return found.distinct() if once else found


def stars(prints: DataFrame, most: int, within: tuple[str, ...] = ()) -> DataFrame:
    """Some of the links: between a fingerprint and the least and largest that share one of its halves.

    Linear in the number of fingerprints, however many share a half.
    """
    halves = F.array(*[_key(i, h) for i, (h, _) in enumerate(_segments(F.col("fp"), 2))])
    rows = prints.select(*within, "fp", F.explode(halves).alias("key"))
    ends = rows.groupBy(*within, "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    ends = cut_lineage(ends.filter("low <> high"), "ends")
    found = rows.join(ends, [*within, "key"]).select(*within, F.col("fp").alias("a"), F.explode(F.array("low", "high")).alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    return found.filter((F.col("a") != F.col("b")) & near).distinct()


def forest(pairs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` that connect what ``pairs`` connects: in each task, every node with the least it is connected to.

    However many pairs a task meets, it holds and gives no more than its nodes, and no two of a tree are
    more than two steps apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(node: int) -> int:
            while (up := above.setdefault(node, node)) != node:
                above[node] = node = above[up]
            return node

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
        nodes = list(above)
        for start in range(0, len(nodes), 1 << 16):
            part = [(top, node) for node in nodes[start : start + (1 << 16)] if (top := root(node)) != node]
            if part:
                least, own = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array(own, pa.int64())], ["a", "b"])

    return pairs.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp, label, component_id)``: documents by groups of linked fingerprints.

    Fingerprints ``most`` bits apart or less link; ``component_id`` is the smallest
    ``doc_id`` reachable over links, ``label`` the smallest fingerprint. Equal fingerprints are one node of the graph, so a
    group of copies counts once. Groups of many near copies join up by ``stars`` first, in linear work; then the
    multi-index looks for links between groups, and each task passes on those that connect what it has met, so
    links grow with the fingerprints, not with the square of a group.

    Null texts and texts without words have fingerprint 0
    and link like others; null ids count as larger than all others (a group of null ids only
    has a null component); repeated rows fall in one group; an empty table gives
    no rows; further columns are ignored.
    """
    rows = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    near = cut_lineage(stars(nodes, most), "stars")
    grouped = nodes.select("fp").join(components(near).withColumnRenamed("node", "fp"), "fp", "left")
    grouped = cut_lineage(grouped.withColumn("label", F.coalesce("label", "fp")), "grouped")
    between = cut_lineage(forest(links(grouped, most, apart="label", once=False)), "between")
    labels = components(near.union(between)).withColumnRenamed("node", "fp")
    members = nodes.join(labels, "fp", "left")
    members = members.withColumn("label", F.coalesce("label", "fp"))
    members = cut_lineage(members, "members")
    firsts = members.groupBy("label").agg(F.min("first").alias("component_id"))
    groups = members.join(cut_lineage(firsts, "firsts"), "label").select("fp", "label", "component_id")
    return rows.join(cut_lineage(groups, "groups"), "fp")


def deduplicated(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates``: its smallest ``doc_id``, then text hash.

    All columns are kept, whatever their names. A null text is a copy of other null and wordless ones; null ids count as
    larger than all others; of rows equal in id and text one stays; an empty table gives no rows. Whole
    texts are moved once, to meet the ids that stay.
    """
    found = near_duplicates(docs, shingle, most)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keep = cut_lineage(found.groupBy("label").agg(F.min(order).alias("k")), "keep")
    keep = keep.select(F.col("k.doc_id").alias("id"), F.col("k.text_hash").alias("hash"))
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = docs.select(given.alias("given"), "doc_id", F.xxhash64("text").alias("text_hash"))
    kept = own.join(keep, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi")
    # Only where rows repeat in id and text do texts have to meet to leave one.
    if not found.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text_hash"])
    return kept.select(*[F.col("given").getField(c).alias(c) for c in docs.columns])
