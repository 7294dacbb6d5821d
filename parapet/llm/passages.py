"""Repeated passages: recurring phrases located by sharded automata, later copies removed word by word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import SPACES, among, blocks, mixed
from parapet.session import cut_lineage

WINDOW = 20
PHRASE = 8
_SIDE = WINDOW - PHRASE
#: Odd multipliers of the two rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MASK = (1 << 64) - 1


def _powers(base: int, many: int) -> np.ndarray:
    steps = np.full(many, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Words:
    """64-bit hashes of words: their bytes' numbers times powers, summed by numpy, so no word costs a call.

    Words of more than ``LONG`` bytes, among which such sums may be equal by design, are hashed by XXH64.
    """

    STEP, LONG = 1 << 16, 256
    space = np.isin(np.arange(256), list(SPACES.encode()))
    numbers = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[0]))
    powers, inverses = _powers(_BASES[1], STEP + LONG + 1), _powers(pow(_BASES[1], -1, 1 << 64), STEP + LONG + 1)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return self.of([b" ".join(words)])[0]

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The hashes of the words of each text."""
        whole = b" ".join([b"", *texts, b""])
        letters = np.frombuffer(whole, np.uint8)
        blank = self.space[letters]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # a blank is first and last
        starts, ends = edges[::2], edges[1::2]
        short = np.minimum(ends, starts + self.LONG)
        found = np.empty(len(starts), np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(letters) + self.STEP, self.STEP))
        for low, high in zip(cuts.tolist(), cuts[1:].tolist()):
            if low < high:
                first, last = int(starts[low]), int(short[high - 1])
                sums = np.zeros(last - first + 1, np.uint64)
                np.cumsum(self.numbers[letters[first:last]] * self.powers[: last - first], out=sums[1:])
                at = starts[low:high] - first
                found[low:high] = (sums[short[low:high] - first] - sums[at]) * self.inverses[at]
        found = mixed(found + (ends - starts).astype(np.uint64))
        for i in np.flatnonzero(ends - starts > self.LONG).tolist():
            found[i] = xxhash.xxh64_intdigest(whole[starts[i] : ends[i]])
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        return np.split(found, np.searchsorted(starts, 1 + np.cumsum(lengths + 1)[:-1])) if texts else []


class Ranges:
    """Hashes of any range of a word sequence, in constant time each after one pass."""

    powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    inverses = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __init__(self, hashes: np.ndarray, kinds: int = 2):
        self.sums = []
        for i, base in enumerate(_BASES[:kinds]):
            if len(self.powers[i]) < len(hashes) + 1:
                many = 2 * len(hashes) + 1024
                for table, factor in ((self.powers, base), (self.inverses, pow(base, -1, 1 << 64))):
                    table[i] = _powers(factor, many)
            own = hashes * self.powers[i][: len(hashes)]
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)]))

    def __call__(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        found = (self.sums[which][end] - self.sums[which][start]) * self.inverses[which][start]
        return mixed(found + (end - start).astype(np.uint64))


def phrases(ranges: Ranges, n: int) -> np.ndarray:
    """The hash of the phrase that starts at each word."""
    at = np.arange(max(0, n - PHRASE + 1))
    return ranges(at, at + PHRASE)


def leading(hashes: np.ndarray) -> np.ndarray:
    """For each window of ``WINDOW`` words the position of the phrase that stands for it.

    That is the one of least hash among those inside the window. So equal windows have equal
    anchors at equal offsets, wherever they stand, and few words start one.
    """
    if len(hashes) < _SIDE + 1:
        return np.zeros(0, np.int64)
    windows = len(hashes) - _SIDE
    hashes = np.ascontiguousarray(hashes)
    inside = np.ndarray((windows, _SIDE + 1), hashes.dtype, hashes, 0, (hashes.itemsize, hashes.itemsize))
    return inside.argmin(axis=1) + np.arange(windows)  # the first of equal ones, so places only grow


def anchors(hashes: np.ndarray) -> np.ndarray:
    """Positions of the phrases that stand for some window."""
    least = leading(hashes)
    return least[np.append(True, least[1:] != least[:-1])] if len(least) else least


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in batch.column("text").to_pylist()]


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with two hashes that name the document; equal rows are one document."""
    return docs.select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text").alias("k2")
    )


def _documents(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Each document with its number of words, the digest of all of them, and its ``anchors``; packed with ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, squeeze = Words(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = _texts(batch)
            for part in blocks([len(t) for t in texts]):
                counts, digests, found, starts = [], [], [], [0]
                for text, hashes in zip(texts[part], words.of(texts[part])):
                    own = phrases(Ranges(hashes, 1), len(hashes))
                    found.append(own[anchors(own)])
                    starts.append(starts[-1] + len(found[-1]))
                    counts.append(len(hashes))
                    digests.append(hashlib.sha256(b" ".join(text.split())).digest())
                packed = [squeeze.compress(t) if keep else None for t in texts[part]]
                kept = [batch.column(c).slice(part.start, part.stop - part.start) for c in ("doc_id", "k1", "k2")]
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), _signed(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary()), lists],
                    ["doc_id", "k1", "k2", "n_words", "sha", "packed", "anchors"],
                )

    schema = "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, sha binary, packed binary, anchors array<bigint>"
    return docs.mapInArrow(run, schema)


def locate(texts: list[bytes], listed: list[np.ndarray]) -> list[tuple[np.ndarray, Ranges, np.ndarray, np.ndarray]]:
    """Every occurrence of the listed phrases in the texts of one shard.

    ``listed`` has for each text hashes of phrases to look for; their words are taken from the text they are listed
    with. An automaton over word numbers is compiled from all phrases of the shard, and every text is streamed through it.
    A number is written as three letters or more, with some of their own for each place: a node of the automaton looks through its
    children one by one, so they have to be few, and no phrase can be met between two words.
    Gives for each text the hashes of its words, ranges, and places and hashes of phrases.
    """
    hashes = Words().of(texts)
    ranges = [Ranges(own) for own in hashes]
    every = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    known_words, numbers = np.unique(every, return_inverse=True)
    many = next(m for m in range(3, 8) if (256 // m) ** m >= len(known_words))
    base = 256 // many
    letters = np.stack([numbers // base**i % base + base * i for i in range(many)], axis=1).astype(np.uint8)
    spelled = letters.tobytes().decode("latin-1")
    edges = many * np.cumsum([0, *map(len, hashes)])
    spellings = [spelled[low:high] for low, high in zip(edges.tolist(), edges[1:].tolist())]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    names: list[int] = []
    known: set[int] = set()
    for own, own_hashes, own_ranges, wanted in zip(spellings, hashes, ranges, listed):
        if len(wanted):
            here = phrases(own_ranges, len(own_hashes))
            for at in np.flatnonzero(np.isin(here, wanted)).tolist():
                name = int(here[at])
                if name not in known:
                    known.add(name)
                    automaton.add_word(own[many * at : many * (at + PHRASE)], len(names))
                    names.append(name)
    found = []
    if names:
        automaton.make_automaton()
    named = np.array(names, np.uint64)
    for own_hashes, own, own_ranges in zip(hashes, spellings, ranges):
        hits = list(automaton.iter(own)) if names and len(own_hashes) >= WINDOW else []
        ends, which = np.array(hits, np.int64).reshape(-1, 2).T
        found.append((own_hashes, own_ranges, (ends + 1) // many - PHRASE, named[which]))
    return found


def _occurrences(docs: DataFrame) -> DataFrame:
    """Packed documents with ``occurrences`` of recurring phrases.

    ``docs`` has ``listed``, the recurring phrases among a document's anchors. An occurrence has the phrase,
    a hash of the words up to ``_SIDE`` before and behind it (the context), its place, and the place and
    length of the context. Those that stand for no window are left out: equal windows have their anchors at equal offsets.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = _texts(batch)
            lists = [np.array(x, np.int64).view(np.uint64) for x in batch.column("listed").to_pylist()]
            for part in blocks([len(t) for t in texts]):
                parts, starts = [], [0]
                for hashes, ranges, at, name in locate(texts[part], lists[part]):
                    n = len(hashes)
                    stands = np.zeros(n, bool)
                    stands[anchors(phrases(ranges, n))] = True
                    at, name = at[stands[at]], name[stands[at]]
                    low = np.maximum(at - _SIDE, 0)
                    high = np.minimum(at + PHRASE + _SIDE, n)
                    context = mixed(ranges(low, high, 1) + ((at - low) * 64 + high - low).astype(np.uint64))
                    parts.append((name, context, at, low, high - low))
                    starts.append(starts[-1] + len(at))
                fields = [np.concatenate(x) for x in zip(*parts)]
                items = pa.StructArray.from_arrays(
                    [_signed(fields[0]), _signed(fields[1]), *[pa.array(f, pa.int64()) for f in fields[2:]]],
                    ["phrase", "context", "at", "low", "size"],
                )
                kept = [batch.column(c).slice(part.start, part.stop - part.start) for c in ("doc_id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(map(squeeze.compress, texts[part]), pa.binary()),
                     pa.ListArray.from_arrays(pa.array(starts, pa.int32()), items)],
                    ["doc_id", "k1", "k2", "packed", "occurrences"],
                )

    return docs.mapInArrow(
        run,
        "doc_id bigint, k1 bigint, k2 bigint, packed binary, occurrences"
        " array<struct<phrase: bigint, context: bigint, at: bigint, low: bigint, size: bigint>>",
    )


def _windows(docs: DataFrame) -> DataFrame:
    """The windows that the phrases at the listed ``places`` stand for, two hashes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            out, of = [], []
            for i, (packed, places) in enumerate(zip(batch.column("packed"), batch.column("places").to_pylist())):
                hashes = words.of([zstandard.decompress(packed.as_py())])[0]
                ranges = Ranges(hashes)
                asked = np.zeros(len(hashes), bool)
                asked[places] = True
                at = np.flatnonzero(asked[leading(phrases(ranges, len(hashes)))])
                out.append((ranges(at, at + WINDOW), ranges(at, at + WINDOW, 1), at))
                of.append(np.full(len(at), i))
            if out:
                one, two, at = (np.concatenate(x) for x in zip(*out))
                kept = [batch.column(c).take(pa.array(np.concatenate(of))) for c in ("doc_id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, _signed(one), _signed(two), pa.array(at, pa.int64())],
                    ["doc_id", "k1", "k2", "w1", "w2", "at"],
                )

    schema = "doc_id bigint, k1 bigint, k2 bigint, w1 bigint, w2 bigint, at bigint"
    return docs.mapInArrow(run, schema)


def _place(at: str = "at"):
    """Where something stands, in the order that decides which copy is the first."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k2", "k1", F.col(at).alias("at"))


def repeated(docs: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents (see ``_documents``), those of recurring phrases (see ``_occurrences``), and spans
    ``(k1, k2, spans)`` of words to remove.

    Equal windows share an anchor, and anchors that occur once in the corpus drop out by counting. Documents get the list
    of their recurring phrases, and automata locate all occurrences; a document without a list holds no repeated window,
    and its text moves nowhere. Occurrences with equal phrase and equal context
    are copies as a whole: all but the first are removed with their context. Only phrases in several contexts
    need their windows compared, one occurrence for each context.
    """
    named = _keyed(docs)
    every = cut_lineage(_documents(named, keep), "documents")
    rows = every.select("k1", F.explode("anchors").alias("phrase"))
    often = rows.groupBy("phrase").count().filter("count > 1").select("phrase")
    listed = rows.join(cut_lineage(often, "phrases"), "phrase")
    listed = cut_lineage(listed.groupBy("k1").agg(F.collect_set("phrase").alias("listed")), "listed")
    located = cut_lineage(_occurrences(among(named, listed, "k1").join(listed, "k1")), "occurrences")

    found = located.select("doc_id", "k1", "k2", F.explode("occurrences").alias("o")).select(
        "doc_id", "k1", "k2", "o.*"
    )
    classes = found.groupBy("phrase", "context").agg(F.min(_place()).alias("first"))
    classes = cut_lineage(classes, "contexts")
    copies = found.join(classes, ["phrase", "context"]).filter(_place() != F.col("first"))
    spans = copies.select("k1", "k2", "low", "size")

    several = classes.groupBy("phrase").count().filter("count > 1").select("phrase")
    firsts = classes.join(cut_lineage(several, "several"), "phrase")
    places = firsts.groupBy(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2")).agg(
        F.collect_set("first.at").alias("places")
    )
    places = cut_lineage(places, "places")
    # equal rows give equal windows at equal places, which are no copies of each other
    packed = among(located.select("doc_id", "k1", "k2", "packed"), places, "k1")
    around = cut_lineage(_windows(packed.join(places, ["k1", "k2"])), "windows")
    earliest = around.groupBy("w1", "w2").agg(F.min(_place()).alias("first"), F.count("*").alias("many"))
    earliest = cut_lineage(earliest.filter("many > 1").drop("many"), "earliest")
    later = around.join(earliest, ["w1", "w2"]).filter(_place() != F.col("first"))
    spans = spans.union(later.select("k1", "k2", F.col("at").alias("low"), F.lit(WINDOW).cast("long").alias("size")))
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "size")).alias("spans"))
    return every, located, cut_lineage(spans, "spans")


def _without(docs: DataFrame, with_text: bool) -> DataFrame:
    """What is left of packed documents without their ``spans``: ``(k1, k2, n_removed, left)`` and perhaps ``packed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows: list[list] = [[], [], []]
            for packed, spans in zip(batch.column("packed"), batch.column("spans")):
                words = zstandard.decompress(packed.as_py()).split()
                low, size = (np.asarray(spans.values.field(c)) for c in ("low", "size"))
                edge = np.bincount(low, minlength=len(words) + 1) - np.bincount(low + size, minlength=len(words) + 1)
                stays = np.cumsum(edge[:-1]) == 0
                text = b" ".join(compress(words, stays.tolist()))
                rows[0].append(len(words) - int(stays.sum()))
                rows[1].append(hashlib.sha256(text).digest())
                rows[2].append(squeeze.compress(text) if with_text else None)
            columns = [pa.array(values, kind) for values, kind in zip(rows, (pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), *columns], ["k1", "k2", "n_removed", "left", "packed_left"]
            )

    return docs.mapInArrow(run, "k1 bigint, k2 bigint, n_removed bigint, left binary, packed_left binary")


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` and, if asked for, ``text``: the kept words.

    A word goes if a window of ``WINDOW`` words over it also starts earlier: in a document of smaller ``doc_id`` (null
    last, then by a hash of the text), or earlier in the same. Windows are those of the input. Kept words are
    joined by a space. A null text has no words; texts of fewer than ``WINDOW`` words stay; repeated rows
    are one document and get equal results; an empty table gives no rows; further columns are ignored.
    """
    every, located, spans = repeated(docs, with_text)
    packed = among(located.select("k1", "k2", "packed"), spans, "k1").join(spans, ["k1", "k2"])
    left = _without(packed, with_text).dropDuplicates(["k1", "k2"])
    rows = every.drop("anchors").join(left, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.lower(F.hex(F.coalesce("left", "sha"))).alias("kept_sha256"), *[F.coalesce("packed_left", "packed").alias("packed")] * with_text,
    )
    if not with_text:
        return rows

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b" ".join(zstandard.decompress(x.as_py()).split()).decode() for x in batch.column("packed")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"]
            )

    return rows.mapInArrow(unpacked, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string")
