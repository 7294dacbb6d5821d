"""Packing documents into token sequences by best fit over a histogram of lengths."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import blocks, order_hash, ranked, spread_repeats
from parapet.session import cut_lineage

CAPACITY = 2048
END_ID = 0
_RANK_BITS = 44


class Encoder(dict):
    """Token ids of texts, as little-endian 32-bit numbers.

    No token crosses a space, so a text's ids are those of its space-separated parts in a row.
    Parts met before are looked up; ``keep`` bounds how many are remembered. New words of a block go through the
    tokenizer together: a word of letters alone has one token that ends a word, its last, which tells them apart.
    """

    TOGETHER = 64

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        tokens = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(tokens.values()) + 1, bool)
        self.ends[[i for token, i in tokens.items() if token.endswith("</w>")]] = True

    def __missing__(self, part: bytes) -> bytes:
        text = part.decode()
        if other := self.others(text):
            found = b"".join([self[x] for x in other])
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            found = array("I", ids).tobytes()
        if len(part) < 256:
            self[part] = found
        return found

    def others(self, text: str) -> tuple[bytes, ...]:
        """Simpler parts that have the same ids in a row, if there are some."""
        if len(text) > 1 and text[-1] in ".,;:!?" and text[:-1].isalpha() and "\u0130" not in text:
            # letters and marks never join, but that letter is two characters in lower case
            return text[:-1].encode(), text[-1].encode()
        if text.isalpha() and text != text.lower() and max(text) < "\u0130":
            return (text.lower().encode(),)  # up to there case depends on no neighbour
        return ()

    def learn(self, parts: set[bytes]) -> None:
        """Remember the words of letters that the new ``parts`` come down to."""
        words: set[str] = set()
        for part in parts:
            text = part.decode()
            while other := self.others(text):
                text = other[0].decode()
            if len(text) < 64 and text.isalpha() and text.encode() not in self:
                words.add(text)
        new = list(words)
        for at in range(0, len(new), self.TOGETHER):
            some = new[at : at + self.TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            edges = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(edges) == len(some):  # else one of them is more than a word to the tokenizer
                held = ids.tobytes()
                for word, low, high in zip(some, [0, *edges], edges):
                    self[word.encode()] = held[low:high]

    def __call__(self, text: str) -> bytes:
        return self.block([text])[0]

    def block(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self) > self.keep:
            self.clear()
        split = [text.encode().split() for text in texts]
        found = [list(map(self.get, parts)) for parts in split]
        holes = [[i for i, ids in enumerate(own) if ids is None] for own in found]
        self.learn({parts[i] for parts, own in zip(split, holes) for i in own})
        for parts, own, at in zip(split, found, holes):
            for i in at:
                own[i] = self[parts[i]]
        return [b"".join(own) for own in found]


@lru_cache(maxsize=1)
def kept_encoder(path: str) -> Encoder:
    """The worker's encoder, which tasks that follow each other in one worker share with the parts it has met."""
    return Encoder(path)


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Cut each document's ids plus ``end_id`` into pieces of at most ``capacity`` ids.

    Gives ``(doc_id, piece, start, length, ids_crc32)``, and ``ids`` if asked for. A null text is empty.
    ``tokenizer`` is the path of a ``tokenizers`` file, the same on every machine.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_encoder(tokenizer)
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            names = batch.column("doc_id")
            for part in blocks([len(text) for text in texts]):
                out, of = [], []
                for at, ids in enumerate(encode.block(texts[part]), part.start):
                    ids += end
                    for i, start in enumerate(range(0, len(ids), step)):
                        own = ids[start : start + step]
                        of.append(at)
                        row = (i, start // 4, len(own) // 4, zlib.crc32(own))
                        out.append((*row, np.frombuffer(own, "<u4").tolist()) if with_ids else row)
                columns = [pa.array(values, kind) for values, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), *columns], fields)

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<bigint>" * with_ids)


def plan(counts: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over counts of lengths.

    Each item goes to the open sequence with the least room that holds it, as if items came one
    by one, longest first; but all sequences of one room are filled in one step, so the
    work depends on the number of distinct lengths and not on the number of items.
    Gives runs ``(length, rank, sequence, each, offset)``: from ``rank`` on, items of ``length`` stand ``each``
    to a sequence, from ``sequence`` and ``offset`` on.
    """
    runs = []
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank, room = counts[length], 0, length
        while left:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                new = -(-left // (capacity // length))
                rooms[capacity].append((opened, new))
                opened, room = opened + new, capacity
            first, many = rooms[room].pop()
            fit, offset = room // length, capacity - room
            whole = min(many, left // fit)
            rest = left - whole * fit if whole < many else 0  # goes to one more sequence
            for n, each in ((whole, fit), (int(rest > 0), rest)):
                if n:
                    runs.append((length, rank, first, each, offset))
                    rooms[room - each * length].append((first, n))
                    rank, left, first, many = rank + n * each, left - n * each, first + n, many - n
            if many:
                rooms[room].append((first, many))
            room = length
    return runs


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of ``docs`` with their ``sequence_id`` and ``offset``.

    The driver plans over the histogram of piece lengths (at most ``capacity`` rows); pieces then take
    the planned slot of their rank within their length. Documents are never reordered
    inside a piece, only longer ones than ``capacity`` are cut. A null or empty text is the end id alone;
    repeated rows are packed each; an empty table gives no rows; further columns
    are ignored.
    """
    found = pieces(docs, tokenizer, capacity, end_id, with_ids)
    cut = cut_lineage(found.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = sorted(plan(counts, capacity))
    columns = np.array(runs, np.int64).reshape(-1, 5)
    starts = (columns[:, 0] << _RANK_BITS) | columns[:, 1]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy() << _RANK_BITS) | rank.to_numpy()
        run = columns[np.searchsorted(starts, key, "right") - 1]
        after = rank.to_numpy() - run[:, 1]
        return pd.DataFrame({
            "sequence_id": run[:, 2] + after // run[:, 3],
            "offset": run[:, 4] + after % run[:, 3] * run[:, 0],
        })

    keyed = cut.withColumn("_order", order_hash(F.col("doc_id"), F.col("piece"), F.col("ids_crc32")))
    keyed = spread_repeats(keyed, ["length"], "_order", "_row")
    placed = ranked(keyed, ["length"], "_order", ["doc_id", "piece", "_row"], sum(counts.values()))
    placed = placed.withColumn("_slot", slot("length", "rank"))
    return placed.select(*found.columns, "_slot.sequence_id", "_slot.offset")
