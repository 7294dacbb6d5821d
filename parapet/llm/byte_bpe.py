"""Byte-level BPE by prefix dynamic programming: exact encoding, decoding, appends and edits."""

from __future__ import annotations

import base64
import itertools
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from parapet.llm.common import blocks

#: Pieces, and pairs of tokens, that are remembered by a task.
KEEP = 600_000


@lru_cache(maxsize=8)
def class_of(name: str) -> frozenset[str]:
    """The characters of a class such as ``\\p{L}`` as the installed tokenizer library knows them."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    find = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={})
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    return frozenset(bytes(find.encode_ordinary(every)).decode())


@lru_cache(maxsize=8)
def exact_pattern(pattern: str) -> tuple[str, str, str]:
    """``pattern`` with letters and digits as the tokenizer library knows them, a class of what differs, and its least.

    Libraries follow different versions of Unicode; characters that are letters or digits in one alone
    are taken out of the class by ranges.
    """
    every, least = "", sys.maxunicode
    for name in (r"\p{L}", r"\p{N}"):
        own = set(map(ord, regex.findall(name, "".join(map(chr, range(sys.maxunicode + 1))))))
        theirs = set(map(ord, class_of(name)))
        if theirs - own:
            raise ValueError(f"{name} lacks characters of the tokenizer library")
        ranges: list[list[int]] = []
        for code in sorted(own - theirs):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
        if ranges:
            less = "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in ranges)
            pattern = pattern.replace(name, f"[{name}--[{less}]]")
            every, least = every + less, min(least, ranges[0][0])
    return "(?V1)" + pattern, every, chr(least)


class Splitter:
    """Cuts texts into the matches of a pattern.

    Texts without a character that libraries see differently take the pattern as it is, which is
    much faster than with classes cut down, and gives the same matches.
    """

    def __init__(self, pattern: str, exact: tuple[str, str, str]):
        self.plain, self.exact, self.least = regex.compile(pattern), regex.compile(exact[0]), exact[2]
        self.differs = re.compile(f"[{exact[1]}]").search if exact[1] else lambda text: None

    def of(self, text: str):
        alike = not text or max(text) < self.least or not self.differs(text)
        return self.plain if alike else self.exact


class Vocabulary:
    """Tokens by rank, and which of them may follow one another.

    ``ranks`` gives each token's bytes its rank, all single bytes included. Merging goes by least rank,
    leftmost first.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        lengths = sorted({len(token) for token in ranks}, reverse=True)
        self.longest = lengths[0]
        #: Lengths of tokens that fit into so many bytes, longest first.
        self.fitting = [[n for n in lengths if n <= most] for most in range(self.longest + 1)]
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._follows: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a short text by merging itself; the time grows with the square of its length."""
        return self._merged(data)[0]

    def _merged(self, data: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """The tokens of a text, and the two that were merged last."""
        ranks, latest = self.ranks, None
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((rank for rank in pairs if rank is not None), default=None)
            if best is None:
                break
            at = pairs.index(best)
            latest = ranks[parts[at]], ranks[parts[at + 1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[part] for part in parts], latest

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one: ``None`` for a byte, ``(-1, -1)`` if merging does not reach it."""
        if token not in self._parts:
            found, latest = self._merged(self.tokens[token])
            self._parts[token] = latest if found == [token] else (-1, -1)
        return self._parts[token]

    def follows(self, before: int, token: int) -> bool:
        """Whether merging leaves ``before`` and ``token`` (or, with ``before`` -1, ``token`` alone) as they are."""
        key = (before + 1) << 32 | token
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > KEEP:
                self._follows.clear()
            known = self._follows[key] = self._stay(before, token)
        return known

    def _stay(self, left: int, right: int) -> bool:
        """Both merges are undone, latest first: at no time may a merge across the border have come before."""
        if self.parts(right) == (-1, -1) or left >= 0 and self.parts(left) == (-1, -1):
            return False
        if left < 0:
            return True
        ranks, tokens, whole = self.ranks, self.tokens, (left, right)
        next_rank = len(tokens)  # of the merge that came next at this time
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < next_rank:
                return False
            a, b = self.parts(left), self.parts(right)
            if a is None and b is None:
                return True
            if a is not None and max(a) >= left or b is not None and max(b) >= right:
                # ranks that do not grow with each merge say nothing about their order in time
                return self.merged(tokens[whole[0]] + tokens[whole[1]]) == list(whole)
            if b is None or a is not None and left > right:
                next_rank, left = left, a[1]
            else:  # of equal ranks the left one comes first: one across would come before this one
                next_rank, right = right + 1, b[0]

    def last_of(self, data: bytes, end: int, last: array, start: int = 0) -> int:
        """The one token that can end ``data[start:end]``, given those of all shorter prefixes.

        It is the token that fits behind the last token of the rest: the tokens of a text are
        those of each of its prefixes that ends between two of them.
        """
        get, known = self.ranks.get, self._follows.get
        for length in self.fitting[min(end - start, self.longest)]:
            begin = end - length
            token = get(data[begin:end])
            if token is not None:
                before = last[begin] if begin > start else -1
                fits = known((before + 1) << 32 | token)
                if fits or fits is None and self.follows(before, token):
                    return token
        raise ValueError("no token ends here; single bytes are missing")


def read_vocabulary(path: str) -> Vocabulary:
    """The rank file of a public tokenizer: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)})


class Encoded:
    """A text in bytes with the last token of each of its prefixes.

    ``last[i]`` is the last token of the first ``i`` bytes, counted from the start of the piece they end in;
    at the end of a piece it is stored as its complement, below zero. The tokens are read backwards
    from it. A text grows or changes by working out only what is new: prefixes before the change
    keep their tokens, and behind it both passes end as soon as they meet the old ones again.
    """

    def __init__(self, vocabulary: Vocabulary, split: Splitter, data: bytes = b"", last: array | None = None):
        self.vocabulary, self.split, self.data = vocabulary, split, data
        self.last = last if last is not None else array("i", [0])
        self.worked = 0  # prefixes worked out so far
        if last is None and data:
            self.data = b""
            self.append(data.decode())

    def ids(self) -> list[int]:
        """The tokens, from the last one backwards."""
        found, at = [], len(self.data)
        tokens, last = self.vocabulary.tokens, self.last
        while at:
            token = last[at] if last[at] >= 0 else ~last[at]
            found.append(token)
            at -= len(tokens[token])
        return found[::-1]

    def append(self, text: str) -> None:
        self.replace(len(self.data), len(self.data), text)

    def replace(self, start: int, end: int, text: str) -> None:
        """Put ``text`` in place of the bytes from ``start`` to ``end``, which lie between characters."""
        vocabulary, old = self.vocabulary, self.last
        new = text.encode()
        data = self.data[:start] + new + self.data[end:]
        behind, moved = start + len(new), start + len(new) - end
        at = self._kept(start)
        last = old[: at + 1]
        rest = data[at:].decode()
        for piece in self.split.of(rest).finditer(rest):
            own = piece[0].encode()
            stop = at + len(own)
            # prefixes before the change keep their tokens, in a piece that begins where one began
            kept = self._run(at + 1, min(start + 1, stop)) if at == 0 or at <= start and old[at] < 0 else at + 1
            last.extend(old[at + 1 : kept])
            i, same = len(last), 0
            while i < stop:
                token = vocabulary.last_of(data, i, last, at)
                self.worked += 1
                last.append(token)
                before = i - moved
                same = same + 1 if i > behind and before < len(old) and old[before] == token else 0
                i += 1
                # equal tokens in equal text for longer than any token: the rest of the old piece is equal too
                if same > vocabulary.longest:
                    last.extend(old[before + 1 : self._run(before + 1, stop - moved)])
                    i, same = len(last), 0
            whole = vocabulary.ranks.get(own)
            last.append(~(vocabulary.last_of(data, stop, last, at) if whole is None else whole))
            at = stop
            if at >= behind and 0 < at - moved < len(old) and old[at - moved] < 0:
                last.extend(old[at - moved + 1 :])  # from the same end of a piece on, all goes on alike
                break
        self.data, self.last = data, last

    def _kept(self, start: int) -> int:
        """The last end of a piece that no change from ``start`` on can move.

        Where a piece ends depends on at most two characters behind it.
        """
        at, characters = start, 0
        while at and characters < 2:
            at -= 1
            characters += self.data[at] & 0xC0 != 0x80
        while at and self.last[at] >= 0:
            at -= 1
        return at

    def _run(self, first: int, most: int) -> int:
        """How far from ``first`` on, below ``most``, no piece ends."""
        while first < most and first < len(self.last) and self.last[first] >= 0:
            first += 1
        return first


class Encoder(dict):
    """Token ids of pieces as native 32-bit numbers; ``learn`` has to meet a piece before it is looked up."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def learn(self, pieces: set[str]) -> None:
        """Work out pieces not met before, in order, so that each goes on from the prefix it shares with the last."""
        if len(self) > KEEP:
            self.clear()
        vocabulary = self.vocabulary
        get, known, fitting = vocabulary.ranks.get, vocabulary._follows.get, vocabulary.fitting
        follows, longest, tokens = vocabulary.follows, vocabulary.longest, vocabulary.tokens
        before, last = b"", [-1]
        for data in sorted(piece.encode() for piece in pieces if piece not in self):
            whole = get(data)
            if whole is not None:
                self[data.decode()] = array("i", [whole]).tobytes()
                continue
            shared = 0
            for a, b in zip(before, data):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                for length in fitting[end if end < longest else longest]:
                    begin = end - length
                    token = get(data[begin:end])
                    if token is not None:  # the one that fits behind the last token of the rest
                        fits = known((last[begin] + 1) << 32 | token)
                        if fits or fits is None and follows(last[begin], token):
                            last.append(token)
                            break
                else:
                    raise ValueError("no token ends here; single bytes are missing")
            before, found, at = data, [], len(data)
            while at:
                found.append(last[at])
                at -= len(tokens[last[at]])
            self[data.decode()] = array("i", found[::-1]).tobytes()

    def __call__(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts cut into pieces."""
        self.learn(set(itertools.chain.from_iterable(texts)))
        return [b"".join(map(self.__getitem__, pieces)) for pieces in texts]


def _lists(values: list[bytes]) -> pa.Array:
    """A list column from native 32-bit numbers."""
    ends = np.cumsum([0, *map(len, values)]) // 4
    flat = np.frombuffer(b"".join(values), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encode(docs: DataFrame, path: str, pattern: str, with_last: bool = False) -> DataFrame:
    """``(doc_id, ids)`` of each whole text, and ``last`` (see ``Encoded``) if asked for.

    ``path`` is a rank file, the same on every machine; each match of ``pattern`` is encoded separately, as the
    tokenizer library would, without special tokens. Narrow: a task holds a block of texts, the vocabulary, and
    a bounded store of pieces. Work grows with the length of a text, also of one endless piece.

    A null or empty text has no ids; repeated rows are encoded each; an empty table gives no rows; further
    columns are ignored.
    """
    exact = exact_pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, vocabulary = Splitter(pattern, exact), read_vocabulary(path)
        code = Encoder(vocabulary)
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for part in blocks([len(text) for text in texts]):
                columns = [batch.column("doc_id")[part], _lists(code([split.of(t).findall(t) for t in texts[part]]))]
                if with_last:
                    stored = [Encoded(vocabulary, split, text.encode()).last.tobytes() for text in texts[part]]
                    columns.append(_lists(stored))
                yield pa.RecordBatch.from_arrays(columns, fields)

    fields = ["doc_id", "ids"] + ["last"] * with_last
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, ids array<int>" + ", last array<int>" * with_last
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``data``, the bytes of its ``ids``; null ids have none.

    Every list of ids has bytes, be they valid text or not; other ids than the vocabulary's fail the task.
    """
    columns = [name for name in encoded.columns if name != "data"]
    given = encoded.select(*[f"`{name}`" for name in columns])
    place = columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = read_vocabulary(path).tokens
        for batch in batches:
            ids = batch.column(place)
            sizes = ids.value_lengths().fill_null(0).to_pylist()
            for part in blocks(sizes):
                own = ids[part]
                found = [b"".join([tokens[i] for i in row]) if row else b"" for row in _rows(own)]
                kept = [column[part] for column in batch.columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], [*names, "data"])

    names = [f"c{i}" for i in range(len(columns))]
    renamed = given.toDF(*names)
    schema = ", ".join(f"{name} {kind}" for name, kind in renamed.dtypes)
    return renamed.mapInArrow(run, schema + ", data binary").toDF(*columns, "data")


def _rows(lists: pa.Array) -> Iterator[list[int]]:
    flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
    at = 0
    for size in lists.value_lengths().fill_null(0).to_pylist():
        yield flat[at : at + size]
        at += size


def revise(stored: DataFrame, path: str, pattern: str) -> DataFrame:
    """Texts with their ``ids`` and ``last`` after one change each, worked out near the change only.

    ``stored`` has ``doc_id, text, last`` (from ``encode`` with ``with_last``) and the change: ``at`` and ``until``, places in
    characters of the text, and ``put``, the new text between them. ``at`` and ``until`` at the length of the text append.
    A null ``put`` is empty, null places are the end. Gives ``doc_id, text, ids, last``.
    """
    exact = exact_pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, vocabulary = Splitter(pattern, exact), read_vocabulary(path)
        for batch in batches:
            rows = batch.to_pylist()
            for part in blocks([len(row["text"] or "") for row in rows]):
                out = []
                for row in rows[part]:
                    text, put = row["text"] or "", row["put"] or ""
                    at = len(text) if row["at"] is None else min(max(row["at"], 0), len(text))
                    until = len(text) if row["until"] is None else min(max(row["until"], at), len(text))
                    own = Encoded(vocabulary, split, text.encode(), array("i", row["last"] or [0]))
                    start = len(text[:at].encode())
                    own.replace(start, start + len(text[at:until].encode()), put)
                    out.append((row["doc_id"], own.data.decode(), array("i", own.ids()).tobytes(), own.last.tobytes()))
                names, texts, ids, last = zip(*out)
                columns = [pa.array(names, batch.column("doc_id").type), pa.array(texts, pa.string()), _lists(ids), _lists(last)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "ids", "last"])

    kind = dict(stored.dtypes)["doc_id"]
    given = stored.select("doc_id", "text", "last", "at", "until", "put")
    return given.mapInArrow(run, f"doc_id {kind}, text string, ids array<int>, last array<int>")
