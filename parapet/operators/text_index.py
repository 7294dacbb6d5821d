"""Text search by trigram signatures: narrow fixed-width bits rule rows out before wide texts are read."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.lexicon import REPORT_ROWS_MAX
from parapet.operators.filters import search_like, search_regex
from parapet.operators.listing import late_rows

#: Words of 64 bits in a row's signature, each a column of its own: a search reads only those it needs.
WORDS = 32
TEXTS = ("input_text", "output_text")
#: Letters of other scripts that a search in any case takes for these; all else outside ASCII is left to the exact test.
_LIKE_ASCII = {"İ": "i", "ı": "i", "ſ": "s", "K": "k"}
#: Bytes of text that a task works on at a time; a longer text is cut.
_PIECE = 1 << 18
#: Alternatives that a pattern may have before it is searched by a scan.
_MOST_ALTERNATIVES = 64


def _words() -> list[str]:
    return [f"s{i}" for i in range(WORDS)]


def _folded(text: Column) -> Column:
    letters = "".join(_LIKE_ASCII)
    return F.lower(F.translate(text, letters, "".join(_LIKE_ASCII.values())))


def _place(trigram: str) -> int:
    """The bit of an ASCII trigram in a signature."""
    return xxhash.xxh64_intdigest(trigram.encode(), 42) % (64 * WORDS)


class _Places:
    """Bits of trigrams by their number, of 21 bits; worked out when first met."""

    def __init__(self):
        self._known = np.full(1 << 21, -1, np.int16)

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        found = self._known[numbers]
        if (found < 0).any():
            for number in np.unique(numbers[found < 0]).tolist():
                self._known[number] = _place("".join(chr(number >> shift & 127) for shift in (14, 7, 0)))
            found = self._known[numbers]
        return found


def _add(bits: np.ndarray, texts: pa.Array, places: _Places) -> None:
    """Set the bits ``(row, place)`` of the ASCII trigrams in texts, a column of UTF-8."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or ends[-1] - ends[0] < 3:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    row_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
    for low in range(ends[0], ends[-1] - 2, _PIECE):
        own = data[low : min(low + _PIECE + 2, ends[-1])].astype(np.int32)
        row = row_of[low - ends[0] :][: len(own)]
        inside = (own[:-2] | own[1:-1] | own[2:]) < 128
        inside &= row[:-2] == row[2:]
        numbers = (own[:-2] << 14 | own[1:-1] << 7 | own[2:])[inside]
        bits.reshape(-1)[row[:-2][inside] * (64 * WORDS) + places(numbers)] = True


def signatures(df: DataFrame, columns: tuple[str, ...] = TEXTS) -> DataFrame:
    """``(id, timestamp, audit_date, s0, .. )``: for each row a bit for each ASCII trigram of its texts, in lower case.

    Bits are set in the task that reads the texts, for many rows at once, and only signatures leave it. Rows
    with one id, time and day share a signature. No text is left out and none shortened.
    """
    names = [f"_t{i}" for i in range(len(columns))]
    key = ["id", "timestamp", "audit_date"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                bits = np.zeros((batch.num_rows, 64 * WORDS), bool)
                for name in names:
                    _add(bits, batch.column(name), places)
                words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
                columns = [pa.array(np.ascontiguousarray(words[:, i]), pa.int64()) for i in range(WORDS)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), *columns], [*key, *_words()])

    texts = [_folded(F.coalesce(name, F.lit(""))).alias(n) for name, n in zip(columns, names)]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*key).schema)
    found = df.select(*key, *texts).mapInArrow(run, f"{kinds}, {', '.join(f'{w} bigint' for w in _words())}")
    return found.groupBy(*key).agg(*[F.bit_or(w).alias(w) for w in _words()])


def write_signatures(df: DataFrame, path: str, columns: tuple[str, ...] = TEXTS) -> None:
    """Add the signatures of ``df``, new rows of the stored table, to the index under ``path``."""
    signatures(df, columns).write.mode("append").parquet(path)


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    words = ", ".join(f"{name} bigint" for name in _words())
    return spark.read.schema(f"id bigint, timestamp string, audit_date date, {words}").parquet(path)


def _trigrams(run: str) -> set[str]:
    run = run.lower()
    return {run[i : i + 3] for i in range(len(run) - 2) if run[i : i + 3].isascii()}


def like_trigrams(term: str) -> list[set[str]] | None:
    """What a row must hold to match a LIKE term, as alternatives of trigrams; ``None`` if that cannot be told."""
    found = set().union(*(_trigrams(run) for run in re.split("[%_]", term.lower())))
    return [found] if found else None


def regex_trigrams(pattern: str) -> list[set[str]] | None:
    """The same for a regular expression: the literal runs that every match of some alternative holds.

    Only plain letters, groups, alternatives, classes, dots, anchors and repeats are understood; on anything
    else, or if an alternative has no run of three letters, the answer is ``None``.
    """
    try:
        alternatives, rest = _alternatives(pattern, 0)
    except (ValueError, IndexError):
        return None
    if rest != len(pattern) or len(alternatives) > _MOST_ALTERNATIVES:
        return None
    found = [set().union(*(_trigrams(run) for run in runs)) for runs in alternatives]
    return found if all(found) else None


def _alternatives(pattern: str, at: int) -> tuple[list[list[str]], int]:
    """Literal runs of each alternative up to the end or a closing bracket. A run's neighbours do not touch it."""
    done: list[list[str]] = []
    current: list[list[str]] = [[""]]

    def gap() -> None:
        for runs in current:
            runs.append("")

    while at < len(pattern) and pattern[at] != ")":
        char = pattern[at]
        options: list[list[str]] | None = None  # of a group
        literal = None
        at += 1
        if char == "|":
            done, current = done + current, [[""]]
            continue
        if char == "(":
            if pattern[at] == "?":
                if pattern[at + 1] != ":":
                    raise ValueError("a kind of group that is not understood")
                at += 2
            options, at = _alternatives(pattern, at)
            if pattern[at] != ")":
                raise ValueError("no closing bracket")
            at += 1
        elif char == "[":
            if pattern[at] == "^":
                at += 1
            at += pattern[at] == "]"
            while pattern[at] != "]":
                if pattern[at] in "[&":
                    raise ValueError("a class within a class")
                at += 2 if pattern[at] == "\\" else 1
            at += 1
        elif char == "\\":
            if pattern[at] in ".^$|()[]{}*+?\\/-":
                literal = pattern[at]
            elif pattern[at] not in "dDsSwWbB":
                raise ValueError("an escape that is not understood")
            at += 1
        elif char in "*+?{":
            raise ValueError("a repeat of nothing")
        elif char not in ".^$":
            literal = char
        least = 1
        repeated = at < len(pattern) and pattern[at] in "*+?{"
        if repeated:
            if pattern[at] == "{":
                bounds = re.match(r"\{(\d+)(,\d*)?\}", pattern[at:])
                if not bounds:
                    raise ValueError("a repeat that is not understood")
                least, at = int(bounds[1]), at + bounds.end()
            else:
                least, at = int(pattern[at] == "+"), at + 1
            if at < len(pattern) and pattern[at] in "?+":
                at += 1
        if literal is not None and not repeated:
            for runs in current:
                runs[-1] += literal
            continue
        gap()
        if options is not None and least:
            current = [runs + option for runs in current for option in options]
            if len(current) > _MOST_ALTERNATIVES:
                raise ValueError("too many alternatives")
            gap()
        elif literal is not None and least:
            for runs in current:
                runs[-1] += literal
            gap()
    return done + current, at


def may_hold(alternatives: Iterable[set[str]]) -> Column:
    """Whether a signature has the bits of all trigrams of some alternative."""
    options = []
    for trigrams in alternatives:
        masks: dict[int, int] = {}
        for p in map(_place, trigrams):
            masks[p >> 6] = masks.get(p >> 6, 0) | 1 << (p & 63)
        signed = {i: m - (1 << 64) if m >> 63 else m for i, m in masks.items()}
        tests = [F.col(f"s{i}").bitwiseAND(F.lit(m).cast("bigint")) == F.lit(m).cast("bigint") for i, m in sorted(signed.items())]
        options.append(reduce(lambda a, b: a & b, tests))
    return reduce(lambda a, b: a | b, options)


def _searched(df: DataFrame, index: DataFrame, alternatives: list[set[str]] | None, exact: Column, few: int) -> DataFrame:
    if alternatives is None:
        return df.filter(exact)
    found = index.filter(may_hold(alternatives)).select("id", "timestamp", "audit_date")
    chosen = found.limit(few + 1).collect()
    if len(chosen) <= few:
        rows = df.sparkSession.createDataFrame(chosen, found.schema) if chosen else found.limit(0)
        return late_rows(df, rows, few).filter(exact)
    days = found.select("audit_date").distinct()
    same = df["audit_date"].eqNullSafe(days["audit_date"])
    return df.join(F.broadcast(days), same, "left_semi").filter(exact)  # one row for each day


def find_like(df: DataFrame, index: DataFrame, term: str, few: int = REPORT_ROWS_MAX) -> DataFrame:
    """The rows of ``filters.search_like``, read by way of the signatures of the stored table ``df``.

    Of rows that may match, at most ``few``, only days and row groups with some of them are read; of more, the days. The
    exact test runs on whatever is read. A term without a trigram outside its wildcards scans the table.
    """
    return _searched(df, index, like_trigrams(term), search_like(term), few)


def find_regex(df: DataFrame, index: DataFrame, pattern: str, few: int = REPORT_ROWS_MAX) -> DataFrame:
    """The rows of ``filters.search_regex`` likewise; a pattern that no trigram is certain for scans the table."""
    return _searched(df, index, regex_trigrams(pattern), search_regex(pattern), few)
