"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import blocks

DIMENSION = 1024
UNKNOWN = "und"
_CODES = 0x110000
_GRAMS = 4096
_CELLS = 1 << 22


def letter_vector(code: int, dimension: int = DIMENSION) -> np.ndarray:
    """The random vector of +1 and -1 of a letter, the same in every process."""
    digest = hashlib.shake_256(f"letter {code}".encode()).digest(dimension // 8)
    return (2 * np.unpackbits(np.frombuffer(digest, np.uint8)).astype(np.int8) - 1).astype(np.int8)


def profiles(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """One row per text: the sum of the vectors of its letter trigrams.

    Texts are lower-cased; whatever is not a letter is a word edge, a symbol of its own. The trigram around
    each letter binds its three symbols: their vectors, rotated by two, one and no places, are
    multiplied. All sums are of whole numbers, so they don't depend on the batch.
    """
    lower = [text.lower() for text in texts]
    codes = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(text) + 1 for text in lower])
    out = np.zeros((len(texts), dimension), np.float32)
    seen = np.zeros(_CODES, bool)
    seen[codes] = True
    letters = [code for code in np.flatnonzero(seen).tolist() if chr(code).isalpha()]
    if not letters:
        return out
    number = np.zeros(_CODES, np.int64)
    number[letters] = np.arange(1, len(letters) + 1)
    items = np.stack([letter_vector(code, dimension) for code in [ord(" "), *letters]])

    symbols = number[codes]
    middle = np.flatnonzero(symbols)
    many = len(items)
    grams = (symbols[middle - 1] * many + symbols[middle]) * many + symbols[middle + 1]
    if many**3 <= _CELLS:
        present = np.zeros(many**3, bool)
        present[grams] = True
        kinds = np.flatnonzero(present)
        which = (np.cumsum(present) - 1)[grams]
    else:
        kinds, which = np.unique(grams, return_inverse=True)
    edges = np.searchsorted(middle, np.concatenate([[0], ends]))
    step = max(1, _CELLS // len(kinds))
    first, second, third = np.roll(items, 2, axis=1), np.roll(items, 1, axis=1), items
    for at in range(0, len(texts), step):
        to = min(at + step, len(texts))
        own = which[edges[at] : edges[to]]
        rows = np.repeat(np.arange(to - at), np.diff(edges[at : to + 1]))
        counts = np.bincount(rows * len(kinds) + own, minlength=(to - at) * len(kinds))
        counts = counts.reshape(to - at, len(kinds)).astype(np.float32)
        for k in range(0, len(kinds), _GRAMS):
            part = kinds[k : k + _GRAMS]
            bound = first[part // many**2] * second[part // many % many] * third[part % many]
            out[at:to] += counts[:, k : k + _GRAMS] @ bound.astype(np.float32)
    return out


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[str]]]:
    texts = [text or "" for text in batch.column("text").to_pylist()]
    for part in blocks([len(text) for text in texts], rows=2048):
        yield part, texts[part]


def learn(docs: DataFrame, dimension: int = DIMENSION) -> dict[str, np.ndarray]:
    """The prototype of each language: the sum of its documents' profiles.

    ``docs`` holds ``(text, lang)``; rows where either is null teach nothing, nor do texts without
    letters. Each task sends one vector per language, so the driver gets ``dimension`` numbers for each language.
    """

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in items:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for part, texts in _batches(batch):
                found, own = profiles(texts, dimension), langs[part]
                for lang in set(own):
                    total = found[own == lang].sum(axis=0, dtype=np.float64)
                    sums[lang] = sums.get(lang, 0.0) + total
        vectors = pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), vectors], ["lang", "v"])

    rows = docs.filter("text is not null and lang is not null").select("text", "lang")
    parts = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v"))
    sums = parts.groupBy("lang", "pos").agg(F.sum("col").alias("v")).collect()
    found = {lang: np.zeros(dimension) for lang in sorted({r["lang"] for r in sums})}
    for r in sums:
        found[r["lang"]][r["pos"]] = r["v"]
    return {lang: v for lang, v in found.items() if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` without ``text``, with ``lang_pred`` and ``score``.

    ``docs`` holds ``text`` and whatever is to be kept; only the text is looked at, as a whole. The score is
    the cosine with the nearest prototype, 0 if it is negative; of equal ones the smaller
    language wins. A null text, one without letters, or no prototype at all gives ``und`` and 0.
    """
    names = sorted(prototypes)
    dimension = len(next(iter(prototypes.values()), np.zeros(DIMENSION)))
    matrix = np.array([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]).reshape(-1, dimension)
    kept = [c for c in docs.columns if c != "text"]

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            for part, texts in _batches(batch):
                found = profiles(texts, dimension).astype(np.float64)
                length = np.linalg.norm(found, axis=1)
                best, score = np.full(len(texts), -1), np.zeros(len(texts))
                if names:
                    near = found @ matrix.T / np.maximum(length, 1e-300)[:, None]
                    best = np.where(length > 0, near.argmax(axis=1), -1)
                    score = np.where(length > 0, near.max(axis=1).clip(0, 1), 0.0)
                columns = [batch.column(c).slice(part.start, part.stop - part.start) for c in kept]
                langs = [names[i] if i >= 0 else UNKNOWN for i in best]
                columns += [pa.array(langs, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def predict(docs: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document.

    Held out are documents whose ``crc32(doc_id) % 3`` is 1; the others teach. A null id is not held out.
    Repeated rows teach and are predicted each; an empty table gives no rows; further columns
    are ignored.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select("doc_id", fold.alias("held_out"), "text", "lang")
    prototypes = learn(rows.filter(~F.col("held_out")).select("text", "lang"), dimension)
    return identify(rows.drop("lang"), prototypes)
