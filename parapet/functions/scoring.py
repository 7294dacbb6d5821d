"""Pluggable scorers for toxicity and sentiment.

A scorer is a ``Callable[[Column], Column]`` from the text column to a double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions.text import blank

Scorer = Callable[[Column], Column]


def no_score(_: Column) -> Column:
    """The disabled scorer."""
    return F.lit(0.0)


def stored_score(column: str) -> Scorer:
    """Take the score from a column; missing and NaN scores count as 0."""
    return lambda _: F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))


_RESULT = "score double, failed boolean"
# A model's batch: letters with the padding to its longest text, and texts.
BATCH_CHARS, BATCH_TEXTS = 1 << 18, 1024
# Letters of a task's texts that wait to be sorted by length.
HELD_CHARS = 1 << 23

Load = Callable[[], Callable[[list[str]], list]]


def length_batches(
    lengths: Sequence[int], most_chars: int = BATCH_CHARS, most_texts: int = BATCH_TEXTS
) -> Iterator[list[int]]:
    """Places of texts, shortest first, in batches that stay within ``most_chars`` when padded; a longer text is alone."""
    batch: list[int] = []
    for at in sorted(range(len(lengths)), key=lengths.__getitem__):
        if batch and (lengths[at] * (len(batch) + 1) > most_chars or len(batch) == most_texts):
            yield batch
            batch = []
        batch.append(at)
    if batch:
        yield batch


class _Task:
    """One loaded model, for all batches of a task."""

    def __init__(self, load: Load, label: str, on_error: str, most_chars: int, most_texts: int):
        self._label, self._bounds = label, (most_chars, most_texts)
        try:
            self._model = load()
        except Exception:
            if on_error == "raise":
                raise
            self._model = None

    def _value(self, result) -> float:
        if isinstance(result, (int, float)):
            return float(result)
        for entry in result:
            if entry.get("label") == self._label:
                return float(entry.get("score", 0.0))
        return 0.0

    def _batch(self, texts: list[str]) -> list[tuple[float, bool]]:
        try:
            results = [(self._value(r), False) for r in self._model(texts)]
            if len(results) == len(texts):
                return results
        except Exception:
            pass
        scores = []
        for text in texts:  # one bad text must not zero its whole batch
            try:
                scores.append((self._value(self._model([text])[0]), False))
            except Exception:
                scores.append((0.0, True))
        return scores

    def scores(self, texts: Sequence[str | None]) -> list[tuple[float, bool]]:
        """``(score, failed)`` of each text; null and blank ones are not given to the model."""
        found = [(0.0, False)] * len(texts)
        places = [i for i, text in enumerate(texts) if text is not None and text.strip()]
        for batch in length_batches([len(texts[i]) for i in places], *self._bounds):
            own = [places[i] for i in batch]
            results = self._batch([texts[i] for i in own]) if self._model else [(0.0, True)] * len(own)
            for i, result in zip(own, results):
                found[i] = result
        return found


def _checked(on_error: str) -> None:
    if on_error not in ("raise", "zero"):
        raise ValueError("on_error is 'raise' or 'zero'")


def model_result(
    load: Load, label: str = "toxicity", on_error: str = "raise", most_chars: int = BATCH_CHARS,
    most_texts: int = BATCH_TEXTS,
) -> Scorer:
    """As ``model_score``, but ``(score, failed)``: a text that fails scores 0 and says so."""
    _checked(on_error)

    @F.pandas_udf(_RESULT)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        task = _Task(load, label, on_error, most_chars, most_texts)
        for texts in batches:
            own = [None if text is None or text is pd.NA or text != text else text for text in texts]
            yield pd.DataFrame(task.scores(own), columns=["score", "failed"], index=texts.index)

    return score


def scored_table(
    df: DataFrame, load: Load, text: str, label: str = "toxicity", on_error: str = "raise",
    most_chars: int = BATCH_CHARS, most_texts: int = BATCH_TEXTS, held_chars: int = HELD_CHARS,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``df`` with ``score`` and ``failed``, scored in a stage of its own.

    Texts wait until a task holds ``held_chars`` letters and go to the model by length, so that short and long
    ones are not padded to each other; rows come out in their old order. A ``profile`` (see ``accelerators``) asks for
    executors of another kind for just this stage. The result is that of ``model_result``.
    """
    _checked(on_error)
    names = [name for name in df.columns if name not in ("score", "failed")]
    given = df.select(*[f"`{name}`" for name in names]).toDF(*[f"c{i}" for i in range(len(names))])
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(load, label, on_error, most_chars, most_texts)
        held: list[pa.RecordBatch] = []
        chars = 0

        def flush() -> Iterator[pa.RecordBatch]:
            texts = [t for batch in held for t in batch.column(place).to_pylist()]
            found, start = task.scores(texts), 0
            for batch in held:
                own = found[start : start + batch.num_rows]
                start += batch.num_rows
                score, failed = pa.array([s for s, _ in own], pa.float64()), pa.array([f for _, f in own], pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns, score, failed], [*batch.schema.names, "score", "failed"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # a batch of many long texts is held in parts
            step = max(1, batch.num_rows * held_chars // max(1, batch.column(place).nbytes))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                held.append(part)
                chars += pc.sum(pc.utf8_length(part.column(place))).as_py() or 0
                if chars >= held_chars:
                    yield from flush()
                    held, chars = [], 0
        if held:
            yield from flush()

    schema = ", ".join(f"{name} {kind}" for name, kind in given.dtypes)
    found = given.mapInArrow(run, f"{schema}, {_RESULT}", profile=profile)
    return found.toDF(*names, "score", "failed")


def accelerators(gpus: int, cores: int = 1, memory: str = "16g", discovery: str = "") -> ResourceProfile:
    """A profile of executors with ``gpus`` of them, one a task; clusters only, as a local master has one kind of executor."""
    executors = ExecutorResourceRequests().cores(cores).memory(memory)
    executors = executors.resource("gpu", gpus, discovery)
    tasks = TaskResourceRequests().cpus(1).resource("gpu", 1)
    return ResourceProfileBuilder().require(executors).require(tasks).build


def model_score(
    load: Load, label: str = "toxicity", on_error: str = "raise"
) -> Scorer:
    """Score with a model that ``load`` builds once per task.

    The model maps a list of texts to a list of ``[{"label": .., "score": ..}, ..]``
    rows or plain numbers. A text that fails, or a missing label, scores 0. A model that does not
    load fails the task, which Spark tries again elsewhere; with ``on_error='zero'`` all texts
    of the task score 0 instead. ``model_result`` tells failed texts from real zeros.
    """
    result = model_result(load, label, on_error)
    return lambda text: result(text)["score"]


def guarded(scorer: Scorer, text: Column) -> Column:
    """Blank text always scores 0."""
    return F.when(blank(text), F.lit(0.0)).otherwise(scorer(text)).cast("double")
