"""Predicates over the audit table and their conjunction."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions.risk import status_label


def equals(column: str, value) -> Column:
    return F.col(column) == F.lit(value)


def search_like(term: str) -> Column:
    """Case-insensitive LIKE on either text; ``%`` and ``_`` in the term are wildcards."""
    # the term is no escape sequence, but a backslash is Spark's LIKE escape
    pattern = "%" + term.lower().replace("\\", "\\\\") + "%"
    return F.lower("input_text").like(pattern) | F.lower("output_text").like(pattern)


def search_regex(pattern: str) -> Column:
    """Case-insensitive regex on either text; null text never matches."""
    flagged = "(?iu)" + pattern
    hit = [F.coalesce(F.col(c).rlike(flagged), F.lit(False)) for c in ("input_text", "output_text")]
    return hit[0] | hit[1]


def _items(values: str | Iterable[str]) -> list[str]:
    if isinstance(values, str):
        values = values.split(",")
    return [v.strip() for v in values if v.strip()]


def has_all(column: str, values: str | Iterable[str]) -> Column:
    """The array holds every value (comma string or list)."""
    return conjunction([F.array_contains(column, v) for v in _items(values)])


def has_any(column: str, values: Iterable[str]) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values]))


def text_dates(start: str | None, end: str | None, prune_days: bool = False) -> Column:
    """Inclusive day range, compared lexically on the stored timestamp text.

    Set ``prune_days`` when every stored timestamp is ISO text without a zone offset:
    the range then also bounds the partition column, so other days are never read.
    """
    bounds = []
    if start:
        bounds.append(F.col("timestamp") >= f"{start}T00:00:00")
        if prune_days:
            bounds.append(F.col("audit_date") >= F.lit(start).cast("date"))
    if end:
        bounds.append(F.col("timestamp") <= f"{end}T23:59:59.999999")
        if prune_days:
            bounds.append(F.col("audit_date") <= F.lit(end).cast("date"))
    return conjunction(bounds)


def calendar_dates(start: str, end: str) -> Column:
    """Inclusive range on the parsed calendar day; unparsed rows drop out."""
    return F.col("audit_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def status_in(statuses: Iterable[str]) -> Column:
    return status_label(F.col("flagged")).isin(*statuses)


def at_least_toxic(minimum: float) -> Column:
    """Toxicity at or above the minimum; no restriction for a minimum of 0."""
    if minimum <= 0:
        return F.lit(True)
    return (F.col("toxicity_score") >= minimum) & ~F.isnan("toxicity_score")


def present(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def conjunction(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


@dataclass(frozen=True)
class AuditFilter:
    """Optional filters of the listing and report; unset ones do not restrict."""

    search: str | None = None
    flagged: bool | None = None
    project_name: str | None = None
    model_name: str | None = None
    user_id: str | None = None
    tag: str | None = None
    risk_label: str | None = None
    start_date: str | None = None
    end_date: str | None = None
    prune_days: bool = False

    def predicate(self) -> Column:
        parts = []
        if self.flagged is not None:
            parts.append(equals("flagged", self.flagged))
        for name in ("project_name", "model_name", "user_id"):
            if getattr(self, name):
                parts.append(equals(name, getattr(self, name)))
        if self.search:
            parts.append(search_like(self.search))
        if self.tag:
            parts.append(has_all("tags", self.tag))
        if self.risk_label:
            parts.append(has_all("risk_labels", self.risk_label))
        parts.append(text_dates(self.start_date, self.end_date, self.prune_days))
        return conjunction(parts)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.predicate())


@dataclass(frozen=True)
class BoardFilter:
    """The dashboard's filters: multi-selects are any-of, the search is a regex."""

    statuses: tuple[str, ...] = ("Flagged", "Safe")
    search: str | None = None
    min_toxicity: float = 0.0
    projects: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    users: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    risk_labels: tuple[str, ...] = ()
    pii_only: bool = False
    refusal_only: bool = False
    dates: tuple[str, str] | None = None

    def predicate(self) -> Column:
        parts = [status_in(self.statuses)]
        if self.search:
            parts.append(search_regex(self.search))
        parts.append(at_least_toxic(self.min_toxicity))
        for column, chosen in (
            ("project_name", self.projects),
            ("model_name", self.models),
            ("user_id", self.users),
        ):
            if chosen:
                parts.append(F.col(column).isin(*chosen))
        if self.tags:
            parts.append(has_any("tags", self.tags))
        if self.risk_labels:
            parts.append(has_any("risk_labels", self.risk_labels))
        if self.pii_only:
            parts.append(F.col("has_pii"))
        if self.refusal_only:
            parts.append(F.col("is_refusal"))
        if self.dates:
            parts.append(calendar_dates(*self.dates))
        return conjunction(parts)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.predicate())
