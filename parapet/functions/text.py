"""Text, list and flag helpers, all as JVM-side column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parapet.lexicon import SPACE_CLASS, TRUE_WORDS

_STRING_LIST = "array<string>"


def blank(text: Column) -> Column:
    """True for null, empty and white-space-only text (Unicode white space)."""
    return F.coalesce(~text.rlike(f"[^{SPACE_CLASS}]"), F.lit(True))


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends, in linear time."""
    edge = f"^[{SPACE_CLASS}]++|(?<![{SPACE_CLASS}])[{SPACE_CLASS}]++\\z"
    return F.regexp_replace(text, edge, "")


def filled(value: Column, default: Column | str | None) -> Column:
    """``value``, or ``default`` where it is null or empty."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value, F.lit("")), fallback.cast("string"))


def clean_list(items: Column) -> Column:
    """Trim the items of a string array; drop null and empty ones."""
    kept = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.coalesce(kept, F.array().cast(_STRING_LIST))


def tags_from_text(raw: Column) -> Column:
    """Tags from a comma-separated string; null gives an empty list."""
    return clean_list(F.split(raw, ","))


def tags_from_raw(raw: Column) -> Column:
    """Tags from a raw text field that may hold a JSON array or a comma string."""
    # One JSON parse: PERMISSIVE mode yields null for anything but an array.
    listed = F.when(raw.startswith("["), F.from_json(raw, _STRING_LIST))
    return clean_list(F.coalesce(listed, F.split(raw, ",")))


def decode_list(value: Column) -> Column:
    """Decode a JSON list; null or '' gives [], anything else gives [value]."""
    missing = value.isNull() | (value == "")
    listed = F.when(strip(value).startswith("["), F.from_json(value, _STRING_LIST))
    return F.when(missing, F.array().cast(_STRING_LIST)).otherwise(
        F.coalesce(listed, F.array(value))
    )


def encode_list(items: Column) -> Column:
    """Encode a string array as JSON with ``", "`` between items, ASCII only."""

    def quoted(item: Column) -> Column:
        text = F.to_json(F.array(item), {"writeNonAsciiCharacterAsCodePoint": "true"})
        return F.substring(text, F.lit(2), F.length(text) - 2)

    listed = F.coalesce(items, F.array().cast(_STRING_LIST))
    return F.concat(F.lit("["), F.array_join(F.transform(listed, quoted), ", "), F.lit("]"))


def decode_flag(value: Column) -> Column:
    """Text flag to boolean; null is false."""
    return F.coalesce(F.lower(strip(value)).isin(TRUE_WORDS), F.lit(False))


def decode_number_flag(value: Column) -> Column:
    """Numeric flag to boolean: any non-zero is true (NaN too), null is false."""
    return F.coalesce(value != 0, F.lit(False))


def first_phrase(lowered: Column, phrases: list[str]) -> Column:
    """First phrase of the list, in list order, that ``lowered`` contains."""
    return F.coalesce(*[F.when(lowered.contains(p), F.lit(p)) for p in phrases])


def any_phrase(lowered: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(p) for p in phrases])


def fixed(value: Column, digits: int) -> Column:
    """Decimal text of a double with ``digits`` (1..3) decimals, rounded exactly.

    The JVM formatter rounds the shortest decimal form half-up, so 0.705 (which is
    below 0.705 in binary) becomes 0.71 there. Here the fraction is scaled to an
    integer count of 2**-53, where rounding is exact arithmetic. Values outside
    0 <= value < 2**43 take the JVM formatter.
    """
    if digits not in (1, 2, 3):
        raise ValueError("digits must be 1, 2 or 3")
    unit, power = 1 << 53, 10**digits
    inside = F.when((value >= 0) & (value < float(1 << 43)), value)
    ones = F.floor(inside).cast("bigint")
    scaled = (inside - ones) * F.lit(float(unit))
    count = scaled.cast("bigint")
    # what the count cut off is a double of few bits, so scaling it is exact as well
    cut = (scaled - count) * F.lit(float(power))
    product = count * F.lit(power) + cut.cast("bigint")
    # Rounding half to even: a tie moves up only from an odd digit, or when some rest
    # below the product lies above the tie.
    nudge = F.greatest(
        F.shiftright(product, 53).bitwiseAND(F.lit(1)), (cut > F.floor(cut)).cast("bigint")
    )
    decimals = F.shiftright(product + F.lit((unit >> 1) - 1) + nudge, 53)
    total = ones * F.lit(power) + decimals
    exact = F.concat(
        ((total - total % power) / power).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((total % power).cast("string"), digits, "0"),
    )
    other = F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))
    return F.coalesce(exact, other)
