"""Shaping raw rows: tags, defaults, validation, missing columns, dense ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.functions.text import (
    blank,
    clean_list,
    decode_flag,
    decode_list,
    decode_number_flag,
    filled,
    strip,
    tags_from_raw,
)
from parapet.schemas import (
    AUDIT_SCHEMA,
    CONVERSATION_FIELDS,
    FLAG_COLUMNS,
    LIST_COLUMNS,
    META_FIELDS,
    REQUIRED_FIELDS,
)
from parapet.session import cut_lineage


def normalize_tags(df: DataFrame, column: str = "tags") -> DataFrame:
    """Raw tags (array, JSON text or comma string) to a clean string array."""
    raw = F.col(column)
    if isinstance(df.schema[column].dataType, T.ArrayType):
        clean = clean_list(raw.cast("array<string>"))
    elif isinstance(df.schema[column].dataType, T.StringType):
        clean = tags_from_raw(raw)
    else:  # any other single value is one tag, as text
        value = raw.cast("string")
        if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(raw), value)
        clean = F.coalesce(
            F.when(value.isNotNull(), F.array(value)), F.array().cast("array<string>")
        )
    return df.withColumn(column, clean)


def to_conversations(df: DataFrame) -> DataFrame:
    """Any frame with (some of) the conversation fields to the conversation form.

    Required texts that are null become ``''``; absent optional fields become null.
    Other columns, such as an id, are kept.
    """
    present = set(df.columns)
    kept = [c for c in df.columns if c not in CONVERSATION_FIELDS]
    columns = []
    for name in CONVERSATION_FIELDS:
        column = F.col(name) if name in present else F.lit(None)
        if name in REQUIRED_FIELDS:
            column = F.coalesce(column.cast("string"), F.lit(""))
        elif name != "tags":
            column = column.cast("string")
        elif name not in present:
            column = column.cast("array<string>")
        columns.append(column.alias(name))
    return normalize_tags(df.select(*kept, *columns))


def _default_tags(tags: list[str] | None) -> Column:
    return F.array(*[F.lit(t) for t in tags or []]).cast("array<string>")


def fill_missing(df: DataFrame, tags: list[str] | None = None, **defaults: str | None) -> DataFrame:
    """Batch defaults for null meta fields, and for empty tag lists."""
    return _fill(df, tags, defaults, lambda column, value: F.coalesce(column, F.lit(value)))


def fill_falsy(df: DataFrame, tags: list[str] | None = None, **defaults: str | None) -> DataFrame:
    """The stronger rule of uploads: null and ``''`` meta fields take the default."""
    return _fill(df, tags, defaults, filled)


def _fill(df, tags, defaults, rule) -> DataFrame:
    unknown = set(defaults) - set(META_FIELDS)
    if unknown:
        raise ValueError(f"no default possible for: {', '.join(sorted(unknown))}")
    columns = {
        name: rule(F.col(name), value) for name, value in defaults.items() if value is not None
    }
    columns["tags"] = F.when(F.size("tags") == 0, _default_tags(tags)).otherwise(F.col("tags"))
    return df.withColumns(columns)


def fill_timestamp(df: DataFrame, batch_time: Column | str) -> DataFrame:
    """Rows without a timestamp get the time of their batch."""
    return df.withColumn("timestamp", filled(F.col("timestamp"), batch_time))


def strip_fields(df: DataFrame) -> DataFrame:
    """Trim every text field; optional fields that end up empty become null."""
    columns = {}
    for name in CONVERSATION_FIELDS:
        if name in REQUIRED_FIELDS:
            columns[name] = strip(F.col(name))
        elif name != "tags":
            columns[name] = F.nullif(strip(F.col(name)), F.lit(""))
    return df.withColumns(columns)


def with_reject_reason(df: DataFrame) -> DataFrame:
    """Add ``reject_reason``: why a row cannot be audited, or null if it can."""
    missing = [F.when(blank(F.col(c)), F.lit(f"{c} is required")) for c in REQUIRED_FIELDS]
    reasons = F.array_compact(F.array(*missing))
    if "_corrupt_record" in df.columns:
        reasons = F.when(
            F.col("_corrupt_record").isNotNull(), F.array(F.lit("malformed record"))
        ).otherwise(reasons)
    return df.withColumn("reject_reason", F.nullif(F.array_join(reasons, "; "), F.lit("")))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid rows, rejected rows with their reason)``."""
    checked = with_reject_reason(df)
    return (
        checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        checked.filter(F.col("reject_reason").isNotNull()),
    )


def ensure_columns(df: DataFrame) -> DataFrame:
    """Add the audit columns an older table may lack, with their defaults."""
    empty = F.array().cast("array<string>")
    defaults = {
        **{name: F.lit("") for name in META_FIELDS},
        **{name: empty for name in LIST_COLUMNS},
        **{name: F.lit(False) for name in ("self_harm", "jailbreak", "bias", "redaction_applied")},
        "redaction_count": F.lit(0),
    }
    absent = {n: c for n, c in defaults.items() if n not in df.columns}
    return df.withColumns(absent) if absent else df


def decode_row(df: DataFrame) -> DataFrame:
    """Read view over a table that stores lists as JSON text and flags as 0/1 or text."""
    columns = {}
    types = {f.name: f.dataType for f in df.schema.fields}
    for name in LIST_COLUMNS:
        if isinstance(types.get(name), T.StringType):
            columns[name] = decode_list(F.col(name))
    for name in [*FLAG_COLUMNS, "flagged", "redaction_applied"]:
        kind = types.get(name)
        if isinstance(kind, T.StringType):
            columns[name] = decode_flag(F.col(name))
        elif isinstance(kind, T.NumericType):
            columns[name] = decode_number_flag(F.col(name))
        elif isinstance(kind, T.BooleanType):
            columns[name] = F.coalesce(F.col(name), F.lit(False))
    if "redaction_count" in types:
        columns["redaction_count"] = F.coalesce(F.col("redaction_count").cast("int"), F.lit(0))
    return df.withColumns(columns)


def assign_ids(df: DataFrame, first: int = 1, column: str = "id") -> DataFrame:
    """Dense ids ``first, first+1, ...`` in scan order, without a global sort.

    Rows are written once with their place inside their partition and numbered from there,
    so ids hold whatever partitions a second run of ``df`` would give. The only
    shared fact is one row count per partition. For tables that are appended to, see
    ``append_batch``.
    """
    numbered = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()), "ids")
    return dense_numbers(numbered, "_row", column, first)


# One (partition, start) pair is 16 bytes, so this many stay below 16 MB.
_BROADCAST_PARTITIONS = 1_000_000


def dense_numbers(df: DataFrame, row: str, column: str, first: int = 1) -> DataFrame:
    """Turn stored ``monotonically_increasing_id`` values into dense numbers."""
    partition = F.shiftright(row, 33)
    sizes = df.groupBy(partition.alias("_part")).agg(F.count("*").alias("_rows"))
    # one row per partition of the scan, so a single-task running sum is enough
    starts = sizes.selectExpr(
        "_part", "sum(_rows) over (partition by 0 order by _part) - _rows as _start"
    )
    # the planner cannot know that the starts are few, and would shuffle the rows
    starts = cut_lineage(starts, "starts")
    few = starts.limit(_BROADCAST_PARTITIONS + 1).count() <= _BROADCAST_PARTITIONS
    starts = F.broadcast(starts) if few else starts
    position = F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        df.withColumn("_part", partition)
        .join(starts, "_part")
        .withColumn(column, F.col("_start") + position + F.lit(first))
        .drop(row, "_part", "_start")
    )


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union of conversation sources, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def empty_audit(spark) -> DataFrame:
    return spark.createDataFrame([], AUDIT_SCHEMA)
