"""Explicit schemas. Nothing in this package infers types from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(name, kind, True) for name in names]


_STRINGS = T.ArrayType(T.StringType())

CONVERSATION_FIELDS = [
    "input_text",
    "output_text",
    "project_name",
    "model_name",
    "user_id",
    "request_id",
    "tags",
    "timestamp",
]
REQUIRED_FIELDS = ["input_text", "output_text"]
META_FIELDS = ["project_name", "model_name", "user_id", "request_id"]

# What a conversation looks like once its tags are normalised.
CONVERSATION_SCHEMA = T.StructType(
    _fields(T.StringType(), "input_text", "output_text", *META_FIELDS)
    + _fields(_STRINGS, "tags")
    + _fields(T.StringType(), "timestamp")
)

# What a text source delivers: every field as text, tags still in raw form.
RAW_CONVERSATION_SCHEMA = T.StructType(_fields(T.StringType(), *CONVERSATION_FIELDS))

FLAG_COLUMNS = ["has_pii", "is_refusal", "self_harm", "jailbreak", "bias"]
LIST_COLUMNS = ["risk_labels", "risk_explanations", "pii_types", "tags"]

# Column order of the stored audit table; ts and audit_date are derived from
# timestamp, and audit_date is the partition column (hence last).
AUDIT_SCHEMA = T.StructType(
    _fields(T.LongType(), "id")
    + _fields(T.StringType(), "timestamp", "input_text", "output_text")
    + _fields(T.DoubleType(), "toxicity_score")
    + _fields(T.BooleanType(), *FLAG_COLUMNS)
    + _fields(T.DoubleType(), "sentiment_score")
    + _fields(_STRINGS, "risk_labels", "risk_explanations", "pii_types")
    + _fields(T.BooleanType(), "flagged", "redaction_applied")
    + _fields(T.IntegerType(), "redaction_count")
    + _fields(T.StringType(), *META_FIELDS)
    + _fields(_STRINGS, "tags")
    + _fields(T.TimestampType(), "ts")
    + _fields(T.DateType(), "audit_date")
)
AUDIT_COLUMNS = [f.name for f in AUDIT_SCHEMA.fields if f.name not in ("ts", "audit_date")]

LABEL_COLUMNS = [
    "label_toxicity",
    "label_pii",
    "label_refusal",
    "label_self_harm",
    "label_jailbreak",
    "label_bias",
]
LABELED_SCHEMA = T.StructType(
    _fields(T.StringType(), "input_text", "output_text")
    + _fields(T.StringType(), *LABEL_COLUMNS)
)
# JSON texts of a label that mean false, in lower case.
FALSE_TEXTS = ["", "false", "0", "0.0", "-0.0", "[]", "{}"]

# Texts keep blanks at both ends; '""' is the escaped quote.
CSV_READ = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
CSV_WRITE = {**CSV_READ, "emptyValue": ""}

_SCORE = T.StructType(
    _fields(T.BooleanType(), "skipped")
    + _fields(T.LongType(), "tp", "fp", "tn", "fn")
    + _fields(T.DoubleType(), "precision", "recall", "f1")
)
METRICS_DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("signals", T.MapType(T.StringType(), _SCORE), True),
        T.StructField("combined", _SCORE, True),
        T.StructField("threshold", T.DoubleType(), True),
        T.StructField("enable_toxicity", T.BooleanType(), True),
    ]
)

QUOTA_FIELDS = "allowed boolean, remaining bigint, reset_s bigint, quota bigint"
