"""Batch sources. Schemas are explicit; every field arrives as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parapet.functions.text import strip
from parapet.operators.audit import with_time
from parapet.operators.normalize import (
    decode_row,
    ensure_columns,
    fill_falsy,
    to_conversations,
)
from parapet.schemas import (
    AUDIT_COLUMNS,
    AUDIT_SCHEMA,
    CONVERSATION_FIELDS,
    CONVERSATION_SCHEMA,
    CSV_READ,
    FALSE_TEXTS,
    LABEL_COLUMNS,
    LABELED_SCHEMA,
    METRICS_DOCUMENT_SCHEMA,
    RAW_CONVERSATION_SCHEMA,
    REQUIRED_FIELDS,
)
from parapet.session import cut_lineage


def missing_columns(present: list[str]) -> list[str]:
    return sorted(set(REQUIRED_FIELDS) - set(present))


def missing_fields(record: Column) -> Column:
    """The required fields that a JSON record lacks, sorted; all of them for text that is no object."""
    present = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(F.array(*[F.lit(c) for c in REQUIRED_FIELDS]), present))


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Conversations from CSV with a header, columns matched by name.

    Large files are split over tasks. ``multi_line`` allows line breaks inside quoted
    fields, at the price of one task per file; without it such a row fails the read, as
    do files whose header differs from the first one's, rather than shift columns.
    Blank cells are null.
    """
    options = {**CSV_READ, "multiLine": multi_line, "inferSchema": False, "mode": "FAILFAST"}
    header = spark.read.options(**options).csv(path).columns  # reads one header line
    absent = missing_columns(header)
    if absent:
        raise ValueError(f"Missing required columns: {', '.join(absent)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.options(**options, enforceSchema=False).schema(schema).csv(path)
    return to_conversations(rows.select(*[c for c in CONVERSATION_FIELDS if c in header]))


def read_jsonl(
    spark: SparkSession, path: str | list[str], mode: str = "FAILFAST"
) -> DataFrame:
    """Conversations from JSON lines; ``tags`` may be an array or a comma string.

    Blank lines are skipped. A malformed line fails the read unless ``mode`` says
    otherwise.
    """
    rows = spark.read.schema(RAW_CONVERSATION_SCHEMA).option("mode", mode).json(path)
    return to_conversations(rows)


_RECORDS = T.ArrayType(RAW_CONVERSATION_SCHEMA)


def read_payload(
    spark: SparkSession, path: str | list[str], mode: str = "FAILFAST"
) -> DataFrame:
    """Conversations from batch documents ``{"records": [..]}``, one per file.

    ``tags`` may be an array or a comma string. A malformed document fails the read
    unless ``mode`` says otherwise; ``split_payload`` quarantines instead.
    """
    schema = T.StructType([T.StructField("records", _RECORDS)])
    documents = spark.read.schema(schema).options(multiLine=True, mode=mode).json(path)
    return to_conversations(documents.select(F.inline("records")))


def payload_rows(df: DataFrame, column: str) -> DataFrame:
    """The same from a text column that holds a JSON array of records.

    A malformed document fails the query; null documents have no records.
    """
    records = F.from_json(F.col(column), _RECORDS, {"mode": "FAILFAST"})
    return to_conversations(df.select(F.inline(records)))


def split_payload(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` of a text column with JSON arrays of records.

    Records keep the other columns of ``df``. Rejected are documents that do not parse,
    whole and with their text, so every document is in one of the two.
    """
    parsed = df.withColumn("_records", F.from_json(F.col(column), _RECORDS))
    whole = F.col("_records").isNotNull()
    others = [c for c in df.columns if c != column]
    records = parsed.filter(whole).select(*others, F.inline("_records"))
    rejects = parsed.filter(~whole).drop("_records")
    return to_conversations(records), rejects.withColumn("reject_reason", F.lit("malformed document"))


def read_upload(
    spark: SparkSession, path: str, tags: list[str] | None = None, **defaults: str | None
) -> DataFrame:
    """An uploaded CSV or JSONL file, by its suffix, with batch defaults.

    A CSV upload may hold line breaks in its fields, so it is read by one task.
    """
    rows = read_csv(spark, path, True) if path.endswith(".csv") else read_jsonl(spark, path)
    return fill_falsy(rows, tags, **defaults)


def from_rows(spark: SparkSession, rows) -> DataFrame:
    """Conversations from mappings or ``(input, output)`` pairs already in memory."""
    table = []
    for row in rows:
        if isinstance(row, dict):
            tags = row.get("tags")
            if isinstance(tags, str):
                tags = tags.split(",")
            elif tags is not None and not isinstance(tags, (list, tuple)):
                # a lone number is one tag, NaN is none
                tags = [] if tags != tags else [tags]
            cells = [row.get(c) for c in CONVERSATION_FIELDS]
            cells[CONVERSATION_FIELDS.index("tags")] = [str(t) for t in tags or []]
            cells = [c if c is None or isinstance(c, list) else str(c) for c in cells]
        elif isinstance(row, (list, tuple)) and len(row) >= 2:
            cells = [str(row[0]), str(row[1]), None, None, None, None, [], None]
        else:
            raise ValueError("Unsupported conversation record format")
        table.append(tuple(cells))
    return to_conversations(spark.createDataFrame(table, CONVERSATION_SCHEMA))


def read_audit_table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The stored audit table; filters on ``audit_date`` skip whole partitions.

    A ``batch_id`` level below the days, as ``append_batch`` and ``ingest`` write it, is dropped.
    """
    rows = spark.read.options(**options).schema(AUDIT_SCHEMA).parquet(path)
    return rows.select(*AUDIT_SCHEMA.names)


def read_exported(
    spark: SparkSession, path: str | None = None, source: str = "csv", **options
) -> DataFrame:
    """Audit rows from a store that keeps lists as JSON text and flags as 0/1 or text.

    That is the form of a CSV export and of a database table; ``source`` and ``options``
    may name any Spark data source, such as ``jdbc`` with its partitioning options.
    Columns an older store lacks get their defaults.
    """
    if source == "csv":
        options = {**CSV_READ, "multiLine": True, "mode": "FAILFAST", **options}
    rows = decode_row(ensure_columns(spark.read.format(source).options(**options).load(path)))
    types = {f.name: f.dataType for f in AUDIT_SCHEMA.fields}
    return with_time(rows.select(*[F.col(c).cast(types[c]).alias(c) for c in AUDIT_COLUMNS]))


def _labels(rows: DataFrame) -> DataFrame:
    labels = [F.coalesce(~F.lower(strip(F.col(c))).isin(FALSE_TEXTS), F.lit(False)) for c in LABEL_COLUMNS]
    return rows.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in REQUIRED_FIELDS],
        *[label.alias(c) for label, c in zip(labels, LABEL_COLUMNS)],
    )


def read_labeled(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Labeled rows; a missing label is false, a missing text is ''.

    Labels go by truth: ``true``, ``1`` and ``"yes"`` are true; null, zero, ``false``, empty
    texts and lists are false. A malformed line fails the read.
    """
    return _labels(spark.read.schema(LABELED_SCHEMA).option("mode", "FAILFAST").json(path))


def split_labeled(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: malformed lines are set aside with their text.

    Lines are parsed once and stored, so both parts come from one reading.
    """
    schema = T.StructType([*LABELED_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    rows = cut_lineage(rows, "labeled")
    broken = F.col("_corrupt_record").isNotNull()
    rejects = rows.filter(broken).select(
        F.col("_corrupt_record").alias("line"), F.lit("malformed record").alias("reject_reason")
    )
    return _labels(rows.filter(~broken)), rejects


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The per-signal rows of a nested metrics document; a malformed one fails the read."""
    reader = spark.read.schema(METRICS_DOCUMENT_SCHEMA).options(multiLine=True, mode="FAILFAST")
    document = reader.json(path)
    return document.select(F.explode("signals").alias("signal", "m")).select("signal", "m.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The JSON report that ``write_documents`` wrote: one document a line, the summary among them."""
    lines = spark.read.text(path).withColumnRenamed("value", "document")
    summary = F.get_json_object("document", "$.generated_at").isNotNull()
    return lines.select(F.when(summary, "summary").otherwise("record").alias("kind"), "document")
