"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.functions.text import encode_list
from parapet.operators.filters import AuditFilter
from parapet.operators.normalize import dense_numbers
from parapet.schemas import AUDIT_COLUMNS, CSV_WRITE, LIST_COLUMNS
from parapet.session import cut_lineage
from parapet.sources.readers import read_audit_table


#: Columns that rows are looked up by; each row group says by a Bloom filter which of their values it may hold.
LOOKUP_COLUMNS = ("id", "request_id", "user_id")
_BLOOM = {
    "parquet.bloom.filter.adaptive.enabled": "true",  # as small as the values of a row group allow
    **{f"parquet.bloom.filter.enabled#{name}": "true" for name in LOOKUP_COLUMNS},
}


def write_audit_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append audited rows to the table, partitioned by day.

    The rebalance hint gathers each day into few files, and lets adaptive execution
    split a day that holds much of the data over several tasks. Inside a file rows are
    sorted by time, so that row groups can be skipped by it.
    """
    (
        df.hint("rebalance", F.col("audit_date"))
        .sortWithinPartitions("audit_date", "timestamp")
        .write.mode(mode)
        .options(**_BLOOM)
        .partitionBy("audit_date")
        .parquet(path)
    )


# Room for the rows of one batch in an id.
BATCH_ID_BITS = 40


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Append audited rows as batch number ``batch``, with ids that stay unique over batches.

    Ids are ``(batch << 40) + 1, + 2, ...``. The batch owns a ``batch_id`` level below each
    day and overwrites just that, so repeating a batch after a failure leaves no second
    copy. A batch number must not be used for other rows. Rows are written once with
    their place, and numbered from there: no second run of the audit decides an id.
    """
    placed = df.drop("id").withColumn("_row", F.monotonically_increasing_id())
    rows = dense_numbers(cut_lineage(placed, "batch"), "_row", "id", (batch << BATCH_ID_BITS) + 1)
    write_day_batches(rows.select(*df.columns) if "id" in df.columns else rows, path, batch)


def write_day_batches(rows: DataFrame, path: str, batch: int) -> None:
    """Write rows below ``audit_date=../batch_id=..``, replacing what the batch had there."""
    (
        rows.withColumn("batch_id", F.lit(batch).cast("long"))
        .hint("rebalance", F.col("audit_date"))
        .sortWithinPartitions("audit_date", "timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**_BLOOM)
        .partitionBy("audit_date", "batch_id")
        .parquet(path)
    )


def compact(spark, source: str, target: str) -> None:
    """Rewrite a table of many small batch files with few files per day, as a new table.

    The source stays as it is, so readers switch over when the new table is complete.
    """
    write_audit_table(read_audit_table(spark, source), target, mode="errorifexists")


def csv_form(df: DataFrame) -> DataFrame:
    """The stored columns with lists as JSON text and flags as 0/1."""
    columns = []
    for name in AUDIT_COLUMNS:
        if name in LIST_COLUMNS:
            columns.append(encode_list(F.col(name)).alias(name))
        elif dict(df.dtypes)[name] == "boolean":
            columns.append(F.col(name).cast("int").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def export_csv(df: DataFrame, path: str, filters: AuditFilter | None = None) -> None:
    """Export the (filtered) table as CSV shards, each with a header; texts keep their blanks."""
    rows = csv_form((filters or AuditFilter()).apply(df))
    rows.write.mode("errorifexists").options(**CSV_WRITE).csv(path)


def write_metrics(document: DataFrame, path: str) -> None:
    """The nested metrics document: a single row."""
    document.coalesce(1).write.mode("errorifexists").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """The markdown report, at most 2000 incidents, as one ordered text file."""
    ordered = lines.coalesce(1).sortWithinPartitions("section", "rank", "part").select("line")
    ordered.write.mode("errorifexists").text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    documents.select(F.col("document")).write.mode("errorifexists").text(path)
