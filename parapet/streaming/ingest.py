"""Continuous ingest: stream files in, audit, append; reject bad rows to quarantine."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parapet.functions.scoring import Scorer, no_score
from parapet.lexicon import TOXICITY_THRESHOLD
from parapet.operators.audit import audit
from parapet.operators.normalize import dense_numbers, to_conversations, with_reject_reason
from parapet.schemas import AUDIT_SCHEMA, RAW_CONVERSATION_SCHEMA
from parapet.session import cut_lineage
from parapet.sources.readers import read_audit_table
from parapet.sources.writers import write_day_batches

# Room for the rows of one micro-batch in an id.
_ID_BITS = 40


def read_json_stream(
    spark: SparkSession, folder: str, max_files: int = 1000, glob: str | None = None,
    quarantine: bool = False,
) -> DataFrame:
    """New JSON-lines files of a folder.

    A malformed line stops the query. With ``quarantine`` it arrives as ``_corrupt_record``
    instead, for ``ingest``, which sets such lines aside.
    """
    fields = RAW_CONVERSATION_SCHEMA.fields
    fields = [*fields, T.StructField("_corrupt_record", T.StringType())] if quarantine else fields
    reader = spark.readStream.schema(T.StructType(fields)).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.option("mode", "PERMISSIVE" if quarantine else "FAILFAST").json(folder)


def read_parquet_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, max_bytes: int = 1 << 30
) -> DataFrame:
    """New Parquet files of a table, be it a folder or a single file, as a stream.

    ``max_bytes`` bounds a micro-batch, though it always takes at least one file. The
    default of a gigabyte suits state keyed by a possibly hot client; stateless work on a
    large cluster may take more at a time.
    """
    # only a glob may name a single file, so the last letter becomes one
    glob = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(glob)


def stream_time() -> Column:
    """The time of the micro-batch, as timestamp text."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def by_day(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deal raw rows out by the day of their timestamp and a salt, ahead of costly work.

    Each task then holds few days, so few files are written, and all cores have work
    although a source file may be one split. Bad timestamps are a day of their own.
    """
    tasks = tasks or rows.sparkSession.sparkContext.defaultParallelism
    day = F.to_date(F.try_to_timestamp("timestamp"))
    # as many salts as put a task's worth of rows of one busy day into each task
    return rows.repartition(tasks, day, F.pmod(F.xxhash64("output_text"), F.lit(4)))


def append_stream(
    audited: DataFrame, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Append audited rows with the exactly-once file sink.

    The sink takes what it gets; ``ingest`` is for streams with rows to be set aside.
    """
    writer = (
        audited.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("audit_date")
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest(
    stream: DataFrame,
    table: str,
    quarantine: str,
    checkpoint: str,
    toxicity: Scorer = no_score,
    sentiment: Scorer = no_score,
    threshold: float = TOXICITY_THRESHOLD,
    redact_pii: bool = True,
    once: bool = True,
    jobs: str | None = None,
    commits: str | None = None,
) -> StreamingQuery:
    """Audit valid rows into ``table`` and append rejected ones, with reason, to ``quarantine``.

    Each micro-batch is read and shaped once, into a work folder; both sinks read that. It owns
    one ``batch_id`` level in all places and overwrites it, so a batch that is repeated after a
    failure leaves no duplicates. Rows without an ``id`` get one from the batch number and
    their place. With ``jobs``, each row leaves job updates there: ``processing``, then
    ``completed`` with the audit id, or ``failed`` with the reason; the job is the request id,
    or else the row's id.

    With ``commits``, a folder, the three places are one commit: a batch counts once its number stands there, which
    is written last. Readers that are given the folder see all of a batch or nothing of it, whatever was
    written before a crash; a batch that was committed is not written again.
    """

    def run(batch: DataFrame, number: int) -> None:
        if commits and number <= last_commit(batch.sparkSession, commits):
            return  # Spark repeats a batch whose end it had not noted
        shaped = to_conversations(batch).withColumn("_row", F.monotonically_increasing_id())
        # shaped rows are stored once: ids and both sinks must see the same ones
        stored = cut_lineage(with_reject_reason(by_day(shaped)), "ingest")
        if "id" not in stored.columns:
            stored = dense_numbers(stored, "_row", "id", number << _ID_BITS)
        stored = stored.drop("_row")
        accepted = F.col("reject_reason").isNull()
        valid = stored.filter(accepted).drop("reject_reason", "_corrupt_record")
        rows = audit(valid, toxicity, sentiment, threshold, redact_pii, batch_time=stream_time())
        write_day_batches(rows, table, number)
        folder = f"batch_id={number}"
        rejected = stored.filter(~accepted)
        rejected.write.mode("overwrite").json(os.path.join(quarantine, folder))
        if jobs:
            job_updates(stored, number).write.mode("overwrite").parquet(os.path.join(jobs, folder))
        if commits:
            commit(batch.sparkSession, commits, number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


JOB_SCHEMA = (
    "job_id string, status string, ts timestamp, seq bigint, result string, error string"
)


def job_updates(rows: DataFrame, batch: int) -> DataFrame:
    """Two updates per row of a batch: taken up, and how it ended."""
    accepted = F.col("reject_reason").isNull()
    none = F.lit(None).cast("string")
    taken = F.struct(F.lit("processing").alias("status"), none.alias("result"), none.alias("error"))
    ended = F.struct(
        F.when(accepted, "completed").otherwise("failed").alias("status"),
        F.when(accepted, F.col("id").cast("string")).alias("result"),
        F.col("reject_reason").alias("error"),
    )
    job = F.coalesce(F.nullif("request_id", F.lit("")), F.col("id").cast("string"))
    updates = rows.select(job.alias("job_id"), F.posexplode(F.array(taken, ended)).alias("n", "u"))
    return updates.select(
        "job_id", "u.status", F.current_timestamp().alias("ts"),
        (F.lit(2 * batch) + F.col("n")).cast("bigint").alias("seq"), "u.result", "u.error",
    )


_COMMIT = "batch_id bigint"


def commit(spark: SparkSession, commits: str, number: int) -> None:
    """Note that a batch is complete; a folder of its own, so that a repeat leaves one note."""
    one = spark.range(1).select(F.lit(number).cast("bigint").alias("batch"))
    one.write.mode("overwrite").parquet(os.path.join(commits, f"batch_id={number}"))


def last_commit(spark: SparkSession, commits: str) -> int:
    """The number of the last complete batch, -1 for none. Batches are taken in turn: all up to it are complete."""
    try:
        found = spark.read.schema(f"batch bigint, {_COMMIT}").parquet(commits)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return -1
        raise
    last = found.agg(F.max("batch")).first()[0]
    return -1 if last is None else last


def _complete(rows: DataFrame, commits: str | None) -> DataFrame:
    """Rows of complete batches; the others' folders are not read."""
    return rows.filter(F.col("batch_id") <= last_commit(rows.sparkSession, commits)) if commits else rows


def read_ingested(spark: SparkSession, table: str, commits: str | None = None) -> DataFrame:
    """The table that ``ingest`` wrote; with ``commits``, its complete batches."""
    if commits is None:
        return read_audit_table(spark, table)
    rows = spark.read.schema(T.StructType([*AUDIT_SCHEMA.fields, T.StructField("batch_id", T.LongType())])).parquet(table)
    return _complete(rows, commits).drop("batch_id")


def read_jobs(spark: SparkSession, jobs: str, commits: str | None = None) -> DataFrame:
    """The job updates that ``ingest`` wrote."""
    if commits is None:
        return spark.read.schema(JOB_SCHEMA).parquet(jobs)
    return _complete(spark.read.schema(f"{JOB_SCHEMA}, {_COMMIT}").parquet(jobs), commits).drop("batch_id")


def read_rejected(spark: SparkSession, quarantine: str, commits: str | None = None) -> DataFrame:
    """The rows that ``ingest`` set aside, with ``reject_reason``."""
    fields = [*RAW_CONVERSATION_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())]
    schema = T.StructType([*fields, T.StructField("reject_reason", T.StringType()), T.StructField("batch_id", T.LongType())])
    return _complete(spark.read.schema(schema).json(quarantine), commits).drop("batch_id")
