"""Structured Streaming jobs that re-use the batch expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.operators.ingest import EXTRACTED, decoded_files, extract_files
from quotelake.session import checkpoint_dir
from quotelake.sources.intake import dedupe_files, split_good_bad, with_file_hash
from quotelake.sources.lifecycle import latest_state
from quotelake.streaming.manifest import noted, whole_batches, write_once

STATE_ORDER = ["created_at", "id"]


def work_folder(spark: SparkSession, name: str, run: str | None = None) -> str:
    """Folder below the shared checkpoint directory: the one of a named run, which a restart resumes, or a fresh one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{run or uuid.uuid4().hex}"


def stream_latest_state(events: DataFrame, folder: str, key: str = "project_id", order: list[str] = STATE_ORDER) -> DataFrame:
    """Keep the latest record per key up to date from a stream of change events.

    The newest record of a key is a keyed maximum in Spark's state store: a batch touches the keys it names and no
    others, and late events lose against what is stored. Only changed keys are written, one folder a batch; as a
    record is only ever replaced by a newer one, the latest state is the newest written record of each key. Events
    with equal times are told apart by the rest of ``order``; null times come first. A restart resumes from the
    checkpoint of ``folder``, with or without new input; without any input the state is empty.
    """
    spark, values = events.sparkSession, [c for c in events.columns if c not in (key, *order)]
    newest = events.groupBy(key).agg(F.max(F.struct(*order, *values)).alias("r"))
    changed = newest.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in events.columns])
    query = (
        changed.writeStream.outputMode("update")
        .foreachBatch(lambda batch, number: write_once(batch, number, folder, "changes"))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return latest_written(spark, folder, events.schema, key, order)


def latest_written(spark: SparkSession, folder: str, schema: T.StructType, key: str, order: list[str]) -> DataFrame:
    """Latest state as written so far: the compacted one and the changes since."""
    compacted = noted(spark, folder, "compacted")
    rows = whole_batches(spark, folder, "changes", schema)
    if compacted:
        last = compacted[-1]
        since = [n for n in noted(spark, folder, "changes") if n > last]
        rows = spark.read.schema(schema).parquet(
            f"{folder}/compacted/batch={last}", *(f"{folder}/changes/batch={n}" for n in since))
    values = [c for c in schema.names if c not in (key, *order)]
    return latest_state(rows, [key], order, values).select(*schema.names)


def compact_state(spark: SparkSession, folder: str, schema: T.StructType, key: str = "project_id", order: list[str] = STATE_ORDER) -> None:
    """Fold all written changes into one table of one row a key; readers start from it. Run it between two starts."""
    done = noted(spark, folder, "changes")
    if done:
        write_once(latest_written(spark, folder, schema, key, order), done[-1], folder, "compacted")


def screen_document(docs: DataFrame) -> DataFrame:
    """Reject what holds no text; every text of any length goes on."""
    return docs.withColumn("reject_reason", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty_text"))


def stream_intake(docs: DataFrame, folder: str, time: str = "ts", window: str = "3650 days") -> tuple[DataFrame, DataFrame]:
    """Continuous intake: hash, drop re-uploads seen within ``window``, screen, write good and dead-letter tables."""
    spark = docs.sparkSession
    fresh = with_file_hash(docs, "text").withWatermark(time, window).dropDuplicatesWithinWatermark(["file_hash"])
    screened = screen_document(fresh)

    query = (
        screened.writeStream.foreachBatch(lambda batch, number: write_once(batch, number, folder, "docs"))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    stored = whole_batches(spark, folder, "docs", screened.schema)
    return stored.where("reject_reason IS NULL"), stored.where("reject_reason IS NOT NULL")


def stream_quotes(files: DataFrame, partners: DataFrame, folder: str, window: str = "3650 days") -> tuple[DataFrame, DataFrame]:
    """Continuous intake of files (binary file source) to extracted quotes and dead letters.

    Re-uploads of a content within ``window`` are dropped by its hash in the state store; every micro-batch then runs
    the batch job ``extract_files`` and is written once. Returns the tables of quotes and of dead letters so far.
    """
    spark = files.sparkSession
    fresh = decoded_files(files).withWatermark("modificationTime", window).dropDuplicatesWithinWatermark(["file_hash"])

    def write(batch: DataFrame, number: int) -> None:
        write_once(batch, number, folder, "decoded")
        texts = spark.read.schema(fresh.schema).parquet(f"{folder}/decoded/batch={number}")
        write_once(texts, number, folder, "quotes", lambda t: extract_files(t, partners))

    query = fresh.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return quote_tables(spark, folder)


def intake_quotes(files: DataFrame, partners: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The same for a fixed set of files; of equal contents the first path is read."""
    spark = files.sparkSession
    texts = decoded_files(files)
    write_once(texts, 0, folder, "decoded")
    texts = spark.read.schema(texts.schema).parquet(f"{folder}/decoded/batch=0")
    first = dedupe_files(texts, "path").select("path")
    write_once(texts.join(first, "path", "left_semi"), 0, folder, "quotes", lambda t: extract_files(t, partners))
    return quote_tables(spark, folder)


def quote_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return split_good_bad(whole_batches(spark, folder, "quotes", EXTRACTED), "failure_reason")
