"""Which numbered batches of a streaming sink are whole.

A sink writes the rows of batch n to its own folder and then notes n here. A batch that is noted is never written
again, one that broke off before is overwritten, and readers see noted batches only; so every batch counts once,
however often it is replayed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table of a folder; no rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def noted(spark: SparkSession, folder: str, sink: str) -> list[int]:
    """Numbers of the whole batches of a sink."""
    rows = read_or_empty(spark, f"{folder}/manifest/{sink}", T.StructType([T.StructField("number", T.LongType())]))
    return sorted({r["number"] for r in rows.collect()})  # one number for each batch


def write_once(batch: DataFrame, number: int, folder: str, sink: str, build: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Write the batch (or what ``build`` makes of it) under its number, unless it is noted already."""
    spark = batch.sparkSession
    if number in noted(spark, folder, sink):
        return False
    (build(batch) if build else batch).write.mode("overwrite").parquet(f"{folder}/{sink}/batch={number}")
    spark.range(number, number + 1).toDF("number").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/{sink}/of={number}")
    return True


def whole_batches(spark: SparkSession, folder: str, sink: str, schema: T.StructType) -> DataFrame:
    """Rows of all noted batches."""
    numbers = noted(spark, folder, sink)
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{folder}/{sink}/batch={n}" for n in numbers))
