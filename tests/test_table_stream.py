"""Tables are streamed whether they are one file or a folder of parts."""

import pytest
from pyspark.sql import functions as F

from quotelake.plans.record_queries import stream_latest_state, stream_quote_intake


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_folders_of_parts(spark, tmp_path, parts):
    d = str(tmp_path)
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 6).cast("string")).alias("text"))
    docs.repartition(parts).write.parquet(f"{d}/documents.parquet")
    spark.range(20).select(
        (F.col("id") % 4).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value")).repartition(parts).write.parquet(f"{d}/events.parquet")
    assert stream_quote_intake(spark, d).count() == 6
    assert sorted(r.id for r in stream_latest_state(spark, d).collect()) == [16, 17, 18, 19]
