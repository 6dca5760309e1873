"""Rendered documents and requests use every core, however the rows lie in their files."""

import pytest
from pyspark.sql import functions as F

from quotelake.sources import documents as doc


@pytest.mark.parametrize("source", ["orders", "customer"])
def test_one_row_group_is_dealt_out(spark, tmp_path, source):
    d = str(tmp_path)
    rows = spark.range(4000).coalesce(1)
    if source == "orders":
        rows = rows.select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), F.lit("2024-01-02").cast("timestamp").alias("o_orderdate"),
                           F.lit(12345.6).alias("o_totalprice"))
    else:
        rows = rows.select(F.col("id").alias("c_custkey"), F.lit("고객").alias("c_name"), F.lit(1).alias("c_nationkey"))
    rows.write.parquet(f"{d}/{source}.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1024")
        made = [doc.base(spark, d)] if source == "orders" else [doc.request_texts(spark, d), doc.request_forms(spark, d)]
        for df in made:
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert sum(sizes) == 4000 and len(sizes) >= 8 and max(sizes) <= 1000
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
