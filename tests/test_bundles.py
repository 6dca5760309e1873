"""Many small files travel packed: few folder entries, the same quotes, one for each document."""

import os
import uuid

from pyspark.sql import functions as F

from quotelake.plans import intake_queries as q
from quotelake.sources.intake import FILE, read_bundles, stream_bundles, write_bundles
from quotelake.streaming import jobs

DATA = "/root/testdata/sf0.001"


def test_quote_files_need_no_entry_each(spark):
    folder = q.quote_files(spark, DATA)
    entries = sum(len(names) for _, _, names in os.walk(folder))
    packed = read_bundles(spark, folder)
    assert packed.count() == packed.select("path").distinct().count() > 4 * entries


def test_equal_offers_stay_two_files(spark, tmp_path):
    """Customers whose last orders state the same figures: keys 42 x 150,000 apart are rendered alike but for the number."""
    orders = spark.createDataFrame([(1, 7), (2, 7 + 42 * 150_000)], "o_custkey long, o_orderkey long").select(
        "o_orderkey", "o_custkey", F.lit("2024-01-05").cast("timestamp").alias("o_orderdate"), F.lit(1234.5).alias("o_totalprice"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([("Supplier#000000007",)], "s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    assert sorted(r["quote_no"] for r in q.intake_extract(spark, str(tmp_path)).collect()) == [7, 7 + 42 * 150_000]


def test_bundles_give_the_bytes_back(spark):
    folder = jobs.work_folder(spark, "bundles", uuid.uuid4().hex)
    files = [("a.txt", b"x\n\xff"), ("b/c.pdf", b""), ("d.png", None)]
    write_bundles(spark.createDataFrame(files, "path string, content binary"), folder)
    rows = {r["path"]: (r["length"], r["content"] and bytes(r["content"])) for r in read_bundles(spark, folder).collect()}
    assert rows == {"a.txt": (3, b"x\n\xff"), "b/c.pdf": (0, b""), "d.png": (None, None)}
    assert stream_bundles(spark, folder, 1).schema == spark.createDataFrame([], FILE).schema
