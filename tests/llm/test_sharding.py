"""Shards against a plain bucket-splitting loop and against SQL."""

import hashlib

import duckdb
from pyspark.sql import types as T

from quotelake.llm.queries import op7_sql
from quotelake.llm.sharding import assign, write_shards

SF = "/root/testdata/sf0.001"
DOC = T.StructType([T.StructField(c, t) for c, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("h", T.StringType()), ("shard", T.StringType()))])


def plain(rows, limit):
    """Leaf prefix of each document of unique ids, by splitting one bucket after the other."""
    bits = {i: bin(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16))[2:].zfill(60) for i, _ in rows}
    sizes, todo, out = {i: len((t or "").encode()) for i, t in rows}, [("", [i for i, _ in rows])], {}
    while todo:
        prefix, ids = todo.pop()
        if sum(sizes[i] for i in ids) <= limit or len(ids) == 1:
            out.update((i, prefix) for i in ids)
        else:
            for b in "01":
                part = [i for i in ids if bits[i][len(prefix)] == b]
                if part:
                    todo.append((prefix + b, part))
    return out


def test_against_a_plain_directory(spark):
    rows = [(i, "é" * (i * 37 % 900)) for i in range(500)] + [(1000, "x" * 90_000), (1001, None), (1002, "")]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], DOC)
    for limit, bits in ((5_000, 12), (5_000, 3), (10**9, 12), (0, 12)):
        got = assign(df, limit, pass_bits=bits).collect()
        assert {r["id"]: r["shard_id"] for r in got} == plain(rows, limit)
        assert all(r["depth"] == len(r["shard_id"]) for r in got) and len(got) == len(rows)
        assert all(r["shard_bytes"] <= limit or (r["oversize"] and r["shard_docs"] == 1) or limit == 0 for r in got)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for limit in (20_000, 1 << 24):
        res = con.execute(op7_sql(limit))
        names = [c[0] for c in res.description]
        got = assign(docs, limit).withColumnRenamed("id", "doc_id").collect()
        assert sorted(tuple(r[c] for c in names) for r in got) == sorted(res.fetchall())


def test_repeated_and_null_ids_are_split_too(spark):
    rows = [(7, "same text", "a", "b")] * 60 + [(None, "x" * 50, "a", "b")] * 40 + [(8, "t", None, None)]
    got = assign(spark.createDataFrame(rows, DOC), 120).collect()
    assert len(got) == 101 and all(r["shard_bytes"] <= 120 for r in got)
    sums = {}
    for r in got:
        sums[r["shard_id"]] = sums.get(r["shard_id"], 0) + r["n_bytes"]
    assert all(sums[r["shard_id"]] == r["shard_bytes"] for r in got)


def test_written_shards_and_empty_table(spark, tmp_path):
    rows = [(i, "word " * (i % 50), "a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, DOC).drop("shard")
    write_shards(df, f"{tmp_path}/out", 2_000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["doc_id"], r["text"], r["h"]) for r in back.collect()) == sorted(r[:3] for r in rows)
    sizes = back.groupBy("shard").agg({"text": "count"}).count()
    assert sizes == len({p for p in plain([r[:2] for r in rows], 2_000).values()})
    assert assign(spark.createDataFrame([], DOC)).collect() == []


def test_documents_with_a_shard_column(spark, tmp_path):
    df = spark.createDataFrame([(i, "word " * (i % 50), "a", "b") for i in range(300)], DOC)
    assert "shard" in df.columns
    write_shards(df.withColumnRenamed(df.columns[2], "SHARD_"), f"{tmp_path}/out", 2_000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 300 and back.columns[-1] == "shard__" and back.select("shard").distinct().count() == 1
