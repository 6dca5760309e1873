"""Exact groups against a plain version and against SQL."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import types as T

from quotelake.llm.exact_dedup import exact_groups, shared_heads, _rows
from quotelake.llm.queries import OP13_SQL, QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(
        T.StructField(c, T.StringType()) for c in ("id", "size", "sha", "row", "kept", "keep_id", "open", "piece", "n"))])


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def plain(rows):
    """(doc_id, keep_id, group_size, sha) in the order of ids, and the number of rows that stay."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(bare(text), []).append((-len(text or ""), doc is None, doc or 0))
    out = []
    for doc, text in rows:
        group = groups[bare(text)]
        _, none, keep = min(group)
        out.append((doc, None if none else keep, len(group), hashlib.sha256(bare(text).encode()).hexdigest()))
    return out, len(groups)


def key(row):
    return tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in row)


def cases():
    long = "Lange Rede " * 20_000
    rows = [(1, "a b c"), (2, "abc"), (3, "ab\tc\n "), (4, "a  b c"), (5, "abd"), (6, "abcd"), (7, None), (8, ""), (9, " \n\t"),
            (10, long), (11, long + " "), (12, long[:-3] + "x  "), (13, " abc"), (14, "\x0b\x0cabc\r"), (15, "abc\x1c"),
            (None, "null id"), (None, "nullid"), (16, "null id"), (17, "null  id"), (18, "twice"), (18, "twice"), (18, "tw ice"),
            (18, "other"), (19, "ж" * 300 + "1"), (20, "ж" * 300 + "2"), (21, "ж" * 300 + "1 "), (22, "ж" * 256), (-5, "abc")]
    return rows + [(1000 + i, "hot copy" + " " * (i % 7)) for i in range(3000)] + [(9000 + i, f"own text {i}") for i in range(500)]


@pytest.mark.parametrize("options", [{}, {"prefix": 2}, {"bits": 32768, "heavy": 1}, {"bits": 65536, "prefix": 10_000, "heavy": 3}])
def test_every_case(spark, options):
    rows = cases()
    docs = spark.createDataFrame([(*r, *("clash",) * 9) for r in rows], SCHEMA).repartition(5)
    got = exact_groups(docs, digest_all=True, **options).collect()
    want, groups = plain(rows)
    assert sorted((key((r["id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got)) == sorted(map(key, want))
    stays = [r for r in got if r["kept"]]
    assert len(stays) == groups == len({r["text_sha256"] for r in stays})
    assert all(r["id"] == r["keep_id"] for r in stays)


def test_unique_rows_are_not_hashed(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "three"), (3, "alike"), (4, "ali ke"), (5, "1234567")], "doc_id long, text string")
    got = {r["id"]: r["text_sha256"] for r in exact_groups(docs).collect()}
    assert {i for i, sha in got.items() if sha} == {3, 4}  # 2 has their length, but another prefix
    shared = shared_heads(_rows(docs, "doc_id", "text", 256)).collect()
    assert [(r["size"], r["n"]) for r in shared] == [(5, 2)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(none).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", SF])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({OP13_SQL})").fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in QUERIES["op13_exact_dedup"](spark, sf).collect()) == want


def test_only_spark_functions():
    text = open(exact_groups.__code__.co_filename).read()
    assert not re.search(r"udf|pandas|pyarrow|mapIn|applyIn|\.rdd|collect\(", text)
