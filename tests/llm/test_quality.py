"""Held-out accuracy, the vote against a plain one, and the fold rule."""

import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from quotelake.llm.quality import NEIGHBOURS, POWER, PRIOR, counts, fit, keep_good, quality_scores, scored, voting_texts
from quotelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DOC = T.StructType([T.StructField(c, t) for c, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("score", T.StringType()), ("t", T.StringType()))])
LABEL = T.StructType([T.StructField(c, t) for c, t in (
    ("doc_id", T.LongType()), ("quality", T.IntegerType()), ("text", T.StringType()))])


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    got = {r["doc_id"]: r for r in QUERIES["op2_quality"](spark, SF).collect()}
    assert len(got) == tables[0].count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    test = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in tables[1].collect() if got[r["doc_id"]]["held_out"]]
    assert len(test) > 50 and np.mean([a == b for a, b in test]) >= 0.97
    for label in (0, 1):
        assert np.mean([a == b for a, b in test if b == label]) >= 0.9


def test_vote_is_the_plain_one(tables):
    voters = fit(*tables)
    texts = [r["text"] for r in tables[0].limit(40).collect()]
    want = []
    for x in voters.latent(texts):
        near = sorted(((float(x @ v), y) for v, y in zip(voters.vectors, voters.labels, strict=True)), reverse=True)[:NEIGHBOURS]
        votes = [max(0.0, c) ** POWER for c, _ in near]
        mean = voters.labels.mean()
        want.append((sum(w * y for w, (_, y) in zip(votes, near, strict=True)) + PRIOR * mean) / (sum(votes) + PRIOR))
    assert np.allclose(voters.score(texts), want, atol=1e-3)


def test_held_out_labels_change_nothing(spark, tables):
    docs, labels = tables
    flipped = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = fit(docs, labels), fit(docs, flipped)
    assert np.array_equal(a.labels, b.labels) and np.array_equal(a.vectors, b.vectors)


def test_odd_rows(spark):
    docs = [(i, f"good words number {i} follow here, as they should", "x", "y") for i in range(40)]
    docs += [(i, f"BAD!! WORDS!! {i}!! SHOUT!! LOUD!!", "x", "y") for i in range(40, 80)]
    docs += [(100, None, None, None), (101, "", "x", "y"), (None, "good words follow here, as they should", "x", "y"),
             (102, "word " * 50_000, "x", "y"), docs[0], docs[0]]
    labels = [(i, int(i < 40), "z") for i in range(80)] + [(None, 1, "z"), (3, None, "z"), (999, 0, "z"), (5, 1, "z")]
    d, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)
    got = quality_scores(d, lab).collect()
    assert len(got) == len(docs) and all(r["score"] is not None for r in got)
    by = {r["id"]: r["score"] for r in got}
    assert all(by[i] > 0.5 for i in range(40)) and all(by[i] < 0.5 for i in range(40, 80)) and by[None] > 0.5
    assert by[100] == by[101]
    assert [r["held_out"] for r in got if r["id"] is None] == [False]
    kept = keep_good(d, lab)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and r["doc_id"] < 80) == [0, 0, *range(40)]
    assert set(scored(d, fit(d, lab)).columns) == {"row", "score"}


def test_no_labels_and_empty_tables(spark, tables):
    d, lab = spark.createDataFrame([(1, "a b", "x", "y"), (2, None, "x", "y")], DOC), spark.createDataFrame([], LABEL)
    assert [r["score"] for r in quality_scores(d, lab).collect()] == [0.5, 0.5]
    assert quality_scores(spark.createDataFrame([], DOC), lab).collect() == []
    assert counts(None)[0].tolist() == [] == counts("")[0].tolist()


def test_one_text_reaches_the_driver_for_each_id(spark):
    docs = spark.range(20_000).selectExpr("id % 3 AS doc_id", "concat('text ', id % 7) AS text").unionByName(
        spark.createDataFrame([(1, None), (5, "alone"), (9, "not picked")], "doc_id long, text string"))
    picked = spark.createDataFrame([(0, 1), (1, 0), (5, 1), (6, 0)], "id long, y int")
    rows = voting_texts(docs, picked, "doc_id", "text").collect()
    assert sorted((r["id"], r["y"]) for r in rows) == [(0, 1), (1, 0), (5, 1)]
    again = voting_texts(docs.repartition(7), picked, "doc_id", "text").collect()
    assert {(r["id"], r["t"]) for r in rows} == {(r["id"], r["t"]) for r in again}
