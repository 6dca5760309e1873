"""Hard negatives against a plain version that scores every pair, and against SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.llm import hard_negatives as m
from quotelake.llm.queries import OP12_SQL, QUERIES

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())), *(
        T.StructField(c, T.StringType()) for c in ("a", "id", "row", "chunk", "block", "class", "part", "score", "size"))])


def plain(rows, positives=5, negatives=5):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by the definition."""
    sound = [
        (i, y, [int(x) for x in v]) for i, y, v in rows
        if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    sound = sorted({(i, y, tuple(v)) for i, y, v in sound})
    out = []
    for i, y, v in sound:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in sound if j != i and len(w) == len(v)]
        near = sorted((s, j) for s, j, z in scored if z == y)[:positives]
        for ps, p in near:
            fits = sorted((s, j) for s, j, z in scored if z != y and 80 * -ps <= 100 * -s <= 100 * -ps)[:negatives]
            out += [(i, p, k + 1, j, -ps, -s) for k, (s, j) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, **options):
    typed = [(i, y, None if v is None else [None if x is None else float(x) for x in v], *("clash",) * 9) for i, y, v in rows]
    df = spark.createDataFrame(typed, SCHEMA).repartition(4)
    return sorted(tuple(r[c] for c in COLUMNS) for r in m.hard_negatives(df, F.col("vec_id") % 100 == 0, **options).collect())


def clustered(n, dim, labels, seed, lengths=(20.0, 400.0)):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    v = centres[rng.integers(0, 12, n)] + 0.2 * rng.standard_normal((n, dim))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * rng.uniform(*lengths, n)[:, None]
    return [(i, int(y), [float(x) for x in np.floor(w)]) for i, (y, w) in enumerate(zip(rng.integers(0, labels, n), v))]


@pytest.mark.parametrize("options", [{}, {"chunk": 40, "block": 2}])
def test_every_pair(spark, monkeypatch, options):
    monkeypatch.setattr(m, "BUCKET", 16)
    rows = clustered(900, 16, 4, 1)
    want = plain(rows)
    assert len(want) > 100 and run(spark, rows, **options) == want


def test_hot_label_and_ties(spark):
    rows = clustered(300, 8, 3, 2)
    rows += [(1000 + i, 1, [30.0, 5.0, 0, 0, 0, 0, 0, 1.0]) for i in range(800)]  # one vector, one label
    rows += [(3000 + i, i % 3, [30.0, 5.0, 0, 0, 0, 0, 0, 1.0]) for i in range(300)]
    assert run(spark, rows, chunk=100, block=4) == plain(rows)


def test_odd_rows(spark):
    rows = clustered(200, 4, 2, 3)
    rows += [(None, 1, [1.0, 2, 3, 4]), (400, None, [1.0, 2, 3, 4]), (500, 1, None), (600, 1, []), (700, 1, [1.0, None, 2, 3]),
             (800, 1, [float("nan"), 1, 1, 1]), (900, 1, [float("inf"), 1, 1, 1]), (1000, 1, [0.0, 0, 0, 0]),
             (1100, 0, [3.0, 4.0]), (1101, 0, [3.0, 4.0]), (1102, 1, [3.0, 3.0]), (1103, 1, [3.0, 4.0]),
             (1200, 1, [-9.0, 9, -9, 9]), (1200, 1, [-9.0, 9, -9, 9]), (1200, 0, [9.0, 9, -9, 9]), (1300, 7, [1.0, 1, 1, 1])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_large_numbers(spark):
    rows = [(0, 1, [2.0**28, 1.0]), (1, 1, [2.0**28, 3.0]), (2, 2, [2.0**28 - 1, 5.0]), (3, 2, [2.0**27, 1.0]), (4, 2, [-(2.0**28), 1.0])]
    assert run(spark, rows) == plain(rows) != []
    huge = [(0, 1, [1e300, 1.0]), (1, 1, [1e300, 3.0]), (2, 2, [1e300, 5.0])]
    top = 2**63 - 1
    assert run(spark, huge) == [(0, 1, 1, 2, top, top)]


def test_pruning_loses_nothing_and_prunes():
    rng = np.random.default_rng(5)
    rows = np.floor(rng.standard_normal((500, 6)) * 100).astype(np.int64)
    lengths = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
    bucket, pruned = m.Bucket(rows, lengths, np.arange(500)), 0
    for anchor in rows[:60]:
        scores, length = rows @ anchor, float(np.linalg.norm(anchor))
        for least in (*np.quantile(scores, [0.2, 0.5, 0.9, 0.99]), scores.max(), 0, -1):
            found = bucket.candidates(anchor, length, least)
            found = np.arange(500) if found is None else found
            assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())
            pruned += 500 - len(found)
    assert pruned > 30_000


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({OP12_SQL})").fetchall())
    assert sorted(tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_hard_negatives"](spark, sf).collect()) == want != []
