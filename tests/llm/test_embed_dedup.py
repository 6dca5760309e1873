"""Links and components against brute force: nothing false, recall as planned."""

import math

import numpy as np
from pyspark.sql import types as T

from quotelake.llm.embed_dedup import bucket_keys, meeting, near_vectors, plan
from quotelake.llm.queries import QUERIES

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (
    ("vec_id", T.LongType()), ("embedding", T.ArrayType(T.FloatType())), ("label", T.IntegerType()),
    ("n", T.StringType()), ("node", T.StringType()))])


def brute(rows):
    """(id, links, component) by every pair."""
    def ok(r):
        return r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    n, label = [0] * len(rows), list(range(len(rows)))
    pairs = []
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], dtype=np.float32).astype(float), np.array(b[1], dtype=np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98 or a[1] == b[1]:
                    pairs.append((i, j))
                    n[i] += 1
                    n[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    least = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in label}
    return [(r[0], n[i], least[label[i]]) for i, r in enumerate(rows)], len(pairs)


def close(base, cosine, rng):
    other = rng.standard_normal(len(base))
    other -= other @ base / (base @ base) * base
    side = other / np.linalg.norm(other) * np.linalg.norm(base)
    return cosine * base + math.sqrt(1 - cosine**2) * side


def test_groups_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 24))
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(base)]
    for k in range(60):  # chains and a large group
        rows.append((100 + k, [float(x) for x in close(base[k % 3], 0.9995, rng)], (k % 3) % 2))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], 1), (203, rows[0][1], None), (None, rows[0][1], 0)]
    rows += [(204, None, 0), (205, [0.0] * 24, 0), (206, [0.0] * 24, 0), (207, [None] * 24, 0), (208, [float("nan")] * 24, 0),
             (209, [float("inf")] + [0.0] * 23, 0), (210, [], 0), (211, rows[0][1][:5], 0), (212, rows[0][1][:5], 0), rows[1], rows[1]]
    rows.append((213, [x * 3e37 / max(map(abs, rows[4][1])) for x in rows[4][1]], 0))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    want, _ = brute(rows)
    for chunk in (2048, 7):  # one unit a bucket, then many
        got = near_vectors(df, recall=0.999999, chunk=chunk).collect()
        assert sorted(((r["id"], r["n_links"], r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
        assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        v = rng.standard_normal(64)
        rows += [(2 * i, v.tolist(), 1), (2 * i + 1, close(v, 0.9801, rng).tolist(), 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sum(r["n_links"] for r in near_vectors(df).collect()) // 2
    want = brute(rows)[1]
    assert got <= want and got >= 0.95 * want


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in QUERIES["op3_embed_dedup"](spark, sf).collect())
    assert got == sorted(brute(rows)[0])


def test_empty_and_plan(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    k, tables = plan(10**9)
    assert k > plan(100)[0] and tables < 100
    rng = np.random.default_rng(0)
    a = rng.standard_normal((4000, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.array([close(x, 0.98, rng) for x in a])
    same = (bucket_keys(a, 1, 40) == bucket_keys(b, 1, 40)).mean()
    assert abs(same - meeting(0.2)) < 0.02
