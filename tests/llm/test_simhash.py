"""SimHash against a plain version: per-bit counts and every pair compared."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from quotelake.llm.simhash import (
    compare, compare_wide, fingerprint, keep_one, radius_of, similar_components, simhash_components, wide_print,
)

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("fp", T.StringType()), T.StructField("id", T.StringType()),
])


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((rows[i][0], prints[i], min(ids, default=None)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "a b c", "A b  C\x0bd e É", "x y " * 70000])
def test_fingerprint(text):
    assert fingerprint(text) == plain_print(text)


def test_documents_against_every_pair(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    words = rows[0][1].split()
    near = [(10_000 + i, " ".join([*words[:i * 7], "changed", *words[i * 7 + 1:]])) for i in range(30)]
    rows += near + [(20_000, None), (20_001, ""), (None, rows[3][1]), (None, "only here, with no id at all"), rows[5], rows[5]]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOC)
    want = plain_components(rows)
    assert rows_of(simhash_components(df)) == want
    assert rows_of(simhash_components(df, tile=2)) == want  # many tiles give the same components


def test_keep_one_leaves_one_of_each_group(spark):
    long = "word%d here " * 400 % tuple(range(400))
    rows = [
        (3, long, "a", "b"), (1, long, "a", "b"), (1, long, "a", "b"), (None, long, "a", "b"),
        (None, "nobody knows me", "a", "b"), (None, "nobody knows me", "c", "b"), (7, None, "a", "b"), (8, "", "a", "b"),
        (9, "first text of nine", None, None), (9, "quite another text under the same id", None, None),
    ]
    kept = keep_one(spark.createDataFrame(rows, DOC))
    assert kept.columns == ["doc_id", "text", "fp", "id"]
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    want = [(1, long), (None, "nobody knows me"), (7, None), (9, "first text of nine"), (9, rows[-1][1])]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOC)
    assert simhash_components(df).collect() == [] and keep_one(df).collect() == []


def test_compare_reduces_a_clique_to_a_forest():
    a = np.arange(8, dtype=np.uint64)
    u, v = compare(a, a, 3)
    assert len(u) <= 2 * len(a) and set(u) | set(v) == set(range(8))


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def edited(words, edits, rng):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"edit{rng.random()}"
    return " ".join(words)


def test_similar_copies_are_caught_and_others_left(spark):
    rng = random.Random(8)
    rows, copies = [], 0
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400, 3000]))]
        rows.append((10 * k, " ".join(words)))
        for j in range(1, 5):
            text = edited(words, max(1, len(words) * j // 200), rng)
            a, b = shingles(text), shingles(rows[-j][1])
            copies += len(a & b) / len(a | b) >= 0.8
            rows.append((10 * k + j, text))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOC)
    for tile in (4096, 16):
        found = similar_components(df, tile=tile).collect()
        assert all(r["component_id"] // 10 == r["id"] // 10 for r in found)  # unrelated texts never link
        caught = sum(r["component_id"] != r["id"] for r in found)
        assert copies > 100 and caught >= 0.98 * copies
    assert {r["doc_id"] for r in keep_one(df).collect()} >= set(range(0, 600, 10))


def test_wide_links_are_those_of_every_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    a[100:200] = a[:100]
    for i in range(100, 200):  # up to 60 bits changed
        for bit in rng.choice(256, rng.integers(0, 60), replace=False):
            a[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    radius = radius_of(0.8)
    child, root = compare_wide(a, a, radius)
    label = list(range(600))
    for u, v in zip(child.tolist(), root.tolist(), strict=True):
        label[u] = v
    for i in range(300):
        for j in range(300):
            if np.bitwise_count(a[i] ^ a[j]).sum() <= radius:
                assert label[i] == label[300 + j]
    assert len(set(label)) >= 200


@pytest.mark.parametrize("text", [None, "", "a", "a b c d e f g", "x y " * 70000])
def test_wide_print(text):
    fp, size = wide_print(text)
    assert len(fp) == 32 and size == (len(shingles(text)) if text else 0)
    assert wide_print((text or "").upper()) == (fp, size)


def exact_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {rows[i][0]: rows[label[i]][0] for i in range(len(rows))}


def test_links_need_the_whole_sets(spark):
    rng = random.Random(3)
    rows = []

    def add(*texts):
        rows.extend((100 * len(rows) + k, t) for k, t in enumerate(texts))

    for k in range(40):
        words = [f"v{rng.randrange(10**6)}" for _ in range(304)]
        for share in (0.6, 0.67, 0.7, 0.73, 0.76, 0.79, 0.82):
            base = [f"{w}s{share}" for w in words]
            same = round(304 * 2 * share / (1 + share))
            add(" ".join(base), " ".join([*base[:same], *(f"{w}o" for w in words[same:])]))
        add(" ".join(words[:210]), " ".join([*words[:210], *(f"{w}c" for w in words[210:300])]))  # contained, 1.43 times as long
        short = [f"{w}t" for w in words[:9]]
        add(" ".join(short), " ".join(short[:8]))  # 5 shingles against 4
        add(" ".join(short[:7]) + f" x{k}", " ".join(short[:6]) + f" x{k}")
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOC)
    want = exact_components(rows)
    assert 60 < sum(a != b for a, b in want.items()) < 200
    for tile, set_tile in ((4096, 1024), (16, 1)):
        found = similar_components(df, tile=tile, set_tile=set_tile).collect()
        assert {r["id"]: r["component_id"] for r in found} == want
