"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised; cosine c is then the distance sqrt(2 - 2c). Each of L tables hashes K projections on normal
random directions, shifted and quantised in steps of `WIDTH`; vectors of one label that share all K numbers of a table
meet in a bucket. K follows the number of distinct vectors, so that buckets of unrelated vectors stay small, and L
follows K, so that a pair exactly at the threshold meets somewhere with probability `RECALL` (nearer pairs with more).

Exact copies are one node with a weight. Bucket keys travel alone first, and only members of buckets with company
fetch their vectors. A bucket above `CHUNK` members is cut into chunks whose pairs are separate units of work, so any
group of copies is bounded in memory and spread. A pair that met in an earlier table is skipped, so each link counts
once; links leave a task as one sum per vector and a spanning forest.

Defined cases: null vectors, vectors that are empty, zero or hold null or non-finite components, and rows with a null
label link with nothing, not even with their copies; vectors of different length never link; rows with a null id take
part and get the smallest non-null id reachable; repeated rows are copies; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import Forest, components, cut

THRESHOLD = 0.98
RECALL = 0.98
WIDTH = 1.0
LEAST_K = 8
#: Bucket members in a unit of work; it sets memory and copies shuffled, never the result.
CHUNK = 2048
BLOCK = 1 << 20


def meeting(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors at this distance fall into one step of a projection."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """K and L for n distinct vectors."""
    far, near = meeting(math.sqrt(2), width), meeting(math.sqrt(2 - 2 * threshold), width)
    k = max(LEAST_K, math.ceil(math.log(max(2, n)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log1p(-(near**k)))


def bucket_keys(unit: np.ndarray, k: int, tables: int, width: float = WIDTH, seed: int = 5) -> np.ndarray:
    """One 64-bit key per vector and table."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    lines = rng.standard_normal((unit.shape[1], tables * k))
    shift = rng.uniform(0, width, tables * k)
    mix = rng.integers(1, 1 << 62, (tables, k), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    steps = np.floor((unit @ lines + shift) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, k)
    return (steps * mix).sum(axis=2, dtype=np.uint64).view(np.int64)


def _hash(k: int, tables: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v.as_py(), dtype=np.float64) for v in batch.column(1)]
            for size in sorted({len(v) for v in vectors}):
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                rows = np.stack([vectors[i] for i in at])
                rows /= np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the norm
                unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
                keys = bucket_keys(unit, k, tables, width)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)), pa.array([u.tobytes() for u in unit], pa.binary()),
                    pa.array(keys.tolist(), pa.list_(pa.int64())),
                ], names=["node", "unit", "keys"])
    return run


def unit_links(
    a: np.ndarray, b: np.ndarray, keys_a: np.ndarray, keys_b: np.ndarray, table: int, same: bool, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at or above the threshold that did not meet in an earlier table."""
    rows = max(1, BLOCK // max(1, len(b)))
    for at in range(0, len(a), rows):
        part = keys_a[at:at + rows]
        open_ = np.ones((len(part), len(b)), dtype=bool)
        if same:
            open_ &= np.arange(at, at + len(part))[:, None] < np.arange(len(b))[None, :]
        for s in range(table):
            if not open_.any():
                break
            open_ &= part[:, s, None] != keys_b[None, :, s]
        if open_.any():
            u, v = np.nonzero(open_ & (a[at:at + rows] @ b.T >= threshold))
            if len(u):
                yield u + at, v


def _check(threshold: float):
    def side(cell) -> tuple[np.ndarray, ...]:
        rows = sorted(cell.as_py(), key=lambda r: r["node"])
        return (
            np.array([r["node"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.int64),
            np.stack([np.frombuffer(r["unit"]) for r in rows]), np.array([r["keys"] for r in rows], dtype=np.int64),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                node, n, unit, keys = side(left)
                same = not right.is_valid
                node_b, n_b, unit_b, keys_b = (node, n, unit, keys) if same else side(right)
                if unit.shape[1] != unit_b.shape[1]:
                    continue
                shift = 0 if same else len(node)
                forest, sums = Forest(len(node) + (0 if same else len(node_b))), [np.zeros(len(node)), np.zeros(len(node_b))]
                for u, v in unit_links(unit, unit_b, keys, keys_b, table, same, threshold):
                    forest.link(u, v + shift)
                    sums[0] += np.bincount(u, weights=n_b[v], minlength=len(node))
                    sums[1] += np.bincount(v, weights=n[u], minlength=len(node_b))
                total = sums[0] + sums[1] if same else np.concatenate(sums)
                every = node if same else np.concatenate([node, node_b])
                linked = np.flatnonzero(total)
                if len(linked):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(every[linked]), pa.array(every[forest.parent[linked]]),
                        pa.array(total[linked].astype(np.int64)),
                    ], names=["a", "b", "links"])
    return run


def pair_work(hashed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(table, left, right) units: the member chunks of every bucket with company, in pairs; right is null for one chunk with itself."""
    keys = hashed.select("node", "group", F.posexplode("keys").alias("table", "key"))
    filled = keys.groupBy("group", "table", "key").agg(F.count("*").alias("m")).where("m > 1").select(
        "*", F.ceil(F.col("m") / chunk).cast("int").alias("parts"))
    members = keys.join(filled, ["group", "table", "key"]).select(
        "node", "group", "table", "key", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    full = members.join(hashed.select("node", "n", "unit", "keys"), "node")
    # Chunk p works with every chunk q: the smaller number stands left.
    cells = full.select(
        "group", "table", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"),
        F.struct("node", "n", "unit", "keys").alias("member"),
    ).select(
        "group", "table", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") <= F.col("other")).alias("is_left"), "member",
    )
    return cells.groupBy("group", "table", "key", "i", "j").agg(
        F.collect_list(F.when(F.col("is_left"), F.col("member"))).alias("left"),
        F.collect_list(F.when(~F.col("is_left"), F.col("member"))).alias("right"),
    ).where((F.size("left") > 0) & ((F.col("i") == F.col("j")) | (F.size("right") > 0))).select(
        "table", "left", F.when(F.col("i") < F.col("j"), F.col("right")).alias("right"))


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, recall: float = RECALL, chunk: int = CHUNK,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    v = F.col("v")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    sound = F.coalesce(
        F.col("label").isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    rows = rows.select("id", F.when(sound, F.struct("label", "v")).alias("what"))
    distinct = cut(
        rows.where("what IS NOT NULL").groupBy("what").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
        .select(F.monotonically_increasing_id().alias("node"), "what", "n", "first_id")
    )
    k, tables = plan(distinct.count(), threshold, recall)
    hashed = cut(
        distinct.select("node", F.col("what.v").alias("v"))
        .mapInArrow(_hash(k, tables, WIDTH), "node long, unit binary, keys array<long>")
        .join(distinct.select("node", "n", F.struct(F.col("what.label"), F.size("what.v").alias("size")).alias("group")), "node")
    )
    found = cut(pair_work(hashed, chunk).mapInArrow(_check(threshold), "a long, b long, links long"))
    sums = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labelled = (
        distinct.join(components(found.select("a", "b")), "node", "left").join(sums, "node", "left")
        .select("what", "n", "first_id", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    known = labelled.join(smallest, "label").select(
        "what", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.where("what IS NOT NULL").join(known, "what").select("id", "n_links", "component_id")
    alone = rows.where("what IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select("*", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
