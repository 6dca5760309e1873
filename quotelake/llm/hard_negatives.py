"""Hard negatives by inner product, with the coordinate pruning of LEMP (large-entry retrieval of matrix products).

A row's score is its inner product with an anchor, over integers. Rows are cut by length (four classes for each power
of two) and, within a class, by a hash into chunks of about `CHUNK` rows; anchors meet chunks in blocks of about
`BLOCK` rows, so a task holds one block and one chunk. Inside a chunk rows stand in order of falling length, in
buckets of `BUCKET` rows. A bucket keeps, for each coordinate, its unit vectors in order of that coordinate. An anchor
that needs a score of at least t divides it by its own length and by the bucket's greatest: no row of the bucket can
do with a smaller cosine. That cosine bounds every coordinate of a row to a feasible range around the anchor's own
coordinate; the ranges of the anchor's `FOCUS` largest coordinates are looked up in the ordered lists and the rows
that lie in all of them are verified with exact integer products. Buckets too short for t are skipped whole.

First every anchor's positives (best rows of its label): chunks are cut by label too, and the anchor's own k-th best
so far is its t. Then the negatives (best rows of other labels within a range of scores that each positive sets): t is
the lower end of the lowest range and rises with the k-th best found in every range. A task returns at most k rows for
each of its anchors and positives; Spark keeps the best k of all tasks. Every anchor is compared with all rows, in
blocks; no bucket, partner list or candidate set is capped.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part;
rows of different vector size never meet; rows equal in id, label and vector count once; a row is never its own
anchor's partner and neither is another row of the same id; ties go to the smaller id, then to the order of the rows;
components are truncated to integers, and components and scores beyond a long stop at its ends; a zero vector takes part with score
0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelake.llm.common import cut

CHUNK = 8192
BLOCK = 4096
BUCKET = 1024
FOCUS = 3
#: Slack of the floating-point bounds; verification is exact.
SLACK = 1e-9
LEAST = np.iinfo(np.int64).min


def exact_products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products as longs: in floating point where that is exact, else in integers, else in unbounded ones."""
    size = max(1, rows.shape[1])
    peak = float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(np.abs(anchor.astype(np.float64)).max(initial=0))
    if peak * size < 2.0**53:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    if peak * size < 2.0**62:
        return rows @ anchor
    whole = rows.astype(object) @ anchor.astype(object)
    return np.array([min(max(int(x), LEAST), np.iinfo(np.int64).max) for x in whole], dtype=np.int64)


class Bucket:
    """Rows of similar length with one ordered list for each coordinate."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> None:
        self.rows, self.at, self.longest = rows, at, float(lengths.max(initial=0))
        unit = rows / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(unit, self.order, axis=0)
        self.place = np.empty_like(self.order)
        np.put_along_axis(self.place, self.order, np.arange(len(rows))[:, None], axis=0)

    def candidates(self, anchor: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Positions of rows that can reach the score; None: all."""
        reach = length * self.longest
        if reach == 0:
            return None if least <= 0 else np.empty(0, dtype=np.int64)
        cosine = least / reach - SLACK
        if cosine > 1:
            return np.empty(0, dtype=np.int64)
        if cosine <= 0:  # a short row may reach a threshold at or below zero with any cosine
            return None
        unit = anchor / length
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        spread = np.sqrt((1 - cosine**2) * np.maximum(0.0, 1 - unit[focus] ** 2)) + SLACK
        low, high = unit[focus] * cosine - spread, unit[focus] * cosine + spread
        # Up to the poles of the anchor a larger cosine widens nothing: the range also holds the anchor's own value.
        low, high = np.where(unit[focus] <= -cosine, -1 - SLACK, low), np.where(unit[focus] >= cosine, 1 + SLACK, high)
        first = [np.searchsorted(self.sorted[:, f], x, "left") for f, x in zip(focus, low, strict=True)]
        last = [np.searchsorted(self.sorted[:, f], x, "right") for f, x in zip(focus, high, strict=True)]
        widths = [b - a for a, b in zip(first, last, strict=True)]
        tightest = int(np.argmin(widths))
        if widths[tightest] == len(self.rows):
            return None
        found = self.order[first[tightest]:last[tightest], focus[tightest]]
        for n, f in enumerate(focus):
            if n != tightest and widths[n] < len(self.rows):
                place = self.place[found, f]
                found = found[(place >= first[n]) & (place < last[n])]
        return found


class Chunk:
    """Rows of one chunk in buckets of falling length."""

    def __init__(self, part: pa.Table, size: int) -> None:
        rows = vectors_of(part, size)
        lengths = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.id, self.row = (part.column(c).to_numpy()[order] for c in ("id", "row"))
        self.label = np.array(part.column("label").to_pylist(), dtype=object)[order]
        rows, lengths = rows[order], lengths[order]
        self.buckets = [
            Bucket(rows[at:at + BUCKET], lengths[at:at + BUCKET], np.arange(at, min(at + BUCKET, len(rows))))
            for at in range(0, len(rows), BUCKET)
        ]

    def reaching(self, anchor: np.ndarray, length: float, least: float, bucket: Bucket) -> tuple[np.ndarray, np.ndarray]:
        """Chunk positions and scores of the verified candidates of a bucket."""
        some = bucket.candidates(anchor, length, least)
        rows, at = (bucket.rows, bucket.at) if some is None else (bucket.rows[some], bucket.at[some])
        scores = exact_products(rows, anchor) if len(at) else np.empty(0, dtype=np.int64)
        good = scores >= least
        return at[good], scores[good]


def vectors_of(part: pa.Table, size: int) -> np.ndarray:
    flat = part.column("v").combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy().reshape(-1, size)


class Best:
    """The k best rows so far by falling score, then id, then row."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id, self.row = k, *(np.empty(0, dtype=np.int64) for _ in range(3))

    def add(self, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        if not len(score):
            return
        score, id_, row = (np.concatenate(p) for p in ((self.score, score), (self.id, id_), (self.row, row)))
        # Scores run through all longs, whose least has no negative: order by the complement instead.
        best = np.lexsort((row, id_, ~score))[:self.k]
        self.score, self.id, self.row = score[best], id_[best], row[best]

    def least(self) -> int:
        """A new row must score at least this to be taken."""
        return int(self.score[-1]) if len(self.score) == self.k else LEAST


def _positives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if len(anchors) and len(rows):
            size = len(rows.column("v")[0])
            chunk, vectors = Chunk(rows, size), vectors_of(anchors, size)
            for a, id_, own, v in zip(anchors.column("a").to_pylist(), anchors.column("id").to_pylist(), anchors.column("row").to_pylist(), vectors, strict=True):
                best, length = Best(k), float(np.sqrt((v.astype(np.float64) ** 2).sum()))
                for bucket in chunk.buckets:
                    at, score = chunk.reaching(v, length, best.least(), bucket)
                    other = (chunk.id[at] != id_) & (chunk.row[at] != own)
                    best.add(score[other], chunk.id[at][other], chunk.row[at][other])
                for column, values in zip(out, ([a] * len(best.score), best.score, best.id, best.row, [id_] * len(best.score)), strict=True):
                    column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "score", "id", "row", "anchor_id"])
    return run


def score_range(score: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int]:
    """Least and greatest whole scores with low*score <= score' <= high*score, shares as fractions."""
    return -((-low[0] * score) // low[1]), (high[0] * score) // high[1]


def _negatives(k: int, low: tuple[int, int], high: tuple[int, int]):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if len(anchors) and len(rows):
            size = len(rows.column("v")[0])
            chunk, vectors = Chunk(rows, size), vectors_of(anchors, size)
            sides = (anchors.column(c).to_pylist() for c in ("a", "id", "label", "scores"))
            for a, id_, label, scores, v in zip(*sides, vectors, strict=True):
                length = float(np.sqrt((v.astype(np.float64) ** 2).sum()))
                ranges = {s: (*score_range(s, low, high), Best(k)) for s in scores}
                ranges = {s: r for s, r in ranges.items() if r[0] <= r[1]}
                for bucket in chunk.buckets:
                    if not ranges:
                        break
                    least = min(max(r[0], r[2].least()) for r in ranges.values())
                    at, score = chunk.reaching(v, length, least, bucket)
                    other = (chunk.label[at] != label) & (chunk.id[at] != id_)
                    at, score = at[other], score[other]
                    for floor, top, best in ranges.values():
                        fits = (score >= max(floor, best.least())) & (score <= top)
                        best.add(score[fits], chunk.id[at][fits], chunk.row[at][fits])
                for s, (_, _, best) in ranges.items():
                    for column, values in zip(out, ([a] * len(best.score), [s] * len(best.score), best.score, best.id, best.row), strict=True):
                        column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "positive_score", "score", "id", "row"])
    return run


def _meet(
    anchors: DataFrame, rows: DataFrame, keys: list[str], chunk: int, block: int, run, schema: str
) -> DataFrame:
    """`run` over every pair of an anchor block and a chunk of rows with equal keys."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    classed = rows.withColumn("class", F.when(norm > 0, F.floor(F.log2(norm) * 2)).otherwise(-1).cast("int"))
    parts = classed.groupBy(*keys, "class").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    blocks = anchors.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # A key has few length classes, so the list of its classes is short; the chunks of a class are numbers.
    layout = parts.groupBy(*keys).agg(F.collect_list(F.struct("class", "parts")).alias("layout"))
    unit = ("class", "part", "block")
    left = anchors.join(layout, keys).join(blocks, keys).select(
        *anchors.columns, F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.explode("layout").alias("of"),
    ).select(*anchors.columns, "block", "of.class", F.explode(F.sequence(F.lit(0), F.col("of.parts") - 1)).alias("part"))
    right = classed.join(parts, [*keys, "class"]).join(blocks, keys).select(
        *rows.columns, "class", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from one table
    return left.groupBy(*keys, *unit).cogroup(right.groupBy(*keys, *unit)).applyInArrow(run, schema)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _whole(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024)).cast("long")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100), high: tuple[int, int] = (100, 100),
    chunk: int = CHUNK, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); `is_anchor` is a condition on the rows."""
    whole = F.col(vector_col).cast("array<double>")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), whole.alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).where(
        "id IS NOT NULL AND label IS NOT NULL AND size(v) > 0"
    ).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = cut(rows.select("id", "label", F.transform("v", _whole).alias("v"), "is_anchor").distinct().select(
        F.monotonically_increasing_id().alias("row"), "*", F.size("v").alias("size")))
    plain = rows.drop("is_anchor")
    anchors = rows.where("is_anchor").select(F.col("row").alias("a"), "row", "id", "label", "v", "size")

    near = _meet(
        anchors, plain, ["size", "label"], chunk, block, _positives(positives),
        "a long, score long, id long, row long, anchor_id long")
    near = cut(_first(near, ["a"], positives).select(
        "a", "anchor_id", F.col("id").alias("positive_id"), F.col("row").alias("positive_row"), F.col("score").alias("positive_score")))
    asked = near.groupBy("a").agg(F.collect_set("positive_score").alias("scores"))  # at most `positives` numbers
    far = _meet(
        anchors.join(asked, "a"), plain, ["size"], chunk, block, _negatives(negatives, low, high),
        "a long, positive_score long, score long, id long, row long")
    far = _first(far, ["a", "positive_score"], negatives)
    return near.join(far, ["a", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
