"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes hashed counts of its words and of their shapes (letter case, digits and punctuation kept, runs
shortened), and steps of its repetition measures (distinct words, doubled words, commonest word, repeated lines). Document frequencies over all documents give the weights; a truncated singular value decomposition of a
bounded sample of labelled documents gives the latent space. The sample's vectors and labels (`SAMPLE` x `DIMS`
numbers, whatever the corpus) and the projection are broadcast, and each task computes exact cosines of its documents
against all of them in blocks; the `NEIGHBOURS` nearest vote with their similarity.

The model learns only from labelled rows of the training fold: crc32(id as text) mod 3 is not 1. Label, language,
source and id are never inputs of a score.

Defined cases: null or empty text, or text without any known feature, scores the sample's label mean; without any
labelled row every score is 0.5; of several labels for one id the lowest counts; null labels and ids are not learnt
from; repeated rows each come back; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents that vote; hashed word and shape features; latent dimensions; voters; documents in a block.
SAMPLE = 4000
WORD_SLOTS, SHAPE_SLOTS = 3072, 1024
STEPS = 16
MEASURES = 4
GROUPS = np.cumsum([0, WORD_SLOTS, SHAPE_SLOTS, STEPS * MEASURES])
SLOTS = int(GROUPS[-1])
DIMS = 64
NEIGHBOURS = 25
BLOCK = 512
#: Weight of the sample's mean in a vote, and the power of a similarity.
PRIOR, POWER = 1e-3, 4
REMEMBERED = 80_000

_CASE = str.maketrans({**{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)},
                       **{str(d): "0" for d in range(10)}})
_RUN = re.compile(r"(.)\1+")
_slots: dict[str, int] = {}
_older: dict[str, int] = {}


def shape(word: str) -> str:
    """Letters as A or a, digits as 0, other characters kept; runs shortened to one in words of letters, else to two."""
    if word.isalpha():
        quick = "a" if word.islower() else "A" if word.isupper() else "Aa" if word.istitle() else ""
        if quick:
            return quick
    body = word[:-1]
    if word[-1] in ",.;:!?" and body.isalpha():  # most words that are not letters only
        n = len(body)
        quick = "aa"[:n] if body.islower() else "AA"[:n] if body.isupper() else "A" + "aa"[:n - 1] if body.istitle() else ""
        if quick:
            return quick + word[-1]
    out = "".join(
        c if c in "Aa0" or ord(c) < 128 else "A" if c.isupper() else "a" if c.isalpha() else c
        for c in word.translate(_CASE)
    )
    return _RUN.sub(r"\1\1", out) if not out.isalpha() else _RUN.sub(r"\1", out)


def _word_slots(words) -> np.ndarray:
    """Word and shape slot of every distinct word, packed into one number; two generations of words are remembered."""
    global _slots, _older
    if len(_slots) > REMEMBERED:
        _slots, _older = {}, _slots
    for word in words:
        if word not in _slots:
            code = _older.get(word)
            if code is None:
                code = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_SLOTS
                code |= (WORD_SLOTS + zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % SHAPE_SLOTS) << 32
            _slots[word] = code
    return np.fromiter(map(_slots.__getitem__, words), dtype=np.int64, count=len(words))


def present(text: str | None) -> np.ndarray:
    """Word and shape slots of a whole text."""
    codes = _word_slots(set((text or "").split()))
    return np.unique(np.concatenate([codes & 0xFFFFFFFF, codes >> 32]))


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of a whole text and how often each occurs."""
    tokens = (text or "").split()
    words = Counter(tokens)
    codes = _word_slots(words)
    n = np.fromiter(words.values(), dtype=np.float64, count=len(words))
    total = np.bincount(np.concatenate([codes & 0xFFFFFFFF, codes >> 32]), weights=np.concatenate([n, n]), minlength=SLOTS)
    if tokens:
        total[[GROUPS[2] + STEPS * m + min(STEPS - 1, int(STEPS * x)) for m, x in enumerate(repetition(tokens, words, text))]] = 1
    at = np.flatnonzero(total)
    return at, total[at]


def repetition(tokens: list[str], words: Counter, text: str) -> tuple[float, ...]:
    """Shares between 0 and 1: distinct words, words equal to the one before, the commonest word, repeated lines."""
    lines = [line for line in text.split("\n") if line]
    doubled = sum(map(operator.eq, tokens, itertools.islice(tokens, 1, None)))
    return (
        math.sqrt(len(words) / len(tokens)), math.sqrt(doubled / len(tokens)), max(words.values()) / len(tokens),
        1 - len(set(lines)) / max(1, len(lines)),
    )


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray, out: np.ndarray) -> None:
    """Write the weighted features of one text; words, shapes and measures have the same length."""
    for low, high in itertools.pairwise(np.searchsorted(at, GROUPS).tolist()):
        part = slice(low, high)
        value = (1 + np.log(n[part])) * idf[at[part]]
        norm = math.sqrt(value @ value)
        if norm:
            out[at[part]] = value / norm


@dataclass
class Voters:
    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, texts: list[str | None]) -> np.ndarray:
        rows = np.zeros((len(texts), SLOTS), dtype=np.float32)
        for i, text in enumerate(texts):
            weigh(*counts(text), self.idf, rows[i])
        return unit(rows @ self.project)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        near = self.latent(texts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** POWER
        return (votes * self.labels[top]).sum(1) / (votes.sum(1) + PRIOR) + (
            PRIOR * self.labels.mean() / (votes.sum(1) + PRIOR))


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def decompose(rows: np.ndarray, dims: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors by subspace iteration."""
    rng = np.random.default_rng(seed)
    dims = min(dims, *rows.shape)
    basis = rng.standard_normal((rows.shape[1], min(rows.shape[1], dims + 16))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    small = rows @ basis
    _, turn = np.linalg.eigh(small.T @ small)
    return (basis @ turn[:, ::-1][:, :dims]).astype(np.float32)


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents and of those that hold each word or shape slot, over all rows: one short row per slot and task.

    Repetition measures are steps of one scale, so they carry no such weight.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(SLOTS, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                held[present(text.as_py())] += 1
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, SLOTS)), pa.array(np.concatenate([[n], held]))], names=["slot", "n"]
            )

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "slot long, n long")
    out = np.zeros(SLOTS + 1, dtype=np.int64)
    for r in rows.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # as many rows as slots
        out[r["slot"] + 1] = r["n"]
    return int(out[0]), out[1:]


def fold(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def voting_texts(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, y): one text for each picked id, that of the smallest hash where an id repeats."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    known = texts.join(F.broadcast(picked), "id").groupBy("id", "y")
    one = known.agg(F.min(F.struct(F.xxhash64("t").alias("k"), "t")).alias("one")).select("id", "one.t", "y")
    return one.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # few rows, but each costs time


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE,
) -> Voters:
    """Voters from at most `sample` labelled documents of the training fold, the first in the order of a hash."""
    total, held = frequencies(docs, text_col)
    idf = np.log((1 + total) / (1 + held)) + 1
    idf[GROUPS[2]:] = 1
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 1)).groupBy(
        F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), F.lit("voter")).alias("k")).join(
        known, "id").distinct().orderBy("k", "id").limit(sample).select("id", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = zip(*(counts(t.as_py()) for t in batch.column(1)), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([x.tolist() for x in at], pa.list_(pa.int64())),
                 pa.array([x.tolist() for x in n], pa.list_(pa.float64()))], names=["id", "y", "at", "n"]
            )

    found = voting_texts(docs, picked, id_col, text_col).mapInArrow(
        run, "id long, y int, at array<long>, n array<double>").toArrow()
    ids, first = np.unique(found["id"].to_numpy(), return_index=True)
    rows = np.zeros((len(ids), SLOTS), dtype=np.float32)
    for i, k in enumerate(first.tolist()):
        weigh(np.array(found["at"][k].as_py(), dtype=np.int64), np.array(found["n"][k].as_py()), idf, rows[i])
    if not len(ids):
        return Voters(idf, np.zeros((SLOTS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    project = decompose(rows, DIMS)
    return Voters(idf, project, unit(rows @ project), found["y"].to_numpy()[first].astype(np.float64))


def scored(docs: DataFrame, voters: Voters, text_col: str = "text") -> DataFrame:
    """The documents with all their columns as struct `row`, and `score`; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("t")
    )
    return _score(rows, shared)


def _score(rows: DataFrame, shared) -> DataFrame:
    """The rows with `score` in place of the text, which is their last column `t`."""
    keep = rows.columns[:-1]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, own = batch.column(batch.num_columns - 1), batch.columns[:-1]
            for a in range(0, batch.num_rows, BLOCK):
                part = [t.as_py() for t in text.slice(a, BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, BLOCK) for c in own), pa.array(shared.value.score(part))], names=[*keep, "score"]
                )

    return rows.mapInArrow(run, schema)


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.5,
) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    voters = fit(docs, labels, id_col, text_col, label_col)
    return scored(docs, voters, text_col).where(F.col("score") >= threshold).select("row.*")


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE,
) -> DataFrame:
    """(id, held_out, score) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, sample))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("t"),
    )
    return _score(rows, shared)
