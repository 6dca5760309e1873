"""Benchmark decontamination by Wu-Manber search over whole texts.

Every benchmark item gives its windows of 13 consecutive words (an item of fewer words is one window). Documents and
windows are normalised to lower-case words between single blanks, so that a window is a byte string and the search
runs on bytes. Windows fall into classes by length; each class has a block shift table (hashed blocks of 8 bytes, 3
for very short windows), which moves the cursors on by as much as the block under them allows. A zero shift looks up
the bucket of the block and the window's first bytes, and a direct comparison confirms. Many cursors, each with its own
stretch of the text, advance together in numpy arrays.

The benchmark is a stated query set; it goes out in blocks of at most `BLOCK_BYTES` of text (hashed by item), each
broadcast by itself, and a task holds the tables of one block at a time. Documents are never shuffled.

Defined cases: null or empty text has no words and is clean; an item without words has no windows; items with a null
id count for hits but are not listed; repeated items count once; repeated documents each come back; empty tables give
no rows or clean rows; other columns are ignored or, in `drop_contaminated`, passed through under their names.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: A document is contaminated when hit words times this reach all words.
SHARE = 20
BLOCK_BYTES = 2_000_000
SLICE = 8_000_000
STRETCH = 512
MIX = np.uint64(0x9E3779B97F4A7C15)

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 32 for b in range(256))


def words(raw: bytes | None) -> list[bytes]:
    """Lower-case words of a UTF-8 text: runs of ASCII letters, digits and characters beyond ASCII."""
    return (raw or b"").translate(_TABLE).split()


def windows(text: bytes | None, size: int = WINDOW) -> set[bytes]:
    found = words(text)
    if not found:
        return set()
    return {b" " + b" ".join(found[i:i + size]) + b" " for i in range(max(1, len(found) - size + 1))}


class _Class:
    """Shift table and buckets of the windows whose length has the same order of magnitude."""

    def __init__(self, group: dict[bytes, list[str]]) -> None:
        self.least = min(map(len, group))
        self.block = 8 if self.least >= 8 else 3
        span = self.least - self.block
        heads = b"".join(w[:self.least] for w in group)
        starts = np.arange(len(group), dtype=np.int64) * self.least
        view = _blocks(np.frombuffer(heads + bytes(8), dtype=np.uint8), self.block)
        self.bits = max(16, min(24, int(np.ceil(np.log2(16 * len(group) * (span + 1) + 1)))))
        self.shift = np.full(1 << self.bits, span + 1, dtype=np.int16 if span < 32_000 else np.int64)
        for j in range(span + 1):  # ascending, so that the last and smallest shift stays
            self.shift[self.slot(view(starts + j))] = span - j
        self.buckets: dict[bytes, list[tuple[bytes, list[str]]]] = defaultdict(list)
        for window, items in group.items():
            self.buckets[self.key(window, 0)].append((window, items))

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks * MIX) >> np.uint64(64 - self.bits)

    def key(self, data: bytes, at: int) -> bytes:
        return data[at:at + self.block] + data[at + self.least - self.block:at + self.least]

    def search(self, data: bytes, flat: np.ndarray) -> Iterator[tuple[int, bytes, list[str]]]:
        last = len(data) - self.least
        if last < 0:
            return
        view, jump = _blocks(flat, self.block), self.least - self.block
        at = np.arange(0, last + 1, STRETCH, dtype=np.int64)
        end = np.minimum(at + STRETCH, last + 1)
        while len(at):
            shift = self.shift[self.slot(view(at + jump))]
            for p in at[shift == 0].tolist():
                for window, items in self.buckets.get(self.key(data, p), ()):
                    if data.startswith(window, p):
                        yield p, window, items
            at = at + np.maximum(shift, 1)
            alive = at < end
            at, end = at[alive], end[alive]


def _blocks(flat: np.ndarray, size: int):
    """Reads the block at each offset as one integer; flat ends in eight spare bytes."""
    every = np.ndarray((max(0, len(flat) - 7),), dtype="<u8", buffer=flat, strides=(1,))
    mask = np.uint64((1 << 8 * size) - 1) if size < 8 else None
    return lambda at: every[at] if mask is None else every[at] & mask


class Matcher:
    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int = WINDOW) -> None:
        owners: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            for window in windows(text, size):
                owners[window].update(() if item is None else (item,))
        groups: dict[int, dict[bytes, list[str]]] = defaultdict(dict)
        for window, own in owners.items():
            groups[min(6, max(2, len(window).bit_length() - 1))][window] = sorted(own)
        self.classes = [_Class(g) for g in groups.values()]

    def mark(self, data: bytes, flat: np.ndarray, blanks: np.ndarray, owner: np.ndarray, hits: np.ndarray, found: list[set[str]]) -> None:
        """Mark hit words (by the blank before each) and the items of every document in a joined text."""
        for group in self.classes:
            for p, window, items in group.search(data, flat):
                k = int(np.searchsorted(blanks, p))
                hits[k:k + window.count(b" ") - 1] = True
                found[owner[k]].update(items)


def scan(texts: list[bytes | None], matchers) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """(words, hit flag of each word, items) of every text."""
    every = [words(t) for t in texts]
    data = b"\n".join([b" " + b" ".join(w) + b" " if w else b"" for w in every])
    flat = np.frombuffer(data + bytes(8), dtype=np.uint8)
    blanks = np.flatnonzero(flat == 32)
    counts = [len(w) + 1 if w else 0 for w in every]
    owner = np.repeat(np.arange(len(texts)), counts)
    hits, found = np.zeros(len(blanks), dtype=bool), [set() for _ in texts]
    for matcher in matchers:
        matcher.mark(data, flat, blanks, owner, hits, found)
    at = 0
    for n, items in zip(counts, found, strict=True):
        yield max(0, n - 1), hits[at:at + max(0, n - 1)], items
        at += n


_matcher: dict[tuple, Matcher] = {}


def _matchers(blocks: list, size: int) -> Iterator[Matcher]:
    for name, block in blocks:
        key = (name, size)
        if key not in _matcher:
            _matcher.clear()
            _matcher[key] = Matcher(block.value, size)
        yield _matcher[key]


def _query_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> list:
    """The benchmark as named broadcast variables of about `limit` bytes of text each."""
    rows = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // limit))
    context = benchmark.sparkSession.sparkContext
    out = []
    for k in range(parts):
        block = rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) if parts > 1 else rows
        items = [(r["item"], bytes(r["text"] or b"")) for r in block.collect()]
        out.append((uuid.uuid4().hex, context.broadcast(items)))
    return out


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    start, held, size = 0, [], 0
    for i, value in enumerate(column):
        raw = value.as_py()
        held.append(raw)
        size += len(raw or b"")
        if size >= SLICE:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def is_contaminated(n_words: int, n_hit: int, share: int = SHARE) -> bool:
    return n_hit > 0 and share * n_hit >= n_words


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """id, n_words, n_hit, items (ids as strings, sorted), spans (hit word ranges, end exclusive), contaminated."""
    blocks = _query_blocks(benchmark, item_col, item_text_col, block_bytes)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _groups(batch.column(1)):
                out: list[tuple] = []
                for n, hit, items in scan(texts, _matchers(blocks, size)):
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))).tolist()
                    spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    hits = int(hit.sum())
                    out.append((n, hits, sorted(items), spans, is_contaminated(n, hits)))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), span, pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    names=["id", "n_words", "n_hit", "items", "spans", "contaminated"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(
        run, "id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The clean documents with all their columns; no shuffle."""
    blocks = _query_blocks(benchmark, item_col, item_text_col, block_bytes)
    names = docs.columns
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(text_col).cast("string").cast("binary").alias("t")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = chain.from_iterable(
                [not is_contaminated(n, int(hit.sum())) for n, hit, _ in scan(texts, _matchers(blocks, size))]
                for _, texts in _groups(batch.column(1))
            )
            keep = pa.array(list(clean), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], names=["row"])

    schema = rows.select("row").schema
    return rows.mapInArrow(run, schema).select("row.*")
