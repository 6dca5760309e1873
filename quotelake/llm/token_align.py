"""Alignment of two tokenizers' tokens over the same texts, in Arrow columns.

A (byte-level) reads a space and the text, B (pieces) reads the text and adds that space itself, so both cut the same
bytes. Per batch the token lists are flattened, with the document of every token from the lists' parent indices; token
lengths come from a table by id, and cumulative sums that start anew with every document turn them into ends. An Acero
hash join on (document, end) finds the offsets where tokens of both end; between two of them lies a group, and every A
token of a group is linked with every B token of it. `Table.group_by` counts the links of each id pair in a document.

Counts over the corpus: `Table.group_by` again counts, for each task, how many documents hold a pair; Spark sums these
partial counts. Their number is bounded by the vocabularies, not by the corpus. They come back to the documents in
slices of A ids with at most `SLICE` pairs (and one A id's pairs more), each a broadcast; a document's sums over the
slices add up. Texts are encoded once: pairs and digests go to Parquet in the shared folder, texts and tokens do not.

Tokens of A are those of its library, with special strings as plain text. Where its merges are in the order of their
ids and every token is its own encoding, the same tokens come from an encoder that merges by rank, several times faster.

Memory: a task works on texts of `TEXTS` characters at a time, or on one longer text, which is encoded in pieces of
about `PIECE` characters. A piece ends before a space between two letters, where neither tokenizer can join what stands
on both sides (A's pattern starts a token there; no piece of B holds a space after another character). Links are made
in steps of `LINKS`; a group of more counts its distinct ids first.

Defined cases: a null or empty text, and one whose tokens do not spell the space and the text (characters that B
normalises), has no tokens, zeros and an empty digest; repeated rows and ids are documents of their own; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import shared_folder

TEXTS = 1 << 21
PIECE = 1 << 16
LINKS = 1 << 20
SLICE = 1 << 22
#: Between two letters, a space starts a token of both.
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Pair:
    """Both tokenizers with the bytes of their tokens; one for each Python worker."""

    made: dict[tuple[str, str], Pair] = {}

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        spoken, signs = [b""] * sizes(a_path, b_path)[0], byte_alphabet()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            if all(c in signs for c in token):  # the others are special tokens, which no text is given
                spoken[i] = bytes(signs[c] for c in token)
        self.ranked = _by_rank(a_path, self.a, spoken)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes = pa.array(spoken, pa.binary()), pa.array([
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ], pa.binary())
        self.lengths = [pc.binary_length(b).cast(pa.int64()) for b in self.bytes]
        self.names = [pa.array([str(i) for i in range(len(b))]) for b in self.bytes]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Pair:
        if (a_path, b_path) not in cls.made:
            cls.made = {(a_path, b_path): cls(a_path, b_path)}
        return cls.made[a_path, b_path]

    def pieces(self, text: str, piece: int) -> list[str]:
        """The text in parts that are tokenized alike on their own; the space between two parts is left out."""
        parts, start = [], 0
        while self.cuts and len(text) - start > piece:
            cut = _CUT.search(text, start + piece)
            if not cut:
                break
            parts.append(text[start:cut.start()])
            start = cut.end()
        return [*parts, text[start:]]

    def encode(self, texts: list[str], piece: int) -> list[pa.ListArray]:
        """Token ids of both, one list for each text."""
        parts = [self.pieces(t, piece) if t else [] for t in texts]
        flat = [p for of in parts for p in of]
        spaced = [f" {p}" for p in flat]
        if self.ranked:
            made = [self.ranked.encode_to_numpy(p, disallowed_special=()) for p in spaced]
        else:
            made = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        out = [made, self.b.encode(flat, num_threads=1) if flat else []]
        ends = np.cumsum([0, *map(len, parts)])
        return [_lists(ids, ends) for ids in out]


#: A fixed value: the pattern of byte-level vocabularies that name none of their own.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _by_rank(path: str, library, spoken: list[bytes]):
    """A faster encoder with the same result, or None.

    Merging by the rank of the merged token equals merging by the list of merges if the list is in the order of ids
    and every token is its own encoding: a part of a word that spells a token can then be reached in one way only.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    model, split = known["model"], known.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in merges]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if known.get("normalizer") or not plain or ids != sorted(ids):
        return None
    special = {t["id"] for t in known.get("added_tokens", [])}
    ranks = {b: i for i, b in enumerate(spoken) if b and i not in special}
    for token, i in model["vocab"].items():
        if i not in special and [t.id for t in library.model.tokenize(token)] != [i]:
            return None
    return tiktoken.Encoding("by_rank", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _lists(ids: list, ends: np.ndarray) -> pa.ListArray:
    upto = np.cumsum([0, *map(len, ids)])
    if ids and isinstance(ids[0], np.ndarray):
        flat = np.concatenate(ids).astype(np.int32)
    else:
        flat = np.fromiter((i for of in ids for i in of), dtype=np.int32, count=int(upto[-1]))
    return pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), pa.array(flat))


def sizes(a_path: str, b_path: str) -> tuple[int, int]:
    """Ids of A and of B lie below these."""
    from sentencepiece import SentencePieceProcessor

    with open(a_path, encoding="utf-8") as f:
        known = json.load(f)
    top = max([*known["model"]["vocab"].values(), *(t["id"] for t in known.get("added_tokens", []))])
    return top + 1, SentencePieceProcessor(model_file=b_path).vocab_size()


def spell(tokens: pa.ListArray, table: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all tokens in a row and the offset of every text in them."""
    spelt = pc.take(table, tokens.flatten())
    data = spelt.buffers()[2]
    upto = np.frombuffer(spelt.buffers()[1], dtype=np.int32, count=len(spelt) + 1)
    return memoryview(data) if data else memoryview(b""), upto[tokens.offsets.to_numpy()]


def ends_of(tokens: pa.ListArray, lengths: pa.Array) -> pa.Table:
    """(doc, end, at) of every token: its text, the offset of its end in the text's bytes, its number in the batch."""
    flat, doc = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    total = pc.cumulative_sum(pc.take(lengths, flat))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), total]), tokens.offsets.slice(0, len(tokens)))
    return pa.table({"doc": doc, "end": pc.subtract(total, pc.take(before, doc)), "at": pa.array(np.arange(len(flat)))})


class Aligned:
    """Groups of a batch of texts; only texts that both tokenizers spell alike have any."""

    def __init__(self, pair: Pair, texts: list[str | None], piece: int = PIECE) -> None:
        self.pair = pair
        tokens = pair.encode([t or "" for t in texts], piece)
        views = [spell(t, table) for t, table in zip(tokens, pair.bytes, strict=True)]
        sound = np.ones(len(texts), dtype=bool)
        for i, text in enumerate(texts):
            if text:
                whole = f" {text}".encode()
                sound[i] = all(bytes(view[upto[i]:upto[i + 1]]) == whole for view, upto in views)
        if not sound.all():
            tokens = [_only(t, sound) for t in tokens]
        self.a, self.b = tokens
        ends = [ends_of(t, lengths) for t, lengths in zip(tokens, pair.lengths, strict=True)]
        both = ends[0].join(
            ends[1], keys=["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False, coalesce_keys=True)
        order = np.argsort(both.column("at").to_numpy())
        self.doc, last_a, last_b = (both.column(c).to_numpy()[order] for c in ("doc", "at", "at_b"))
        self.n_a, self.n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        self.first_a, self.first_b = last_a + 1 - self.n_a, last_b + 1 - self.n_b
        self.upto = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.upto[1:]] - total[self.upto[:-1]]

    def digests(self) -> list[str]:
        """Hash of every text's groups as written text; empty without tokens."""
        sides = [
            pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(t.values)), pa.int32()), pc.take(names, t.flatten())), ",")
            for t, names, first in zip((self.a, self.b), self.pair.names, (self.first_a, self.first_b), strict=True)
        ]
        groups = pc.binary_join_element_wise(*sides, "|")
        written = pc.binary_join(pa.ListArray.from_arrays(pa.array(self.upto, pa.int32()), groups), ";")
        return [hashlib.sha256(memoryview(w.as_buffer())).hexdigest() if n else "" for w, n in zip(written, np.diff(self.upto), strict=True)]

    def pairs(self, limit: int = LINKS) -> pa.Table:
        """(doc, key, times) in order: how often each text links each id pair; key = A's id * B's size + B's id."""
        a, b = (t.flatten().to_numpy() for t in (self.a, self.b))
        steps = [_counted(t) for t in self._links(a, b, len(self.pair.bytes[1]), limit)]
        return (_counted(pa.concat_tables(steps)) if len(steps) > 1 else steps[0]).sort_by([("doc", "ascending"), ("key", "ascending")])

    def _links(self, a: np.ndarray, b: np.ndarray, base: int, limit: int) -> Iterator[pa.Table]:
        links = self.n_a * self.n_b
        large = links > limit
        small = np.flatnonzero(~large)
        upto, start = np.cumsum(links[small]), 0
        while True:
            done = upto[start - 1] if start else 0
            stop = int(np.searchsorted(upto, done + limit, "right"))
            some = small[start:stop]
            of = np.repeat(some, links[some])
            nth = np.arange(len(of)) - np.repeat(upto[start:stop] - links[some] - done, links[some])
            wide = self.n_b[of]
            key = a[self.first_a[of] + nth // wide].astype(np.int64) * base + b[self.first_b[of] + nth % wide]
            yield pa.table({"doc": self.doc[of], "key": key, "times": np.ones(len(of), dtype=np.int64)})
            start = stop
            if start >= len(small):
                break
        for g in np.flatnonzero(large):
            left, n_left = np.unique(a[self.first_a[g]:self.first_a[g] + self.n_a[g]], return_counts=True)
            right, n_right = np.unique(b[self.first_b[g]:self.first_b[g] + self.n_b[g]], return_counts=True)
            rows = max(1, limit // len(right))
            for at in range(0, len(left), rows):
                key = (left[at:at + rows, None].astype(np.int64) * base + right).ravel()
                times = (n_left[at:at + rows, None] * n_right).ravel()
                yield pa.table({"doc": np.full(len(key), self.doc[g]), "key": key, "times": times})


def _only(tokens: pa.ListArray, sound: np.ndarray) -> pa.ListArray:
    counts = np.diff(tokens.offsets.to_numpy())
    flat = tokens.flatten().to_numpy()[np.repeat(sound, counts)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(counts * sound)]), pa.int32()), pa.array(flat))


def _counted(links: pa.Table) -> pa.Table:
    found = links.group_by(["doc", "key"], use_threads=False).aggregate([("times", "sum")])
    return found.select(["doc", "key", "times_sum"]).rename_columns(["doc", "key", "times"])


def _batches(batches: Iterator[pa.RecordBatch], limit: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """Batches whose last column, the texts, has at most `limit` characters, or one text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _groups(a_path: str, b_path: str, piece: int):
    """(id, row, a_ids, b_ids, n_a, n_b): tokens, and how many of each every group takes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(a_path, b_path)
        for batch in _batches(batches):
            found = Aligned(pair, batch.column(2).to_pylist(), piece)
            upto = pa.array(found.upto, pa.int32())
            sized = [pa.ListArray.from_arrays(upto, pa.array(n.astype(np.int32))) for n in (found.n_a, found.n_b)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), found.a, found.b, *sized], names=["id", "row", "a_ids", "b_ids", "n_a", "n_b"])
    return run


def _measured(a_path: str, b_path: str, piece: int, code: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(a_path, b_path)
        for batch in _batches(batches):
            found = Aligned(pair, batch.column(2).to_pylist(), piece)
            pairs = found.pairs()
            upto = pa.array(np.searchsorted(pairs.column("doc").to_numpy(), np.arange(batch.num_rows + 1)), pa.int32())
            lists = [
                pa.ListArray.from_arrays(upto, pairs.column(c).combine_chunks().cast(t)) for c, t in (("key", code), ("times", pa.int64()))]
            numbers = [np.diff(t.offsets.to_numpy()).astype(np.int64) for t in (found.a, found.b)]
            numbers += [np.diff(found.upto), found.per_text(found.n_a * found.n_b)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(n, pa.int64()) for n in numbers), pa.array(found.digests()), *lists],
                names=["id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"])
    return run


def _partial_counts(code: pa.DataType, limit: int = 1 << 20):
    """Counts of the keys of a task, one row for each; a key may come again once `limit` keys are held."""
    def merged(tables: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(tables).group_by("key", use_threads=False).aggregate([("docs", "sum")])
        return found.select(["key", "docs_sum"]).rename_columns(["key", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            key = pc.list_flatten(batch.column(0))
            held.append(pa.table({"key": key.cast(code), "docs": pa.array(np.ones(len(key), dtype=np.int64))}))
            size += len(key)
            if size > limit:
                held = [merged(held)]
                size = held[0].num_rows
                if size > limit:
                    yield from held[0].combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from merged(held).combine_chunks().to_batches()
    return run


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _looked_up(known):
    """Adds to every document the best links and the count sum over one slice of the pair counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, best = known.value
        for batch in batches:
            lists, times = batch.column("keys"), pc.list_flatten(batch.column("times")).to_numpy()
            flat, doc = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy()
            sums = [np.zeros(batch.num_rows, dtype=np.int64) for _ in range(2)]
            if len(keys) and len(flat):
                inside = np.flatnonzero((flat >= keys[0]) & (flat <= keys[-1]))
                at = np.searchsorted(keys, flat[inside])
                of = doc[inside]
                for total, worth in zip(sums, (best[at], docs[at]), strict=True):
                    np.add.at(total, of, times[inside] * worth)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "row", *_NUMBERS, "groups_sha256")), *map(pa.array, sums)],
                names=["id", "row", *_NUMBERS, "groups_sha256", "n_best", "count_sum"])
    return run


def slices(per_a: list[tuple[int, int]], limit: int = SLICE) -> list[tuple[int, int]]:
    """[first, last] A ids, so that a slice has at most `limit` pairs, or those of one A id."""
    out, size = [], 0
    for a, n in sorted(per_a):
        if not out or size + n > limit:
            out.append((a, a))
            size = 0
        out[-1] = (out[-1][0], a)
        size += n
    return out


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))


def token_groups(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE,
) -> DataFrame:
    """(id, a_ids, b_ids, groups) of every document; a group is the numbers of A and of B tokens that it takes in turn."""
    source = _source(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    found = source.mapInArrow(
        _groups(a_path, b_path, piece), f"id {kind}, row long, a_ids array<int>, b_ids array<int>, n_a array<int>, n_b array<int>")
    return found.select("id", "a_ids", "b_ids", F.arrays_zip("n_a", "n_b").alias("groups"))


def alignments(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE,
    slice_: int = SLICE,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    spark = docs.sparkSession
    size_a, size_b = sizes(a_path, b_path)
    name, code = ("int", pa.int32()) if size_a * size_b < 1 << 31 else ("long", pa.int64())
    source = _source(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in _NUMBERS)
    scalars = f"id {kind}, row long, {numbers}, groups_sha256 string"
    folder = f"{shared_folder(spark)}/align-{uuid.uuid4().hex}"
    source.mapInArrow(
        _measured(a_path, b_path, piece, code), f"{scalars}, keys array<{name}>, times array<long>"
    ).write.option("compression", "zstd").parquet(f"{folder}/pairs")
    measured = spark.read.parquet(f"{folder}/pairs")
    measured.select("keys").mapInArrow(_partial_counts(code), f"key {name}, docs long").groupBy("key").agg(
        F.sum("docs").alias("docs"), F.floor(F.col("key") / size_b).cast("long").alias("a"),
    ).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    per_a = [(r["a"], r["n"]) for r in counts.groupBy("a").agg(F.count("*").alias("n")).collect()]  # at most A's ids
    parts = []
    for first, last in slices(per_a, slice_) or [(0, -1)]:
        held = counts.where(F.col("a").between(first, last)).select("key", "docs", "a").toArrow().sort_by("key")
        key, docs_, a = (held.column(c).to_numpy() for c in ("key", "docs", "a"))
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        top = np.repeat(np.maximum.reduceat(docs_, starts), np.diff(np.append(starts, len(a)))) if len(a) else docs_
        known = spark.sparkContext.broadcast((key, docs_, docs_ == top))
        parts.append(measured.mapInArrow(_looked_up(known), f"{scalars}, n_best long, count_sum long"))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    if len(parts) > 1:
        every = every.groupBy("id", "row", *_NUMBERS, "groups_sha256").agg(
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return every.select("id", *_NUMBERS, "n_best", "count_sum", "groups_sha256")
