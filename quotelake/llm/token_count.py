"""Token counts by byte-pair merging with a heap and a linked list.

The pieces and scores of a SentencePiece BPE model with byte fallback are broadcast (a fixed vocabulary file). Each
word's characters form a linked list; the heap gives the best-scored adjacent pair, leftmost first, until none is a
piece. The count is the number of initial symbols minus the merges, where a character outside the vocabulary counts
its UTF-8 bytes; no identifiers are made. No piece runs on into a following blank, so words are counted apart and a
bounded number of words is remembered.

Defined cases: null or empty text has 0 bytes and 0 tokens; repeated rows and null ids are passed through row by row;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Words whose count a Python worker remembers.
CACHE = 500_000


class Counter:
    def __init__(self, model: bytes) -> None:
        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(reader.get_piece_size())
        if not any(reader.is_byte(i) for i in ids) or any(reader.is_unused(i) for i in ids):
            raise ValueError("a model with byte fallback and without unused pieces is needed")
        # Lower is better; special and byte pieces never come from text.
        self.order = {
            reader.id_to_piece(i): -reader.get_score(i) for i in ids
            if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i))
        }
        if any(re.search(f"[^{BLANK}]{BLANK}", piece) for piece in self.order):
            raise ValueError("a piece runs on into the next word")
        self.parts = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.known: dict[str, int] = {}

    def merge(self, word: str) -> int:
        """Tokens of one word that already carries its blank."""
        order, symbols = self.order, list(word)
        count = n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (rank, i, 2) for i in range(n - 1) if (rank := order.get(symbols[i] + symbols[i + 1])) is not None
        ]
        heapify(heap)
        while heap:
            _, left, size = heappop(heap)
            right = after[left]
            if not symbols[left] or right >= n or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one of the two has grown or gone since
            symbols[left] += symbols[right]
            symbols[right] = ""
            count -= 1
            after[left] = follow = after[right]
            if follow < n:
                before[follow] = left
                if (rank := order.get(symbols[left] + symbols[follow])) is not None:
                    heappush(heap, (rank, left, size + len(symbols[follow])))
            ahead = before[left]
            if ahead >= 0 and (rank := order.get(symbols[ahead] + symbols[left])) is not None:
                heappush(heap, (rank, ahead, len(symbols[ahead]) + size))
        return count + sum(len(s.encode("utf-8", "surrogatepass")) - 1 for s in symbols if len(s) == 1 and s not in order)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or text[0] == " " or BLANK in text:
            words = self.parts.findall(BLANK + text.replace(" ", BLANK))
        else:
            words = [BLANK + w for w in text.split(" ")]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self.merge(word)
        return sum(map(known.__getitem__, words))


_counters: dict[bytes, Counter] = {}


def counter(model: bytes) -> Counter:
    key = hashlib.sha256(model).digest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(model)
    return _counters[key]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text."""
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shared.value)
        for batch in batches:
            counts = np.fromiter((own.count(t.as_py()) for t in batch.column(2)), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts)], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
