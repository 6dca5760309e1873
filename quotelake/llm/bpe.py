"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

Rank files, one `base64 rank` pair per line, are broadcast (a vocabulary is a fixed file, its size does not grow with
the data). Each task splits texts by the tokenizer's pattern; the distinct words go as token-position rows into a
recursive query that joins the merge table and contracts each word's leftmost minimum-rank pair until nothing joins.
Long words contract in one step every pair of that rank that the one-by-one order would contract in a row (up to the
first whose new neighbour would rank lower), so a run of one character takes a few steps instead of thousands.
A query runs a bounded number of steps and is fed its last rows again until every word is done, so memory follows the
words of a chunk and not their steps. Decoding joins ids with the vocabulary and aggregates the pieces in position order,
a bounded range of positions at a time. Texts are taken in slices of a bounded number of characters and words in bounded
chunks, so memory does not follow the partition.

Defined cases: null text counts as empty and gives no ids; null or repeated ids of documents are passed through row by
row; an empty table gives no rows; special tokens inside a text are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text worked on at a time, words in one recursive query, segments in each of the two generations that a
#: Python worker remembers.
SLICE = 3_000_000
WORDS = 20_000
CACHE = 150_000
#: Token-position rows that the steps of one recursive query may hold, and tokens decoded by one query.
ROWS = 2_000_000
RANGE = 250_000
#: Least memory of the queries in MB, and bytes for each token-position row of a word that needs more.
MEMORY = 300
ROW_BYTES = 800
#: Words above so many bytes contract several pairs in a step.
LONG = 32

_STEP_ONE = """
WITH RECURSIVE parts AS (
  SELECT w, pos, tok, lead(tok) OVER v AS nxt, lead(pos) OVER v AS np, 0 AS n
  FROM start WINDOW v AS (PARTITION BY w ORDER BY pos)
  UNION ALL
  SELECT w, pos, tok, nxt, np, n FROM (
    WITH best AS MATERIALIZED (
      SELECT w, min((t::BIGINT << 32) | pos) AS k, arg_min(np, (t::BIGINT << 32) | pos) AS gone
      FROM parts JOIN merges ON l = tok AND r = nxt WHERE n < {steps} GROUP BY w),
    pick AS MATERIALIZED (SELECT w, (k >> 32)::INT AS t, (k & 4294967295)::INT AS here, gone FROM best),
    after AS MATERIALIZED (SELECT p.w, p.nxt, p.np FROM parts p JOIN pick b ON p.w = b.w AND p.pos = b.gone)
    SELECT p.w, p.pos, CASE WHEN p.pos = b.here THEN b.t ELSE p.tok END AS tok,
      CASE WHEN p.pos = b.here THEN g.nxt WHEN p.np = b.here THEN b.t ELSE p.nxt END AS nxt,
      CASE WHEN p.pos = b.here THEN g.np ELSE p.np END AS np, p.n + 1 AS n
    FROM parts p JOIN pick b ON p.w = b.w JOIN after g ON g.w = b.w WHERE p.pos <> b.gone)
)"""

_STEP_MANY = """
WITH RECURSIVE parts AS (
  SELECT w, pos, tok, lead(tok) OVER v AS nxt, lead(pos) OVER v AS np, lag(tok) OVER v AS prv, 0 AS n
  FROM start WINDOW v AS (PARTITION BY w ORDER BY pos)
  UNION ALL
  SELECT w, pos, tok, nxt, np, prv, n FROM (
    WITH ranked AS MATERIALIZED (
      SELECT w, pos, np, prv, t FROM parts JOIN merges ON l = tok AND r = nxt WHERE n < {steps}),
    best AS MATERIALIZED (SELECT w, min(t) AS t FROM ranked GROUP BY w),
    same AS MATERIALIZED (
      SELECT k.*, coalesce(lag(np) OVER v = pos, false) AS touches, row_number() OVER v AS i
      FROM ranked k JOIN best b ON k.w = b.w AND k.t = b.t WINDOW v AS (PARTITION BY k.w ORDER BY pos)),
    apart AS MATERIALIZED (
      SELECT * FROM (SELECT *, (i - max(CASE WHEN NOT touches THEN i END) OVER (PARTITION BY w ORDER BY pos)) % 2 AS odd
        FROM same) WHERE odd = 0),
    placed AS MATERIALIZED (
      SELECT a.w, a.pos, a.np AS gone, a.t, g.np, g.nxt, CASE WHEN lag(g.np) OVER v = a.pos THEN a.t ELSE a.prv END AS prv
      FROM apart a JOIN parts g ON g.w = a.w AND g.pos = a.np WINDOW v AS (PARTITION BY a.w ORDER BY a.pos)),
    taken AS MATERIALIZED (
      SELECT * FROM (
        SELECT e.*, coalesce(sum(CASE WHEN x.t < e.t OR y.t < e.t THEN 1 ELSE 0 END) OVER (
          PARTITION BY e.w ORDER BY e.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower_before
        FROM placed e LEFT JOIN uneven x ON x.l = e.prv AND x.r = e.t LEFT JOIN uneven y ON y.l = e.t AND y.r = e.nxt)
      WHERE lower_before = 0)
    SELECT p.w, p.pos, coalesce(a.t, p.tok) AS tok,
      CASE WHEN nx.t IS NOT NULL THEN nx.t WHEN a.t IS NOT NULL THEN a.nxt ELSE p.nxt END AS nxt,
      CASE WHEN a.t IS NOT NULL THEN a.np ELSE p.np END AS np,
      CASE WHEN pv.t IS NOT NULL THEN pv.t ELSE p.prv END AS prv, p.n + 1 AS n
    FROM parts p JOIN best b ON p.w = b.w
      LEFT JOIN taken a ON a.w = p.w AND a.pos = p.pos
      LEFT JOIN taken nx ON nx.w = p.w AND nx.pos = coalesce(a.np, p.np)
      LEFT JOIN taken pv ON pv.w = p.w AND pv.np = p.pos
    WHERE NOT EXISTS (SELECT 1 FROM taken d WHERE d.w = p.w AND d.gone = p.pos))
)"""

_LAST = """
SELECT p.w, p.pos, p.tok, p.n FROM parts p JOIN (SELECT w, max(n) AS n FROM parts GROUP BY w) e ON e.w = p.w AND e.n = p.n
ORDER BY p.w, p.pos"""

_DECODE = "SELECT doc, string_agg(piece, '' ORDER BY pos) AS text FROM ids JOIN vocab USING (tok) GROUP BY doc"


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Codec:
    """Merge table, vocabulary and recent segments of one Python worker."""

    def __init__(self, data: bytes, pattern: str) -> None:
        self.ranks = read_ranks(data)
        self.pattern = regex.compile(pattern)
        self.gap = regex.compile(r"\s ")
        self.cuts = regex.compile(r"(?<=\S) ")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        # ids of words and segments, by their text; in the second, without the blank before it
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        parts = [
            (left, right, rank) for token, rank in self.ranks.items() for i in range(1, len(token))
            if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None
        ]
        table = pa.table(dict(zip("lrt", np.array(parts, dtype=np.int32).reshape(-1, 3).T, strict=True)))
        pieces = pa.table({
            "tok": pa.array(list(self.ranks.values()), pa.int32()),
            "piece": pa.array([token.decode("latin-1") for token in self.ranks]),  # one character a byte
        })
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        self.con.register("table_in", table)
        self.con.execute("CREATE TABLE merges AS FROM table_in")
        self.con.execute("CREATE TABLE uneven AS FROM merges WHERE t < l OR t < r")
        self.con.register("pieces_in", pieces)
        self.con.execute("CREATE TABLE vocab AS FROM pieces_in")

    def _contract(self, words: list[bytes], step: str) -> list[bytes]:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        tok, out = self.byte[flat], [b""] * len(words)
        need = len(flat) * ROW_BYTES // 1_000_000
        if need > MEMORY:
            self.con.execute(f"SET memory_limit = '{need}MB'")
        while len(w):
            steps = max(1, ROWS // len(w))
            self.con.register("start", pa.table({"w": w, "pos": pos, "tok": tok}))
            found = self.con.execute(step.format(steps=steps) + _LAST).fetchnumpy()
            w, pos, tok = (np.asarray(found[c], dtype=np.int32) for c in ("w", "pos", "tok"))
            open_ = np.asarray(found["n"]) == steps  # these may go on, the others joined nothing more
            done, data = w[~open_], tok[~open_].astype("<u4").tobytes()
            starts = np.flatnonzero(np.diff(done, prepend=-1))
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(done)], strict=True) if len(done) else ():
                out[done[at]] = data[4 * at:4 * end]
            w, pos, tok = w[open_], pos[open_], tok[open_]
        if need > MEMORY:
            self.con.unregister("start")
            self.con.execute(f"SET memory_limit = '{MEMORY}MB'")
        return out

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: whole vocabulary entries at once, the others by the recursive queries."""
        groups: dict[bool, list[tuple[str, bytes]]] = {False: [], True: []}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                self._keep(word, rank.to_bytes(4, "little"))
            else:
                groups[len(raw) > LONG].append((word, raw))
        for long, group in groups.items():
            chunk: list[tuple[str, bytes]] = []
            size = 0
            for at, (word, raw) in enumerate(group):
                chunk.append((word, raw))
                size += len(raw) if long else 8
                if size >= WORDS * 8 or at == len(group) - 1:
                    found = self._contract([r for _, r in chunk], _STEP_MANY if long else _STEP_ONE)
                    for (w, _), ids in zip(chunk, found, strict=True):
                        self._keep(w, ids)
                    chunk, size = [], 0

    def _keep(self, word: str, ids: bytes) -> None:
        if word[0] == " ":
            self.spaced[word[1:]] = ids
        else:
            self.plain[word] = ids

    def _missing(self, texts: set[str], now: dict[str, bytes], older: dict[str, bytes]) -> list[str]:
        """What has to be split anew; entries of the older generation move to this one."""
        out = []
        for s in texts.difference(now):
            ids = older.get(s)
            if ids is None:
                out.append(s)
            else:
                now[s] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A blank after a visible character starts a new token, so the text may be cut there and a segment met before
        need not be split by the pattern again. The pattern leaves a word that it has found whole.
        """
        if len(self.plain) + len(self.spaced) > CACHE:
            self.older, self.plain, self.spaced = (self.plain, self.spaced), {}, {}
        cut = [self.cuts.split(t) if self.gap.search(t) else t.split(" ") for t in texts]
        cut = [["", s[0][1:], *s[1:]] if s[0].startswith(" ") else s for s in cut]
        first = self._missing({s[0] for s in cut}, self.plain, self.older[0])
        later = self._missing({s for segments in cut for s in segments[1:]}, self.spaced, self.older[1])
        whole = [f" {s}" for s in later if s.isalpha()]
        several = []
        for s in [*first, *(f" {s}" for s in later if not s.isalpha())]:
            words = self.pattern.findall(s)
            if len(words) == 1:
                whole.append(s)
            elif words:
                several.append((s, words))
            else:
                self.plain[s] = b""
        plain, spaced = set(), set()
        for w in {w for _, words in several for w in words}:
            (spaced if w[0] == " " else plain).add(w[1:] if w[0] == " " else w)
        new = {*whole, *self._missing(plain, self.plain, self.older[0])}
        new.update(f" {s}" for s in self._missing(spaced, self.spaced, self.older[1]))
        self._learn(list(new))
        for s, words in several:
            self._keep(s, b"".join([self.spaced[w[1:]] if w[0] == " " else self.plain[w] for w in words]))
        return [b"".join([self.plain[s[0]], *[self.spaced[x] for x in s[1:]]]) for s in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence."""
        sizes = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
        flat, doc = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32), np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        out: list[list[bytes]] = [[] for _ in ids]
        for at in range(0, len(flat), RANGE):
            own = flat[at:at + RANGE]
            self.con.register("ids", pa.table({"doc": doc[at:at + RANGE], "pos": np.arange(at, at + len(own)), "tok": own}))
            for i, text in self.con.execute(_DECODE).fetchall():
                out[i].append(text.encode("latin-1"))
        return [b"".join(pieces) for pieces in out]


_codecs: dict[tuple, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """The worker's codec for these ranks; one is kept."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def _slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or of one row."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1])
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if len(column) > start:
        yield start, len(column)


def bpe_round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids binary, decoded binary): little-endian 32-bit ids of every text and the bytes they decode to."""
    with open(ranks_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            text = batch.column(1)
            for a, b in _slices(text, SLICE):
                ids = own.encode(text.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(own.decode(ids), pa.binary())],
                    names=["id", "ids", "decoded"],
                )

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    return rows.mapInArrow(run, "id long, ids binary, decoded binary")
