"""Token alignment against a plain version that walks tokens one by one."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import types as T

from quotelake.llm import token_align as m
from quotelake.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(
    T.StructField(c, T.StringType()) for c in ("id", "row", "keys", "times", "n_a", "key"))])


def byte_of(sign):
    """The byte-level alphabet, looked up through the library's decoder."""
    return bytes([byte_of.table[sign]])


shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
byte_of.table = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class Plain:
    def __init__(self):
        self.a, self.b = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True

    def groups(self, text):
        if not text:
            return []
        a = [(t, b"".join(map(byte_of, self.a.id_to_token(t)))) for t in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for t in self.b.encode(text):
            piece = self.b.id_to_piece(t)
            b.append((t, bytes([int(piece[3:5], 16)]) if self.b.is_byte(t) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole:
            return []
        out, left, right, end_a, end_b = [], [], [], 0, 0
        a, b = a[::-1], b[::-1]
        while a or b:
            if end_a <= end_b:
                t, x = a.pop()
                left.append(t)
                end_a += len(x)
            else:
                t, x = b.pop()
                right.append(t)
                end_b += len(x)
            if end_a == end_b:
                out.append((left, right))
                left, right = [], []
        return out

    def rows(self, texts):
        docs = [self.groups(t) for t in texts]
        counts = Counter()
        for groups in docs:
            counts.update({(x, y) for left, right in groups for x in left for y in right})
        top = {}
        for (x, _), n in counts.items():
            top[x] = max(top.get(x, 0), n)
        out = []
        for groups in docs:
            links = [(x, y) for left, right in groups for x in left for y in right]
            text = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in groups)
            out.append((
                sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links),
                hashlib.sha256(text.encode()).hexdigest() if groups else ""))
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def cases():
    rng = random.Random(4)
    alphabet = "aab cdé  ß.,'s1234\n\tжщ漢字かな🙂👩‍🚀́ 　▁<>|0xA"
    texts = [None, "", " ", "  ", "\n", "hello world", "hello world", "hello  world ", "▁already marked", "<|endoftext|> and <s> </s> <unk> <0x41>",
             "naïve café", "it's we'll DON'T", "漢字かな交じり文", "🙂🙂👩‍🚀", "a\x00b\x7f\x85c", "aaaa" * 50, "\r\n\t x", "ﬁne ½ Ⅷ", "​﻿zero",
             "word " * 3000, "tab\t" * 200, " " * 700, "ab" * 400]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]


def got(df, names=NUMBERS):
    return Counter((r["id"], *(r[c] for c in names), r["groups_sha256"]) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"piece": 7}, {"slice_": 40}])
def test_every_case(spark, plain, options):
    texts = cases()
    rows = [(i if i != 5 else None, t, *("clash",) * 6) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9]]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = Counter((r[0], *w) for r, w in zip(rows, plain.rows([r[1] for r in rows])))
    assert got(m.alignments(df, A, B, **options)) == want


def test_groups_of_the_operator(spark, plain):
    texts = cases()[:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in m.token_groups(df, A, B).collect():
        out, x, y = [], 0, 0
        for n_a, n_b in r["groups"]:
            out.append((r["a_ids"][x:x + n_a], r["b_ids"][y:y + n_b]))
            x, y = x + n_a, y + n_b
        assert out == plain.groups(texts[r["id"]]) and (x, y) == (len(r["a_ids"]), len(r["b_ids"]))


def test_empty_table(spark):
    assert m.alignments(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    assert m.alignments(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()[0]["groups_sha256"] == ""


def test_long_texts(plain):
    """A long text is encoded in pieces and gives the whole text's tokens."""
    rng = random.Random(1)
    words = ["alpha", "it's", "zwölf", "漢字", "x1", "--", "Ünder", "\n\nnew", "  two", "'s", "don't", "42"]
    text = " ".join(rng.choice(words) for _ in range(60_000))
    for t in (text, "y" * 300_000, " " * 300_000, "漢" * 100_000):
        found = m.Aligned(m.Pair.of(A, B), [None, t, "end"], piece=1000)
        assert found.a[1].as_py() == plain.a.encode(" " + t, add_special_tokens=False).ids
        assert found.b[1].as_py() == plain.b.encode(t)


def test_links_in_steps(plain):
    pair = m.Pair.of(A, B)
    found = m.Aligned(pair, cases())
    one = found.pairs()
    for limit in (1, 3, 50):
        assert found.pairs(limit).equals(one)
    assert one.num_rows == len(set(zip(one["doc"].to_pylist(), one["key"].to_pylist()))) > 500


def test_encoder_by_rank_equals_the_library(plain):
    pair = m.Pair.of(A, B)
    assert pair.ranked is not None
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(signs), 50_000):
        texts = [f"a{c}1 {c}{c}s" for c in signs[at:at + 50_000]]
        made = plain.a.encode_batch_fast(texts, add_special_tokens=False)
        assert all(pair.ranked.encode_to_numpy(t, disallowed_special=()).tolist() == e.ids for t, e in zip(texts, made))


def test_library_where_ranks_do_not_serve(plain, monkeypatch):
    pair = m.Pair(A, B)
    pair.ranked = None
    texts = [t for t in cases() if t][:100]
    assert m.Aligned(pair, texts).digests() == [r[-1] for r in plain.rows(texts)]


def test_counts_of_one_task_come_in_parts():
    batches = [pa.RecordBatch.from_arrays([pa.array([[1, 2, 3], [2, 3]], pa.list_(pa.int32()))], names=["keys"])] * 4
    total = Counter()
    for limit in (1, 6, 1000):
        total = Counter()
        for b in m._partial_counts(pa.int32(), limit)(iter(batches)):
            for k, n in zip(b.column("key").to_pylist(), b.column("docs").to_pylist()):
                total[k] += n
        assert total == {1: 4, 2: 8, 3: 8}


def test_slices():
    assert m.slices([(3, 2), (1, 5), (9, 9), (10, 1)], 7) == [(1, 3), (9, 9), (10, 10)]
    assert m.slices([], 7) == []


def test_query(spark, plain):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = Counter((i, *w) for (i, _), w in zip(rows, plain.rows([t for _, t in rows])))
    assert got(QUERIES["op11_token_align"](spark, SF).withColumnRenamed("doc_id", "id")) == want
