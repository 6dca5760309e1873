"""Encoding and decoding against the tokenizer library itself."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

from quotelake.llm.bpe import Codec, bpe_round_trip

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    "", " ", "  ", "\n\n a  b \t c\n", "a \n b", "x  y", "don't  we'll", "<|endoftext|>", "\x1c \x1f", "漢字仮名交じり文" * 60,
    "a" * 5000, "-" * 777, "ab" * 900 + " " * 300, "é" * 41 + "🙂🙂", "12 345", "word " * 40_000, "　  x",
    "qzxjkvwpbfmghdlcuyrnt" * 30, " \n \n", "end ", "á b‍ c",
]


@pytest.fixture(scope="module")
def codec():
    return Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)


def plain(text):
    return b"".join(i.to_bytes(4, "little") for i in LIBRARY.encode_ordinary(text))


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_ids_and_round_trip(codec, text):
    ids = codec.encode([text])
    assert ids == [plain(text)]
    assert codec.decode(ids) == [text.encode()]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["id"]: r for r in bpe_round_trip(docs, PATH, public_tokenizers.PATTERN).collect()}
    for row in docs.collect():
        assert bytes(got[row["doc_id"]]["ids"]) == plain(row["text"])
        assert bytes(got[row["doc_id"]]["decoded"]) == row["text"].encode()
    assert len(got) == docs.count()


def test_nulls_repeats_and_clashing_names(spark):
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("ids", T.StringType()), ("id", T.StringType()))])
    rows = [(None, "one", "x", None), (1, None, "x", None), (2, "", None, "y"), (3, "same", "x", "z"), (3, "same", "x", "z")]
    got = bpe_round_trip(spark.createDataFrame(rows, schema), PATH, public_tokenizers.PATTERN).collect()
    assert sorted(((r["id"], bytes(r["ids"])) for r in got), key=repr) == sorted(
        ((i, plain(t or "")) for i, t, *_ in rows), key=repr)
    empty = spark.createDataFrame([], schema)
    assert bpe_round_trip(empty, PATH, public_tokenizers.PATTERN).collect() == []


def diverse(letters, n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def test_text_of_20_mb(codec):
    words = [diverse("abcdefghij", k % 9 + 1, k) for k in range(500)]
    rng = random.Random(1)
    text = " ".join(rng.choice(words) for _ in range(3_700_000))
    assert len(text) > 20_000_000
    ids = codec.encode([text, "next"])
    assert len(ids[0]) > 4 * 3_000_000 and ids == [plain(text), plain("next")]
    assert codec.decode(ids) == [text.encode(), b"next"]


def test_diverse_run_of_100_000_letters(codec):
    text = diverse("abcdefghijklmnopqrstuvwxyz", 100_000, 2)
    ids = codec.encode([text])
    assert ids == [plain(text)] and codec.decode(ids) == [text.encode()]


def test_few_steps_a_query_change_nothing(codec, monkeypatch):
    words = [diverse("abcdefgh漢字仮名", 3 * k % 97 + 2, -k - 1) for k in range(300)]
    monkeypatch.setattr("quotelake.llm.bpe.ROWS", 1)
    assert codec.encode(words) == [plain(w) for w in words]
