"""Counts against the tokenizer library itself."""

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T

from quotelake.llm.queries import QUERIES
from quotelake.llm.token_count import Counter, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb\t c", "▁", "a▁b ▁ c", "<s> </s> <unk> <0x0A>", "漢字仮名交じり文 " * 20,
    "🙂🙂 é", "x" * 5000, "ab" * 3000, " " * 1000, "word " * 30_000, "\x00\x01", "  　", "ﬁ ½", "don't stop",
]


@pytest.fixture(scope="module")
def own():
    return Counter(open(PATH, "rb").read())


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_odd_texts(own, text):
    assert own.count(text) == len(LIBRARY.encode(text))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op6_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for row in docs:
        n, found = len(LIBRARY.encode(row["text"])), got[row["doc_id"]]
        assert (found["n_bytes"], found["n_tokens"], found["over_limit"]) == (len(row["text"].encode()), n, n > 4096)


def test_nulls_repeats_and_clashing_names(spark):
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("n_bytes", T.StringType()), ("id", T.StringType()))])
    rows = [(None, "one two", "x", None), (1, None, None, None), (2, "", None, "y"), (3, "é", "x", "z"), (3, "é", "x", "z")]
    got = token_counts(spark.createDataFrame(rows, schema), PATH).collect()
    want = [(i, len((t or "").encode()), len(LIBRARY.encode(t or ""))) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts(spark.createDataFrame([], schema), PATH).collect() == []
