"""The pipeline's rows against a plain version of its stages, and stages on odd tables."""

import base64
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

import corpus_pipeline
from quotelake.llm.quality import fit

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def contaminated(text, windows):
    w, hit = words(text), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit |= set(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def shingles(text):
    """Five words each, of the lower-cased text; a shorter text is one shingle, one without words has none."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(docs):
    """The smallest id of every group that pairs with a Jaccard similarity of 0.8 or more connect."""
    sets, label = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [d for i, d in enumerate(docs) if label[i] == i]


def test_rows_of_a_plain_version(spark):
    table = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    docs = sorted((r["doc_id"], r["text"]) for r in table["documents"].collect())
    voters = fit(table["documents"], table["labels"])
    good = [d for d, s in zip(docs, voters.score([t for _, t in docs]), strict=True) if s >= 0.5]
    alone = one_of_each(good)
    windows = set()
    for r in table["benchmark"].collect():
        w = words(r["text"] or "")
        windows |= {tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12) if w else 0)}
    clean = [(i, t) for i, t in alone if not contaminated(t, windows)]
    assert len(docs) > len(good) > len(alone) > len(clean) > 100
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {i for i, _ in clean}
    for i, t in clean:
        ids = LIBRARY.encode_ordinary(t)
        assert got[i]["n_tokens"] == len(ids) and bytes(got[i]["ids"]) == np.array(ids, dtype="<u4").tobytes()
        assert got[i]["text"] == t


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", "s", 0), (2, None, None, None, None), (2, None, None, None, None)]])
def test_stages_on_odd_tables(spark, rows, tmp_path):
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
    docs = spark.createDataFrame(rows, schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == [f.name for f in schema.fields]
    assert docs.count() == min(1, len(rows))
