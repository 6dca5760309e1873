"""Contamination against a plain word-by-word search, and the registered query against its SQL."""

import random
import re

import duckdb
from pyspark.sql import types as T

from quotelake.llm.decontam import contamination, drop_contaminated
from quotelake.llm.queries import OP9_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("items", T.StringType())])
ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType())])


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i:i + 13]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, own = plain_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    own |= windows[tuple(w[i:i + n])]
        names = sorted(str(x) for x in own if x is not None)
        out.append((doc, len(w), len(hit), names, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(3)
    pool = ["the", "of", "a", "Naïve", "été", "x1", "zebra", "ab", "abc", "漢字"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 12, 13, 14, 30]))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "?!"), (53, items[3][1]), (None, text(14)), items[4], (54, "Zebra"), (55, "word " * 60)]
    docs = [(i, text(rng.choice([0, 1, 4, 13, 50, 400]))) for i in range(40)]
    docs += [(100 + i, f"{text(6)}, {t}. {text(300)}") for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "word " * 30_000), (None, items[7][1].upper()), docs[3], docs[3]]
    return docs, items


def got(df):
    return sorted(((r["id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in df.collect()), key=repr)


def test_every_kind_of_item(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*x, "clash") for x in docs], DOC)
    b = spark.createDataFrame([(*x, "clash") for x in items], ITEM)
    want = plain(docs, items)
    found = contamination(d, b)
    assert got(found) == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in found.collect())
    assert got(contamination(d, b, block_bytes=60)) == want  # several blocks of the query set
    clean = drop_contaminated(d, b)
    assert clean.columns == d.columns
    assert sorted((str(r["doc_id"]) for r in clean.collect())) == sorted(str(r[0]) for r in want if not r[4])


def test_long_windows_only(spark):
    docs, items = cases()
    items = [(i, t) for i, t in items if len(plain_words(t)) >= 13]
    d, b = spark.createDataFrame([(*x, "") for x in docs], DOC), spark.createDataFrame([(*x, "") for x in items], ITEM)
    assert got(contamination(d, b)) == plain(docs, items)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    one = spark.createDataFrame([(1, "a b c", "")], DOC)
    assert contamination(d, b).collect() == [] and drop_contaminated(d, b).collect() == []
    assert got(contamination(one, b)) == [(1, 3, 0, [], False)] and drop_contaminated(one, b).count() == 1


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    res = con.execute(OP9_SQL)
    names = [c[0] for c in res.description]
    want = sorted(res.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in QUERIES["op9_decontaminate"](spark, SF).collect()) == want
    assert any(r[names.index("contaminated")] for r in want)
