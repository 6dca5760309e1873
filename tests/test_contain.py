"""Containment join against brute force, on odd and on very long texts."""

import random

from quotelake.operators.contain import anchors, containment_join, few_enough


def _random(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcd漢😀 ") for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_equals_brute_force(spark):
    texts = ["abcabc", "xyz", "구축 사업 현장", "a", "사업자", "zzabzz", "", None, "line\nbreak"] + _random(60, 900, 1)
    needles = ["ab", "bc", "사업", "z", "abcabc", "없는말", "", None, "ab", "e\nb", "x" * 300] + _random(200, 9, 2)
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    n = spark.createDataFrame(list(enumerate(needles)), "j int, n string")
    want = sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(needles) if a and b and b in a)
    for options in ({}, {"gram": 1}, {"gram": 6, "long": 50, "size": 3}, {"long": 64, "size": 64}):
        got = sorted((r.i, r.j) for r in containment_join(t, "t", n, "n", keep_text=False, **options).collect())
        assert got == want  # each pair once, although needles repeat in texts and in the list


def test_keys_must_be_equal(spark):
    t = spark.createDataFrame([(1, "p", "one two"), (2, "q", "one two"), (3, None, "one two")], "i int, k string, t string")
    n = spark.createDataFrame([("p", "two"), ("q", "three"), ("q", "one"), (None, "one")], "k string, n string")
    got = {(r.i, r.n, r.t) for r in containment_join(t, "t", n, "n", ["k"]).collect()}
    assert got == {(1, "two", "one two"), (2, "one", "one two")}


def test_empty_sides(spark):
    t = spark.createDataFrame([(1, "text")], "i int, t string")
    n = spark.createDataFrame([], "n string")
    assert containment_join(t, "t", n, "n").collect() == []
    assert containment_join(t.limit(0), "t", spark.createDataFrame([("e",)], "n string"), "n").collect() == []


def test_the_rarest_gram_is_the_anchor(spark):
    n = spark.createDataFrame([("Supplier#01",), ("Supplier#02",), ("Supplier#13",)], "n string")
    got = {r["_needle"]: r["_gram"] for r in anchors(n, "n", []).collect()}
    assert got == {"Supplier#01": "r#01", "Supplier#02": "r#02", "Supplier#13": "r#13"} or len(set(got.values())) == 3


def test_no_job_while_planning_and_a_text_of_20_mb(spark):
    part = "가나다라 마바사 " * 1_000_000
    t = spark.createDataFrame([(1, f"{part}Supplier#000000077{part}Supplier#000000500")], "i int, t string")
    n = spark.range(1000).selectExpr("format_string('Supplier#%09d', id) as n")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    found = containment_join(t, "t", n, "n", keep_text=False)
    assert len(tracker.getJobIdsForGroup()) == before
    assert sorted(r.n for r in found.collect()) == ["Supplier#000000077", "Supplier#000000500"]


def test_few_needles_are_broadcast_and_only_hits_move(spark):
    texts = ["abcabc", "사업자", "", None, "line\nbreak"] + _random(60, 300, 1)
    needles = ["ab", "bc", "사업", "없는말", "", None, "ab", "e\nb"] + _random(100, 9, 2)
    t = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    n = spark.createDataFrame(list(enumerate(needles)), "j int, n string")
    want = sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(needles) if a and b and b in a)
    found = containment_join(t, "t", n, "n", keep_text=False, small=True)
    assert sorted((r.i, r.j) for r in found.collect()) == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 3
    assert few_enough(n, "n") and not few_enough(n, "n", limit=100)
