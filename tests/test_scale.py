"""The skew-safe routes give the same answers as the plain ones."""

import random

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelake.operators import partner_match as pm
from quotelake.operators.contain import containment_join
from quotelake.operators.scale import falling, hot_keys, position, rank_all, running_before, top_per_group


def _rows(spark, n=3000):
    rng = random.Random(7)
    # one key holds a third of all rows
    data = [(0 if rng.random() < 0.34 else rng.randrange(1, 50), i, round(rng.random() * 20, 1)) for i in range(n)]
    return spark.createDataFrame(data, "k int, id int, score double")


def test_rank_all_hot_key_equals_row_number(spark):
    df = _rows(spark)
    order = [F.col("score").desc(), F.col("id")]
    hot = hot_keys(df, ["k"], 200)
    assert [r.k for r in hot.collect()] == [0]
    place = position(*falling(F.col("score")), F.col("id"))
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy(*order)))
    for ranges in (1, 16, 100_000):
        got = rank_all(df, ["k"], place, order, hot, ranges=ranges)
        assert got.columns == want.columns
        assert got.exceptAll(want).count() == 0 and got.count() == df.count()


def test_rank_all_spreads_equal_scores(spark):
    """All rows of a hot key have one score; some have none, and another key is hot as well."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise((F.col("id") % 2).cast("int") + 1).alias("k"), F.col("id"),
        F.when(F.col("id") % 5 > 0, 7.5).alias("score"), (F.col("id") % 4 == 0).alias("first"))
    order = [F.col("first").desc(), F.col("score").desc(), F.col("id")]
    place = position(*falling(F.col("first"), "int"), *falling(F.col("score")), F.col("id"))
    hot = hot_keys(df, ["k"], 1500)
    assert [tuple(r) for r in hot.collect()] == [(0, 4000)]
    got = rank_all(df, ["k"], place, order, hot, ranges=32)
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy(*order)))
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == 6000
    # the ranges of the hot key are small although its scores are equal
    sampled = df.where("k = 0").where(F.pmod(F.xxhash64(place), F.lit(4000 // 32)) == 0).count()
    assert 10 < sampled < 100


def test_running_before_chunks(spark):
    df = _rows(spark).withColumn("pos", F.row_number().over(W.partitionBy("k").orderBy("id")))
    w = W.partitionBy("k").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    for agg in (F.max, F.sum, F.min):
        got = running_before(df, ["k"], "pos", agg, F.col("score"), "out", chunk=7).select("k", "pos", F.round("out", 6).alias("out"))
        want = df.withColumn("out", F.round(agg("score").over(w), 6)).select("k", "pos", "out")
        assert got.exceptAll(want).count() == 0


def test_containment_join_equals_brute_force(spark):
    texts = ["abcabc", "xyz", "구축 사업 현장", "a", "사업자", "zzabzz"]
    needles = ["ab", "bc", "사업", "z", "abcabc", "없는말", ""]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    n = spark.createDataFrame([(j, x) for j, x in enumerate(needles)], "j int, n string")
    got = {(r.i, r.j) for r in containment_join(t, "t", n, "n").collect()}
    assert got == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(needles) if b and b in a}


def _match_inputs(spark, partners=90, requests=40):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(partners):
        vec = None if i % 11 == 0 else [float(x) for x in rng.normal(size=8)]
        rows.append((f"p{i:03d}", i % 13 == 0, i % 5 == 0, (i % 9) / 10.0, i % 40, 50.0, [float(x) for x in rng.integers(0, 2, 5) * 100.0],
                     [float(x) for x in rng.integers(0, 10, 5)], i % 7 != 0, vec))
    features = spark.createDataFrame(
        rows, "name string, is_excluded boolean, is_premium boolean, success_rate double, installation_count int, "
        "stability_score double, fit array<double>, bonus array<double>, has_solutions boolean, vec array<double>")
    reqs = spark.createDataFrame(
        [(i, [float(x) for x in rng.normal(size=8)], int(rng.integers(0, 32))) for i in range(requests)],
        "project_id long, vec array<double>, mask int")
    return reqs, features


def test_blocked_matching_equals_broadcast(spark, monkeypatch):
    reqs, features = _match_inputs(spark)
    one = {tuple(r) for r in pm.match_partners(reqs, features, 10).collect()}
    monkeypatch.setattr(pm, "BLOCK_ROWS", 25)
    monkeypatch.setattr(pm, "SLICE_ROWS", 15)
    many = {tuple(r) for r in pm.match_partners(reqs, features, 10, broadcast_rows=10).collect()}
    assert len(one) == 400 and one == many


def test_blocked_ranges_equal_broadcast(spark, monkeypatch):
    reqs, features = _match_inputs(spark)
    one = sorted(tuple(r) for r in pm.match_ranges(reqs, features, 10).collect())
    monkeypatch.setattr(pm, "BLOCK_ROWS", 25)
    monkeypatch.setattr(pm, "BROADCAST_ROWS", 10)
    many = sorted(tuple(r) for r in pm.match_ranges(reqs, features, 10).collect())
    assert np.allclose(np.array(one, dtype=float), np.array(many, dtype=float), atol=1e-6)


def test_percentile_bounds_small_sets():
    lo, hi = pm.bounds(np.array([[0.3, 0.1, 0.2]]))
    assert (lo[0], hi[0]) == (0.1, 0.3)
    lo, hi = pm.bounds(np.array([[float(i) for i in range(11)]]))
    assert (lo[0], hi[0]) == (1.0, 9.0)


def test_top_of_a_hot_key_reaches_no_task_whole(spark):
    df = _rows(spark, 6000).repartition(8)
    order = [F.col("score").desc(), F.col("id")]
    got = top_per_group(df, ["k"], order, 3)
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("k").orderBy(*order))).where("rank <= 3")
    assert sorted(map(tuple, got.select("k", "id", "rank").collect())) == sorted(map(tuple, want.select("k", "id", "rank").collect()))
    # both windows have a limit below their shuffle, so the last one sees at most 3 rows of each part of a key
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_scores_carry_no_vectors_through_joins(spark):
    from quotelake.plans.ranking_queries import scored_by_project

    plan = scored_by_project(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem") == 0  # quotes and partners are read from their stored marts
    assert not {"req_vec", "quote_vec"} & set(scored_by_project(spark, "/root/testdata/sf0.001").columns)


def test_named_stream_run_resumes_and_adds_nothing_twice(spark, tmp_path):
    import uuid

    from quotelake.streaming import jobs

    spark.createDataFrame([(1, "one text"), (2, "one text"), (3, " "), (4, "two")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    folder = jobs.work_folder(spark, "intake", f"test-{uuid.uuid4().hex}")
    assert folder == jobs.work_folder(spark, "intake", folder.rsplit("intake-", 1)[1])

    def run():
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in").withColumn(
            "ts", F.timestamp_seconds(F.col("doc_id") + 1700000000))
        good, bad = jobs.stream_intake(stream, folder)
        return sorted(r["text"] for r in good.collect()), [r["reject_reason"] for r in bad.collect()]

    first = run()
    assert first == (["one text", "two"], ["empty_text"])
    assert run() == first


def test_master_without_vectors_and_bad_vectors(spark, monkeypatch):
    reqs, features = _match_inputs(spark)
    none = features.withColumn("vec", F.lit(None).cast("array<double>"))
    assert pm.match_partners(reqs, none, 10).count() == 0
    zero = features.withColumn("vec", F.when(F.col("name") == "p001", F.array_repeat(F.lit(0.0), 8)).otherwise(F.col("vec")))
    gone = features.withColumn("vec", F.when(F.col("name") != "p001", F.col("vec")))
    want = {tuple(r) for r in pm.match_partners(reqs, gone, 10).collect()}
    assert {tuple(r) for r in pm.match_partners(reqs, zero, 10).collect()} == want
    monkeypatch.setattr(pm, "BLOCK_ROWS", 1)  # many blocks hold no vector
    assert {tuple(r) for r in pm.match_partners(reqs, zero, 10, broadcast_rows=10).collect()} == want
    assert pm.match_partners(reqs, none, 10, broadcast_rows=10).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, vec array<double>")
    asked = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, None)], "project_id long, vec_id long")
    failed = {tuple(r) for r in pm.requests_without_vector(asked, vectors).collect()}
    assert failed == {(20, "embedding_unusable"), (30, "embedding_missing"), (40, "embedding_missing")}
