"""Scores are a narrow pass over one stored table; ranking moves rows once where no key is hot."""

from pyspark.sql import functions as F

from quotelake.operators import compare as c
from quotelake.operators.ranking import rank_quotes
from quotelake.operators.scale import hot_keys, position, rank_all
from quotelake.plans.ranking_queries import scored_by_group, scored_by_project
from quotelake.sources import marts as m

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_move_nothing(spark):
    for scored in (scored_by_project(spark, SMALL), scored_by_group(spark, SMALL)):
        assert "Exchange" not in _plan(scored) and "Join" not in _plan(scored)


def test_ranking_without_hot_keys_moves_rows_once(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    ranked = rank_all(df, ["k"], position(F.col("id")), [F.col("id")], hot_keys(df, ["k"], 50))
    assert _plan(ranked).count("Exchange") == 1


def test_position_of_the_top_makes_rows_once(spark):
    rows = scored_by_project(spark, SMALL).where("quote_id < 100").withColumn("rank", F.lit(1))
    assert _plan(c.relative_position(rows, ["project_id"])).count("FileScan") == 1


def test_selection_reads_the_ranking_once_and_keeps_rows_without_id(spark):
    ranked = rank_quotes(scored_by_project(spark, SMALL), ["project_id"], hot_keys(m.quotes(spark, SMALL), ["project_id"]))
    wanted = spark.createDataFrame([(1, 5)], "project_id long, quote_id long")
    chosen = c.first_per_quote(c.select_rows(ranked, wanted, 10), ["project_id"])
    assert _plan(chosen).count("FileScan") == 1
    rows = spark.createDataFrame([(1, None, 1), (1, None, 2), (1, 7, 4), (1, 7, 3)], "project_id long, quote_id long, input_no long")
    got = [tuple(r) for r in c.first_per_quote(rows, ["project_id"]).collect()]
    assert sorted(got, key=str) == sorted([(1, None, 1), (1, None, 2), (1, 7, 3)], key=str)
