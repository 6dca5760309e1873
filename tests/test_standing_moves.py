"""The stored table of scores' inputs moves quotes once, by project."""

from quotelake.plans import ranking_queries as q
from quotelake.sources import marts as m

DATA = "/root/testdata/sf0.001"


def test_quotes_move_once(spark):
    m.quotes(spark, DATA), m.partners(spark, DATA)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = q.build_standing(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    moved = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert not [line for line in moved if "partner_key" in line and "vendor" in line] and "REBALANCE" not in plan
    assert plan.count("SortMergeJoin") == 3  # lowest prices, requests, and nations of the requests
