"""The overhead row that breaks a quote's sum, found in one pass over the items."""

from quotelake.operators.tables import drop_overhead, overhead_log


def test_first_fitting_overhead_row_goes(spark):
    items = spark.createDataFrame([
        (1, 1, "LED", 100, None), (1, 2, "관리비", 10, None), (1, 3, "관리비", 10, None), (2, 1, "LED", 100, None), (2, 2, "관리비", 10, None),
        (3, 1, "LED", 100, None), (3, 2, "관리비", None, 5), (4, 1, "LED", 100, None), (5, 1, "관리비", 7, None)],
        "quote_id long, item_no int, item_name string, amount long, supply_amount long")
    totals = spark.createDataFrame([(1, 110), (2, 110), (3, 100), (3, 100), (4, 0), (5, 0)], "quote_id long, supply_amount long")
    left = drop_overhead(items, totals)
    assert sorted((r.quote_id, r.item_no) for r in left.collect()) == [(1, 1), (1, 3), (2, 1), (2, 2), (3, 1), (4, 1), (5, 1)]
    assert [(r.quote_id, r.item_no, r.amount) for r in overhead_log(items, totals).orderBy("quote_id").collect()] == [(1, 2, 10), (3, 2, 5)]
    plan = overhead_log(items, totals)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # the items once, the totals once
