"""Remarks read column by column stay inside their document's row."""

from quotelake.operators import notes as n

TEXTS = [
    (1, "결제조건\n납기\n선입금 50%\n4주 이내\n합계 1"),
    (2, "결제조건\n납기\n무상보수기간\n선입금 50%\n4주 이내"),
    (3, "결제조건\n선입금 50%"),
    (4, "결제조건: 현금\n납기\n결제조건\n\n선입금 10%\n2주"),
    (5, None),
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_and_values_of_each_document(spark):
    rows = n.label_value_zip(spark.createDataFrame(TEXTS, "quote_id long, text string")).collect()
    assert sorted(map(tuple, rows)) == [
        (1, 2, "결제조건", "선입금 50%"), (1, 3, "납기", "4주 이내"), (2, 3, "납기", "선입금 50%"), (2, 4, "무상보수기간", "4주 이내"),
        (4, 3, "납기", "선입금 10%"), (4, 4, "결제조건", "2주")]


def test_nothing_is_joined_or_moved(spark):
    plan = plan_of(n.label_value_zip(spark.createDataFrame(TEXTS, "quote_id long, text string")))
    assert "Exchange" not in plan and "Join" not in plan


def test_terms_need_no_join(spark):
    terms = n.note_terms(spark.createDataFrame(TEXTS, "quote_id long, text string"))
    assert "Join" not in plan_of(terms) and "Broadcast" not in plan_of(terms)
