"""Items are read from their tables once, cell by cell only where a row can tell something."""

import pytest
from pyspark.sql import functions as F

from quotelake.functions.expr import SPACE, SPACES, contains_any, contains_any_case, strip, strip_cell
from quotelake.operators.tables import ROLE_WORDS, SUMMARY_WORDS, amount_only, cell_amount, cell_number, drop_overhead, table_items


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_overhead_is_dropped_in_one_pass(spark):
    rows = [(1, 1, "LED", 100), (1, 2, "관리비", 10), (1, 3, "관리비", 10), (2, 1, "LED", 100), (2, 2, "관리비", 10), (None, 1, "관리비", 5), (None, 2, "LED", 5)]
    items = spark.createDataFrame(rows, "quote_id long, item_no int, item_name string, amount long").withColumn("supply_amount", F.col("amount"))
    totals = spark.createDataFrame([(1, 110), (1, 7), (2, 100), (2, 100), (None, 5)], "quote_id long, supply_amount long")
    left = drop_overhead(items, totals)
    assert sorted((r.quote_id or 0, r.item_no) for r in left.collect()) == [(0, 1), (0, 2), (1, 1), (1, 3), (2, 1)]
    assert plan_of(left).count("LogicalRDD") == 2  # before, the items were made twice


def test_item_gaps_are_filled_from_the_rows_below(spark):
    head = ["No", "품\u3000명", "규격", "수량", "단가", "금 액"]
    rows = [["견적 내용", "", "", "", "", ""], head, ["1", " LED\u2003", "", "x", "", "1,000"], ["", "", " 밝기 ", "3", "12,000 원", ""],
            ["", "55,000", "", "", "", "2,000"], None, ["", "소", "계", "", "", "9,000"], ["2", "설치", None, "1"], ["", None, "야간", "", "7", ""]]
    out = table_items(spark.createDataFrame([(1, rows), (2, [["품명"], ["LED"]]), (3, None)], "quote_id long, rows array<array<string>>"))
    got = [(r.quote_id, r.block_no, r.item_name, r.spec, r.quantity, r.unit, r.unit_price, r.supply_amount, r.amount, r.row_count) for r in out.collect()]
    assert sorted(got) == [(1, 0, "LED", "밝기", 3.0, None, 12000, 1000, 1000, 3), (1, 1, "설치", "야간", 1.0, None, None, None, None, 2)]


def test_cheap_forms_equal_the_plain_ones(spark):
    texts = ["", " ", "a", "\n a b\t\r\n", "\u3000LED\x85", "\x1c1\x1f", "V A T", "Vat", "1,000원", "₩ 1,000", "12\u00a0345", "-", "٣", "vKt", "Q'TY 3", "\\ 5", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    words = SUMMARY_WORDS + [w for words in ROLE_WORDS.values() for w in words]
    plain = F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)[\s₩￦\\,]", "").rlike(r"^\d+$")
    for r in df.select(
        "t", strip(t).alias("s"), strip_cell(t).alias("c"), contains_any(F.lower(t), words).alias("w"), contains_any_case(t, words).alias("x"),
        plain.alias("p"), amount_only(t).alias("a")).collect():
        assert (r.s, r.w, r.p) == (r.c, r.x, r.a), r.t
    assert all(df.select(F.lit(c).rlike(SPACE)).first()[0] for c in SPACES)
    assert not any("k" in w or w.endswith("i") for w in words)


def test_words_of_two_roles_do_not_overlap():
    roles = list(ROLE_WORDS.values())
    for i, own in enumerate(roles):
        for other in roles[:i] + roles[i + 1:]:
            assert not any(a in b or any(a.endswith(b[:n]) for n in range(1, len(b))) for a in own for b in other), (own, other)


@pytest.mark.parametrize("text, amount, number", [("12,345", 12345, 12.0), ("", None, None), (None, None, None), ("99999999999999999999", None, 1e20), ("3.5m", None, 3.5)])
def test_cells_without_a_number_are_not_converted(spark, text, amount, number):
    row = spark.createDataFrame([(text,)], "t string").select(cell_amount(F.col("t")), cell_number(F.col("t"))).first()
    assert tuple(row) == (amount, number)
