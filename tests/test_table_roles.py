"""Roles are sought in the rows that hold a role word, and a quote's tables are read once."""

from quotelake.operators.tables import ROLE_WORDS, detailed_tables_only, with_header


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_without_role_words_are_passed_over(spark):
    tables = spark.createDataFrame(
        [(1, [["견적", ""], ["N O", "품 명", "수　량"], ["품", "명"], [None, "1"]]), (2, [["품", "명"], []]), (3, None)],
        "quote_id long, rows array<array<string>>")
    out = with_header(tables).orderBy("quote_id")
    assert [(r.header_index, r.role_count, r.roles and (r.roles.row_no, r.roles.item_name, r.roles.quantity, r.roles.unit))
            for r in out.collect()] == [(1, 3, (0, 1, 2, None)), (None, None, None), (None, None, None)]
    alone = "|".join(ROLE_WORDS["quantity"]) + ")"
    assert plan_of(out).count(", " + alone) == 2  # on the row, then on its cells


def test_tables_are_read_once(spark):
    rows = [(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, None), (3, 1, True), (None, 1, True)]
    out = detailed_tables_only(spark.createDataFrame(rows, "quote_id long, table_no int, is_detailed boolean"))
    assert sorted((r.quote_id, r.table_no) for r in out.collect()) == [(1, 1), (2, 1), (2, 2), (3, 1)]
    assert "Join" not in plan_of(out)
