"""Splitting one document that quotes several options into one quote per option."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelake.functions.expr import contains_any, group1
from quotelake.functions.money import AMOUNT_PATTERN
from quotelake.operators.extract import lines_of
from quotelake.sources.intake import option_quote_id

# Tolerances and marks of the split.
TOLERANCE = 10000
MAX_RESIDUAL_SHARE = 0.30
WALL_WORDS = ["비디오월", "video wall"]
LED_DISPLAY_WORDS = ["led display", "led전광판", "led 전광판"]
PLAYER_WORDS = ["vx400pro", "all-in-one", "all in one", "controller", "player", "플레이어", "컨트롤러"]
CABINET_TIMES = r"(?i)(?:함체\s*수량|cabinet\s*quantity)[^\d]*(\d{1,3})\s*(?:x|×|\*)\s*(\d{1,3})(?:\s*=\s*(\d{1,3}))?"
CABINET_THREE = r"(?:함체\s*수량|cabinet\s*quantity)[^\d]*(\d{1,3})\s+(\d{1,3})\s+(\d{1,3})"
MSG_SPLIT_FAILED = "복수 옵션 자동 분리 실패, 수동 확인 필요"
RESIDUAL_NAME = "미파싱 옵션 잔액"
METHOD_SUM, METHOD_BOUNDARY = "sequential_line_item_sum", "product_group_boundary"
METHOD_SECTION = "product_group_boundary_section_reconstructed"
#: Column heads of a recognised table, and those together with measures: never the name of an item.
TABLE_HEADS = ["비고", "견적금액", "견적단가", "수량", "상세내역", "품목", "번호"]
NO_NAME = ["너비", "길이", *TABLE_HEADS]
METHOD_RESIDUAL = "product_group_boundary_with_unparsed_residual"


def correct_lines(lines: DataFrame) -> DataFrame:
    """Fix a cabinet total entered as unit price and a row number entered as quantity.

    A narrow job. Keeps the old figures in ``before`` and the reason in ``correction``.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("spec_raw", F.lit(""))))
    explicit = group1(text, CABINET_TIMES, 3).cast("int")
    times = group1(text, CABINET_TIMES, 1).cast("int") * group1(text, CABINET_TIMES, 2).cast("int")
    cabinets = F.coalesce(explicit, times, group1(text, CABINET_THREE, 3).cast("int"))
    total_as_unit = (
        contains_any(text, LED_DISPLAY_WORDS)
        & F.coalesce(F.col("quantity") == 1, F.lit(True))
        & (F.col("total_price") == F.col("unit_price"))
    )
    by_cabinet = F.coalesce(total_as_unit & (cabinets > 0) & (F.col("total_price") % cabinets == 0), F.lit(False))
    expected = (F.col("unit_price") * F.col("quantity")).cast("bigint")
    row_number = F.coalesce(
        contains_any(text, PLAYER_WORDS) & F.col("quantity").isin(2.0, 3.0, 4.0) & F.col("unit_price").isNotNull()
        & F.col("total_price").isNotNull()
        & ((F.abs(F.col("total_price") - expected) <= 10000) | (F.col("total_price") != F.col("unit_price"))),
        F.lit(False),
    )
    reason = F.when(row_number, "row number was likely used as quantity").when(
        by_cabinet, F.concat(F.lit("LED cabinet quantity correction: quantity="), cabinets.cast("string"))
    )
    return (
        lines.withColumn("before", F.struct("quantity", "unit_price", "total_price"))
        .withColumn("_cab", F.when(by_cabinet, cabinets))
        .withColumn("correction", reason)
        .withColumn("_row", row_number)
        .withColumn("quantity", F.when(F.col("_row"), 1.0).when(F.col("_cab").isNotNull(), F.col("_cab").cast("double")).otherwise(F.col("before.quantity")))
        .withColumn(
            "unit_price",
            F.when(F.col("_cab").isNotNull() & ~F.col("_row"), (F.col("before.total_price") / F.col("_cab")).cast("bigint")).otherwise(F.col("before.unit_price")),
        )
        .withColumn("total_price", F.when(F.col("_row"), F.col("before.unit_price")).otherwise(F.col("before.total_price")))
        .drop("_cab", "_row")
    )


def fold_options(amounts: Column, targets: Column, tolerance: int = TOLERANCE) -> Column:
    """Close option after option as the running sum reaches its target.

    Returns struct(cuts, lines): after how many lines each option closes, and how many lines there are. Sums restart
    for every option, so a plain prefix sum is not enough; only the cuts are kept, so the fold is linear in the lines.
    ``amounts`` are the lines of one document in order.
    """
    start = F.struct(
        F.lit(1).alias("option"), F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("lines"), F.array().cast("array<int>").alias("cuts"))
    n = F.size(targets)

    def step(acc: Column, amount: Column) -> Column:
        total = acc["sum"] + F.coalesce(amount, F.lit(0))
        hit = (acc["option"] <= n) & (F.abs(total - F.get(targets, acc["option"] - 1)) <= tolerance)
        hit = F.coalesce(hit, F.lit(False))
        return F.struct(
            F.when(hit, acc["option"] + 1).otherwise(acc["option"]).alias("option"),
            F.when(hit, F.lit(0).cast("bigint")).otherwise(total).alias("sum"),
            (acc["lines"] + 1).alias("lines"),
            F.when(hit, F.array_append(acc["cuts"], acc["lines"] + 1)).otherwise(acc["cuts"]).alias("cuts"),
        )

    return F.aggregate(amounts, start, step)


def option_of_line(cuts: Column, lines: Column) -> Column:
    """Option number of every line: runs that end at the cuts, and one more for the lines behind the last."""
    ends = F.concat(cuts, F.array(lines))
    run = lambda end, i: F.array_repeat(i + 1, end - F.coalesce(F.get(ends, i - 1), F.lit(0)))
    return F.flatten(F.transform(ends, run))


def split_options(docs: DataFrame) -> DataFrame:
    """Assign an option to every line of every document.

    Expects quote_id, items (array of name, spec_raw, amount structs in order) and
    ``targets`` (supply price per option). Adds split_method, option_numbers (per line,
    NULL when the split failed), residuals per option and split_failed_reason.
    """
    amounts = F.transform("items", lambda r: r["amount"])
    folded = docs.withColumn("_fold", fold_options(amounts, F.col("targets")))
    n = F.size("targets")
    # every option closed, by its own lines, and no line left over
    by_sum = (n >= 2) & (F.size("_fold.cuts") == n) & (F.element_at("_fold.cuts", -1) == F.col("_fold.lines"))
    text = lambda r: F.lower(F.concat_ws(" ", F.coalesce(r["name"], F.lit("")), F.coalesce(r["spec_raw"], F.lit(""))))
    later = F.filter(F.transform("items", lambda r, i: F.when((i > 0) & contains_any(text(r), WALL_WORDS), i)), lambda i: i.isNotNull())
    staged = folded.withColumn("_by_sum", F.coalesce(by_sum, F.lit(False))).withColumn("_cut", F.get(later, F.lit(0)))
    part = lambda lo, hi: F.aggregate(
        F.transform(F.slice("items", lo, hi), lambda r: r["amount"]), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))
    )
    gap = lambda no, total: F.get("targets", F.lit(no)) - total
    cut = F.coalesce("_cut", F.lit(0))
    gaps = F.array(gap(0, part(F.lit(1), cut)), gap(1, part(cut + 1, F.size("items"))))
    staged = staged.withColumn("_gaps", F.when((n == 2) & F.col("_cut").isNotNull(), gaps))
    fine = lambda g, i: (F.abs(g) <= TOLERANCE) | (
        (g > 0) & (g <= (F.get("targets", i) * MAX_RESIDUAL_SHARE).cast("bigint"))
    )
    staged = staged.withColumn(
        "_boundary", F.coalesce(F.col("_gaps").isNotNull() & F.forall(F.transform("_gaps", fine), lambda ok: ok), F.lit(False))
    )
    residuals = F.transform("_gaps", lambda g: F.when(F.abs(g) > TOLERANCE, g))
    any_residual = F.exists(residuals, lambda g: g.isNotNull())
    numbers = F.transform("items", lambda r, i: F.when(i < F.col("_cut"), 1).otherwise(2))
    return (
        staged.withColumn(
            "split_method",
            F.when(F.col("_by_sum"), METHOD_SUM).when(F.col("_boundary") & any_residual, METHOD_RESIDUAL)
            .when(F.col("_boundary"), METHOD_BOUNDARY),
        )
        .withColumn("option_numbers", F.when(F.col("_by_sum"), option_of_line(F.col("_fold.cuts"), F.col("_fold.lines"))).when(F.col("_boundary"), numbers))
        .withColumn("residuals", F.when(~F.col("_by_sum") & F.col("_boundary"), residuals))
        .withColumn("split_confidence", F.when(F.col("_by_sum"), "high").when(F.col("_boundary"), "medium"))
        .withColumn(
            "split_failed_reason",
            F.when(
                (n >= 2) & F.col("split_method").isNull(), "line_items cumulative sum did not match option total candidates"
            ),
        )
        .withColumn("check_required", F.when(F.col("split_failed_reason").isNotNull(), MSG_SPLIT_FAILED))
        .drop("_fold", "_by_sum", "_cut", "_gaps", "_boundary")
    )


def option_children(split: DataFrame) -> DataFrame:
    """One row per option of every split document with its line count, sum and residual."""
    ok = split.where(F.col("split_method").isNotNull())
    options = ok.withColumn("option_no", F.explode(F.sequence(F.lit(1), F.size("targets"))))
    mine = F.filter("items", lambda r, i: F.get("option_numbers", i) == F.col("option_no"))
    return (
        options.withColumn("_mine", mine)
        .withColumn("line_count", F.size("_mine"))
        .withColumn("line_sum", F.aggregate("_mine", F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(r["amount"], F.lit(0))))
        .withColumn("supply_price", F.get("targets", F.col("option_no") - 1))
        .withColumn("residual", F.get("residuals", F.col("option_no") - 1))
        .withColumn("label", option_label(F.col("_mine")))
        .withColumn("parent_quote_id", F.col("quote_id").cast("string"))
        .withColumn("quote_id", option_quote_id(F.col("parent_quote_id"), F.col("option_no"), F.col("label")))
        .drop("_mine", "items", "targets", "option_numbers", "residuals")
    )


def option_label(items: Column) -> Column:
    """Product named by an option's lines."""
    text = F.lower(F.array_join(F.transform(items, lambda r: F.concat_ws(" ", r["name"], r["spec_raw"])), " "))
    return F.when(contains_any(text, ["led", "전광판"]), "LED전광판").when(contains_any(text, WALL_WORDS), "비디오월")


def option_sum_check(lines: DataFrame, totals: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Long-table check of line sums against option totals: lines reduced map-side, then joined."""
    sums = lines.groupBy("quote_id", "option_no").agg(F.sum("amount").alias("line_sum"))
    diff = F.col("supply_price") - F.coalesce("line_sum", F.lit(0))
    return totals.join(sums, ["quote_id", "option_no"], "left").withColumn("difference", diff).withColumn(
        "status",
        F.when(F.abs(diff) <= tolerance, "match")
        .when((diff > 0) & (diff <= (F.col("supply_price") * MAX_RESIDUAL_SHARE).cast("bigint")), "residual")
        .otherwise("mismatch"),
    )


def _amount(text: Column) -> Column:
    return F.replace(group1(F.replace(text, F.lit(" "), F.lit("")), rf"^(?:{AMOUNT_PATTERN}|(\d{{4}}))$"), F.lit(","), F.lit("")).try_cast("bigint")


def section_triples(docs: DataFrame) -> DataFrame:
    """(quantity, unit price, supply) line triples that multiply out, with the descriptive line before them.

    Expects quote_id and text; one output row per triple. Repeated (name, supply) pairs keep the first. One pass over
    the lines of a document: the descriptive line is carried forward, the two amounts are looked up ahead.
    """
    lines = F.filter(F.transform(lines_of(F.col("text")), lambda s: F.trim(F.regexp_replace(s, r"[\s|]+", " "))), lambda s: s != "")
    every = docs.select("quote_id", F.posexplode(lines).alias("i", "line")).withColumn("amount", _amount(F.col("line")))
    plain = F.col("line").rlike(r"^\d+(?:\.\d+)?$")
    tight = F.lower(F.replace("line", F.lit(" "), F.lit("")))
    names = ~plain & F.col("amount").isNull() & ~tight.isin(NO_NAME)
    order = Window.partitionBy("quote_id").orderBy("i")
    carried = every.select(
        "quote_id", "i", F.when(plain, F.col("line").cast("double")).alias("quantity"),
        F.lead("amount", 1).over(order).alias("unit_price"), F.lead("amount", 2).over(order).alias("supply_amount"),
        F.last(F.when(names, F.col("line")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("item_name"))
    ok = (F.col("quantity") * F.col("unit_price")).cast("bigint") == F.col("supply_amount")
    first = F.min(F.struct("i", "quantity", "unit_price")).alias("t")
    return carried.where(ok & F.col("item_name").isNotNull()).groupBy("quote_id", "item_name", "supply_amount").agg(first).select(
        "quote_id", "item_name", "supply_amount", "t.quantity", "t.unit_price", F.col("t.i").alias("line_no"))
