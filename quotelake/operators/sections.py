"""Options of a document rebuilt from its subtotalled sections.

Where the lines read from a document do not add up to its options, its text may still list each option as a section
that ends in a subtotal. Lines are read in order with what was seen before them: the last subtotal, the fourth column
head back, the last line that can name an item, the last display. A section runs from the last of these marks to the
subtotal that states an option's amount; in it, a quantity followed by two amounts that multiply out is an item. An
option counts if its items add up to the subtotal, a document if all its options do. All state is carried by windows
over one document's lines, so the work is linear in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelake.functions.expr import contains_any, contains_any_case
from quotelake.operators.extract import lines_of
from quotelake.operators.split import METHOD_SECTION, NO_NAME, TABLE_HEADS, TOLERANCE

# Marks of sections and of item names.
SUBTOTALS = ["소계", "소계:"]
SUM_WORDS = ["소계", "합계"]
DISPLAY_WORDS = ["led display", "전광판", "display", "비디오월", "video wall"]
NO_MODEL_WORDS = ["설치", "브라켓", "출장", "체류비", "display", "비디오월"]
#: Whitespace other than single blanks.
UNEVEN = r"(?U)[\s&&[^ ]]|  "
PARENT_LINES = 23
HEADS_BACK = 4


def line_amount(line: Column) -> Column:
    """Whole amount of a line that holds nothing else."""
    tight = F.regexp_replace(line, r"[₩￦\\ ]", "")
    return F.when(tight.rlike(r"^(?:\d{1,3}(?:,\d{3})+|\d{4,})$"), F.replace(tight, F.lit(","), F.lit("")).try_cast("bigint"))


def _item_name(order) -> Column:
    """A line as the name of an item."""
    line, following = F.col("line"), F.lead("line", 1).over(order)
    spare = F.coalesce(F.concat_ws("\n", *[F.lag("line", k).over(order) for k in range(1, 5)]).contains("예비품"), F.lit(False))
    return (
        F.when((line == "LED 모듈") & spare, "LED 모듈 예비품")
        .when(line.contains("LED Display"), "LED Display")
        .when(contains_any(line, ["출장", "체류비"]), F.trim(F.replace(line, F.lit("(개당)"), F.lit(""))))
        .when((line == "All-in-one") & following.isNotNull() & ~following.rlike(r"^\d+(?:\.\d+)?$"), F.concat_ws(" ", line, following))
        .otherwise(line)
    )


def read_lines(docs: DataFrame) -> DataFrame:
    """Every line of every document with what the section rules need of the lines around it."""
    trimmed = lambda s: F.btrim(F.when(s.rlike(UNEVEN), F.regexp_replace(s, r"(?U)\s+", " ")).otherwise(s), F.lit(" |"))
    lines = F.filter(F.transform(lines_of(F.col("text")), trimmed), lambda s: s != "")
    base = docs.select("quote_id", F.posexplode(lines).alias("pos", "line"))
    line, tight = F.col("line"), F.replace("line", F.lit(" "), F.lit(""))  # the words sought in it have no capitals
    plain = line.rlike(r"^\d+(?:\.\d+)?$")
    model = line.rlike(r"[A-Z]{2,}\d") & (F.size(F.split(line, " ")) <= 2) & ~contains_any_case(line, NO_MODEL_WORDS)
    every = base.select(
        "*", tight.alias("tight"), F.when(plain, line.cast("double")).alias("quantity"), line_amount(line).alias("amount"),
        tight.isin(TABLE_HEADS).alias("is_head"), contains_any(tight, SUM_WORDS).alias("is_sum"),
        contains_any_case(line, DISPLAY_WORDS).alias("is_display"), (line.contains("수량") | model).alias("is_detail"),
        (~plain & line_amount(line).isNull() & ~tight.isin(NO_NAME) & ~(tight.contains("전체") & tight.contains("수량"))).alias("is_name"))
    order = Window.partitionBy("quote_id").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda condition, value: F.last(F.when(condition, value), ignorenulls=True).over(before)
    told = every.withColumn("shown", _item_name(order))
    told = told.withColumn("display", last(F.col("is_display"), F.struct("pos", "shown")))
    return told.select(
        "*", last(F.col("is_name"), F.struct("pos", "shown", "is_detail", "display")).alias("named"),
        (last(F.col("is_sum"), F.col("pos")) + 1).alias("after_sum"), F.count_if("is_head").over(before).alias("heads_before"),
        F.lead("amount", 1).over(order).alias("next_amount"), F.lead("amount", 2).over(order).alias("second_amount"),
        F.lead("amount", 3).over(order).alias("third_amount"))


def split_sections(docs: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Items of the documents all of whose options are rebuilt from sections.

    Expects quote_id, text and ``targets`` (supply price per option); documents with fewer than two options, null
    targets or no text give no rows. Of equal items of an option the first stays.
    Columns: quote_id, option_no, line_no, item_name, quantity, unit_price, supply_amount, option_sum, split_method.
    """
    lines = read_lines(docs.where(F.size("targets") >= 2))
    stated = F.coalesce("next_amount", "second_amount", "third_amount")
    product = (F.col("quantity") * F.col("next_amount")).cast("bigint")
    subtotal, triple = F.col("tight").isin(SUBTOTALS), F.coalesce(product == F.col("second_amount"), F.lit(False))
    # lines are read once: of a document's lines, subtotals, items and heads stay, as values of one row
    marks = lines.where(subtotal | triple | F.col("is_head")).groupBy("quote_id").agg(
        F.collect_list(F.when(subtotal, F.struct(F.col("pos").alias("stop"), "after_sum", "heads_before", stated.alias("target")))).alias("subtotals"),
        F.collect_list(F.when(triple, F.struct(
            "pos", "quantity", F.col("next_amount").alias("unit_price"), F.col("second_amount").alias("supply_amount"), "named"))).alias("triples"),
        F.sort_array(F.collect_list(F.when(F.col("is_head"), F.col("pos")))).alias("heads"))
    back_head = lambda s: F.get("heads", (s["heads_before"] - HEADS_BACK).cast("int")) + 1
    start = lambda s: F.greatest(F.coalesce(s["after_sum"], F.lit(0)), F.coalesce(back_head(s), F.lit(0)))
    asked = docs.where(F.size("targets") >= 2).select(
        "quote_id", F.size("targets").alias("options"), F.posexplode("targets").alias("option_no", "target"))
    own = F.array_min(F.transform(
        F.filter("subtotals", lambda s: s["target"] == F.col("target")), lambda s: F.struct(s["stop"].alias("stop"), start(s).alias("start"))))
    sections = asked.join(marks, "quote_id").withColumn("section", own).where(F.col("section").isNotNull())
    inside = sections.select(
        "quote_id", "options", "option_no", "target", "section", F.explode(F.filter("triples", lambda t: (
            (t["pos"] >= F.col("section.start")) & (t["pos"] + 2 < F.col("section.stop")) & (t["named"]["pos"] >= F.col("section.start"))))).alias("t"))
    inside = inside.select("quote_id", "options", "option_no", "target", "section", "t.*")
    parent = F.col("named.display")
    by_parent = F.col("named.is_detail") & (parent["pos"] >= F.col("section.start")) & (F.col("named.pos") - parent["pos"] <= PARENT_LINES)
    items = inside.withColumn("item_name", F.when(by_parent, parent["shown"]).otherwise(F.col("named.shown")))
    items = items.groupBy("quote_id", "options", "option_no", "target", "item_name", "supply_amount").agg(
        F.min(F.struct("pos", "quantity", "unit_price")).alias("t"))
    items = items.withColumn("option_sum", F.sum("supply_amount").over(Window.partitionBy("quote_id", "option_no")))
    fits = F.abs(F.col("option_sum") - F.col("target")) <= tolerance
    found = F.size(F.collect_set(F.when(fits, F.col("option_no"))).over(Window.partitionBy("quote_id")))
    return items.withColumn("found", found).where("found = options").select(
        "quote_id", (F.col("option_no") + 1).alias("option_no"), F.col("t.pos").alias("line_no"), "item_name",
        F.col("t.quantity").alias("quantity"), F.col("t.unit_price").alias("unit_price"), "supply_amount", "option_sum",
        F.lit(METHOD_SECTION).alias("split_method"))
