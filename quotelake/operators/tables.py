"""Line items from recognised tables and from plain text lines.

A recognised table is one row (``rows``: array of cell arrays), so reading it is a
narrow job; only corrections that compare a quote's items with its totals shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelake.functions.expr import (
    any_of, contains_any, contains_any_case, group1, matched, once, one_space, spaceless, squeeze, strip, strip_cell, to_long,
)
from quotelake.functions.money import AMOUNT_PATTERN, amounts_in, last_of, quantity_unit
from quotelake.functions.vocab import OVERHEAD_NAMES
from quotelake.operators.extract import lines_of

# Header words per column role, summary words, placeholder names.
ROLE_WORDS = {
    "row_no": ["no", "no.", "번호", "순번"],
    "item_name": ["품명", "품목", "구분", "제품명", "모델명"],
    "spec": ["내용", "상세내역", "규격", "비고"],
    "quantity": ["수량", "qty", "q'ty"],
    "unit": ["단위"],
    "unit_price": ["단가", "견적단가"],
    "supply_amount": ["공급가액", "공급가", "견적금액", "금액", "소계"],
    "tax_amount": ["세액", "부가세", "vat"],
}
_WORDS = [word for words in ROLE_WORDS.values() for word in words]
#: The shortest of all role words; a text that holds none of them holds none of the others.
ANY_ROLE = [word for word in dict.fromkeys(_WORDS) if not any(other != word and other in word for other in _WORDS)]
#: Two role words, one after the other; words of different roles cannot overlap.
TWO_ROLE_WORDS = "(?is)" + ".*?".join(["(?:" + "|".join(re.escape(word) for word in ANY_ROLE) + ")"] * 2)
FINGERPRINT_ROLES = {
    "item_name": ["품명", "품목", "구분", "내용"], "quantity": ["수량", "qty"], "unit_price": ["단가"],
    "supply_amount": ["공급가액", "금액"], "tax_amount": ["세액", "부가세"],
}
SUMMARY_WORDS = ["합계", "소계", "공급가", "부가세", "부가가치세", "vat", "총금액", "전체합계"]
SPEC_LABEL_NAMES = [
    "밝기", "해상도", "패널해상도", "전체해상도", "전체크기", "화면크기", "스크린크기", "screensize", "displaysize",
    "resolution", "pixelpitch", "refreshrate",
]
SUMMARY_NAMES = [
    "소계", "합계", "총계", "계", "공급가액", "세액", "부가세", "부가가치세", "vat", "v.a.t", "부가세(v.a.t)", "부가세(vat)",
]
DUMMY_NAME = r"^(?:\*+|[*\-_]+|[太大]{2,}|x\s*이하|\^+)$"
PRICED_ROW_WORDS = [
    "비디오월", "video wall", "패널", "panel", "브라켓", "bracket", "설치", "시운전", "install", "잡자재", "케이블", "cable",
    "기타", "led", "display", "did",
]
TEXT_HEADER_WORDS = [
    "품 명", "품명", "규 격", "규격", "수 량", "수량", "단 위", "단위", "단 가", "단가", "공 급 가 액", "공급가액", "세 액",
    "세액", "비 고", "비고", "합 계", "합계", "소계", "총계", "특기사항", "***", "太太太",
]
NUMBER = r"\d{1,3}(?:,\d{3})+|\d+"
TEXT_ITEM = (
    rf"(.+?)\s+(\d+(?:\.\d+)?\s*[xX×]\s*\d+(?:\.\d+)?\s*m?)\s+(\d+(?:\.\d+)?)\s+(\S+)\s+({NUMBER})\s+({NUMBER})\s+({NUMBER})(?:\s+(.*))?"
)
PROFILE_PATTERNS = {
    "generic_quote_table": [],
    "vat_separate_item_tax_table": [r"VAT\s*별도", r"VAT\s*합계", r"품\s*명.*수량.*단위.*단가.*공급가액.*세\s*액"],
}


def is_summary(text: Column) -> Column:
    return contains_any_case(spaceless(F.coalesce(text, F.lit(""))), SUMMARY_WORDS)


def amount_only(text: Column) -> Column:
    """Digits, and beside them nothing but whitespace and marks of money."""
    whole = F.coalesce(text, F.lit(""))
    return whole.rlike("[0-9]") & ~whole.rlike(r"(?U)[^0-9\s₩￦\\,]")


def cell_amount(text: Column) -> Column:
    return matched(text, AMOUNT_PATTERN, to_long)


def cell_number(text: Column) -> Column:
    return matched(text, r"(\d+(?:\.\d+)?)", lambda a: a.try_cast("double"))


def header_positions(tight_row: Column) -> Column:
    """Struct of the first column number per role, from one; zero or NULL where a role is absent."""
    whole = F.array_join(tight_row, "\n")
    position = lambda words: F.when(contains_any(whole, words), F.array_position(
        F.transform(tight_row, lambda c: (c != "") & contains_any(c, words)), True))
    return F.struct(*[position(words).alias(r) for r, words in ROLE_WORDS.items()])


def header_roles(positions: Column) -> Column:
    """Struct of the first column index per role, NULL where a role is absent."""
    return F.struct(*[(F.nullif(positions[r], F.lit(0)) - 1).cast("int").alias(r) for r in ROLE_WORDS])


def with_header(tables: DataFrame, header_rows: int | None = None) -> DataFrame:
    """header_index and roles: the row with most roles (two at least), earliest on ties.

    ``header_rows`` looks at the first rows only.
    """
    return _headed(tables, header_rows).drop("_texts")


def _headed(tables: DataFrame, header_rows: int | None = None) -> DataFrame:
    """:func:`with_header`, with the text of every row looked at, without whitespace, as ``_texts``."""
    seen = F.slice("rows", 1, header_rows) if header_rows else F.col("rows")
    staged = once(tables, "_texts", F.transform(seen, lambda r: spaceless(F.array_join(r, ""))))
    # a header names two roles, so it holds two role words: one look at the whole row finds the few to look at by cells
    marked = F.transform("_texts", lambda t, i: F.when(t.rlike(TWO_ROLE_WORDS), F.struct(
        (-i).alias("neg"), F.transform(F.get(seen, i), lambda c: squeeze(c)).alias("tight"))))
    staged = once(staged, "_marked", F.filter(marked, lambda m: m.isNotNull()))
    staged = once(staged, "_seats", F.transform("_marked", lambda m: header_positions(m["tight"])))
    counted = F.zip_with(
        "_marked", "_seats",
        lambda m, p: F.struct(
            sum((F.coalesce(p[role] > 0, F.lit(False)).cast("int") for role in ROLE_WORDS), F.lit(0)).alias("n"), m["neg"].alias("neg"),
            p.alias("positions"),
        ),
    )
    staged = once(staged, "_best", F.array_max(counted))
    best = F.col("_best")
    ok = F.coalesce(best["n"] >= 2, F.lit(False))
    return (
        staged.withColumn("header_index", F.when(ok, -best["neg"]))
        .withColumn("roles", F.when(ok, header_roles(best["positions"])))
        .withColumn("role_count", F.when(ok, best["n"]))
        .drop("_marked", "_seats", "_best")
    )


def table_items(tables: DataFrame) -> DataFrame:
    """One row per item: a named row opens an item, unnamed rows below extend it and fill its gaps.

    Adds block_no, item_name, spec, quantity, unit, unit_price, supply_amount, tax_amount,
    amount and row_count.
    """
    at = lambda r, role: F.get(r, F.col("roles")[role])
    cell = lambda r, role: strip_cell(F.coalesce(at(r, role), F.lit("")))
    below = lambda c: F.slice(c, F.col("header_index") + 2, F.size("rows"))
    seen = F.zip_with(below("rows"), below("_texts"), lambda r, t: F.when((t != "") & ~contains_any_case(t, SUMMARY_WORDS), r))
    headed = _headed(tables).where(F.col("roles.item_name").isNotNull())
    found = once(headed, "_body", F.filter(seen, lambda r: r.isNotNull())).drop("rows", "_texts")
    named = lambda name: (name != "") & ~amount_only(name)
    starts = F.transform("_body", lambda r, i: F.when(named(cell(r, "item_name")), i))
    found = once(found, "_starts", F.array_compact(starts))
    block = F.transform(
        "_starts",
        lambda p, j: F.slice("_body", p + 1, F.coalesce(F.get("_starts", j + 1), F.size("_body")) - p),
    )
    kept = [c for c in tables.columns if c != "rows"]
    blocks = found.withColumn("_blocks", block).select(*kept, "roles", F.posexplode("_blocks").alias("block_no", "_block"))
    # nearly all an item states stands in its first row: only where that has a gap are the others read
    first, more = F.get("_block", F.lit(0)), F.slice("_block", F.lit(2), F.size("_block"))

    def fill(role: str, read) -> Column:
        later = F.get(F.filter(F.transform(more, lambda r: read(at(r, role))), lambda x: x.isNotNull()), F.lit(0))
        return F.when(F.col("roles")[role].isNotNull(), F.coalesce(read(at(first, role)), later))

    below_first = F.transform(more, lambda r: F.concat_ws(" ", *[F.nullif(cell(r, x), F.lit("")) for x in ("item_name", "spec")]))
    details = F.concat(
        F.array(F.nullif(cell(first, "spec"), F.lit(""))), F.filter(below_first, lambda s: (s != "") & ~amount_only(s)))
    word = lambda x: F.nullif(strip_cell(x), F.lit(""))
    item = F.struct(
        cell(first, "item_name").alias("item_name"), clean_spec(F.array_join(details, " ")).alias("spec"),
        fill("quantity", cell_number).alias("quantity"), fill("unit", word).alias("unit"),
        *[fill(role, cell_amount).alias(role) for role in ("unit_price", "supply_amount", "tax_amount")],
        F.size("_block").alias("row_count"))
    names = ["item_name", "spec", "quantity", "unit", "unit_price", "supply_amount", "tax_amount"]
    return once(blocks, "_item", item).select(
        *kept, "block_no", *[f"_item.{n}" for n in names], F.col("_item.supply_amount").alias("amount"), "_item.row_count",
    ).where(~is_summary(F.col("item_name")))


def clean_spec(text: Column) -> Column:
    return F.nullif(one_space(F.regexp_replace(text, "(?i):?unselected:?", " ")), F.lit(""))


def headerless_items(tables: DataFrame) -> DataFrame:
    """Priced rows of tables without a header: three cells or more, a name first, the last amount counts.

    A table needs at least two such rows.
    """
    bare = with_header(tables).where(F.col("roles.item_name").isNull())
    filled = F.transform("rows", lambda r: F.filter(F.transform(r, lambda c: strip(c)), lambda c: c != ""))
    rows = F.transform(
        filled,
        lambda r, i: F.struct(
            i.alias("row_no"), r.alias("cells"), F.array_join(r, " ").alias("text"),
            last_of(F.filter(r, lambda c: cell_amount(c).isNotNull())).alias("amount_cell"),
        ),
    )
    itemized = lambda r: any_of([
        contains_any(F.lower(r["text"]), PRICED_ROW_WORDS),
        r["text"].rlike(r"(?iU)\b(?:EA|SET|식|개|대)\b"),
        F.length(F.get(r["cells"], F.lit(0))) >= 2,
    ])
    keep = lambda r: (
        (F.size(r["cells"]) >= 3) & ~is_summary(r["text"]) & r["amount_cell"].isNotNull()
        & ~amount_only(F.get(r["cells"], F.lit(0))) & itemized(r)
    )
    picked = once(bare, "_all", rows)
    picked = once(picked, "_rows", F.filter("_all", keep)).where(F.size("_rows") >= 2)
    out = picked.select(*[c for c in tables.columns if c != "rows"], F.explode("_rows").alias("_r"))
    specs = F.filter(
        F.slice("_r.cells", 2, F.size("_r.cells")),
        lambda c: (c != F.col("_r.amount_cell")) & cell_amount(c).isNull(),
    )
    qty, unit = quantity_unit(F.array_join("_specs", " "))
    return (
        once(out, "_specs", specs)
        .withColumn("row_no", F.col("_r.row_no"))
        .withColumn("item_name", F.get("_r.cells", F.lit(0)))
        .withColumn("quantity", qty)
        .withColumn("unit", unit)
        .withColumn("amount", cell_amount(F.col("_r.amount_cell")))
        .withColumn("spec", clean_spec(F.array_join(F.filter("_specs", lambda c: ~c.rlike(r"^\d+(?:\.\d+)?\s*\S{0,4}$")), " ")))
        .drop("_r", "_specs")
    )


def detailed_tables_only(items: DataFrame) -> DataFrame:
    """Items of tables with quantity and unit-price columns, if the quote has any such table; else all.

    Expects a boolean ``is_detailed`` per item row. Items are made once: the rows of a quote, as many as its document
    holds, meet in a window. Rows without a quote are left out.
    """
    seen = items.where(F.col("quote_id").isNotNull()).withColumn("_any", F.bool_or("is_detailed").over(W.partitionBy("quote_id")))
    return seen.where(F.col("is_detailed") | ~F.col("_any")).drop("_any")


def remove_summary_items(items: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("item_name", "spec", "note") if c in items.columns])
    return items.where(~is_summary(text))


def remove_invalid_items(items: DataFrame) -> DataFrame:
    """Drop label-only, summary, dummy and unpriced rows."""
    name = strip_cell(F.coalesce("item_name", F.lit("")))
    staged = once(items, "_tight", F.lower(F.regexp_replace(name, r"(?U)\s+", "")))
    tight = F.col("_tight")
    amount = F.coalesce("amount", "supply_amount")
    label_only = tight.isin(SPEC_LABEL_NAMES) & F.coalesce(F.col("amount") < 100000, F.lit(True))
    meaningful = F.length(F.regexp_replace(name, "[^가-힣A-Za-z0-9]", ""))
    priced = F.coalesce("unit_price", "supply_amount", "tax_amount", "amount").isNotNull()
    bad = (
        label_only | tight.isin(SUMMARY_NAMES) | tight.rlike(DUMMY_NAME) | (meaningful < 2) | ~priced
        | (F.col("quantity").isNull() & amount.isNull())
    )
    return staged.where(~bad).drop("_tight")


def drop_overhead(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Remove the first overhead row whose absence makes the items add up to the supply price.

    ``totals`` has quote_id and supply_amount; :func:`overhead_log` names the removed rows. Items are made once: the rows
    of a quote, as many as its document holds, meet in a window. Rows without a quote stay, and meet only their equals.
    """
    amount = F.coalesce("amount", "supply_amount", F.lit(0))
    within = W.partitionBy("quote_id", F.when(F.col("quote_id").isNull(), F.xxhash64("item_no", "item_name")))
    stated = totals.where(F.col("supply_amount") > 0).groupBy("quote_id").agg(F.collect_set("supply_amount").alias("_stated"))
    row = F.struct("item_no", "item_name", amount.alias("_amount"))
    seen = items.withColumn("_sum", F.sum(amount).over(within)).join(stated, "quote_id", "left")
    fits = contains_any(F.col("item_name"), OVERHEAD_NAMES) & F.array_contains("_stated", F.col("_sum") - amount)
    first = F.min(F.when(fits, row)).over(within)["item_no"]
    left = seen.withColumn("_gone", F.coalesce(F.col("item_no") == first, F.lit(False))).where(~F.col("_gone"))
    return left.select(*items.columns)


def overhead_log(items: DataFrame, totals: DataFrame) -> DataFrame:
    amount = F.coalesce("amount", "supply_amount", F.lit(0))
    row = F.struct("item_no", "item_name", amount.alias("_amount"))
    # one pass over the items: their sum and, beside it, the few rows that could go
    seen = items.groupBy("quote_id").agg(
        F.sum(amount).alias("_sum"), F.collect_list(F.when(contains_any(F.col("item_name"), OVERHEAD_NAMES), row)).alias("_rows"))
    hits = (
        seen.where(F.size("_rows") > 0)
        .join(totals.select("quote_id", F.col("supply_amount").alias("_supply")), "quote_id")
        .where(F.col("_supply") > 0)
        .select("quote_id", F.explode(F.filter("_rows", lambda r: F.col("_sum") - r["_amount"] == F.col("_supply"))).alias("r"))
    )
    first = hits.groupBy("quote_id").agg(F.min("r").alias("r"))
    return first.select(
        "quote_id", F.col("r.item_no").alias("item_no"), F.col("r.item_name").alias("item_name"), F.col("r._amount").alias("amount"),
        F.lit("overhead row removed because remaining line item sum matches supply amount").alias("reason"),
    )


def assign_amount_pairs(docs: DataFrame) -> DataFrame:
    """Give unpriced items the (unit price, amount) pairs of the text, in order.

    Expects items (array of item_name, quantity structs), text and supply_amount. Adds
    ``assigned`` (array of structs, NULL unless counts, quantities and the sum all agree).
    """
    money = F.filter(lines_of(F.col("text")), lambda s: ~is_summary(s) & s.rlike(r"[₩￦\\]"))
    pairs = F.filter(
        F.transform(money, lambda s: amounts_in(s)), lambda a: (F.size(a) == 2) & (F.get(a, F.lit(0)) > 0) & (F.get(a, F.lit(1)) > 0)
    )
    staged = once(docs, "_pairs", pairs)
    joined = F.zip_with(
        "items", "_pairs",
        lambda it, p: F.struct(
            it["item_name"].alias("item_name"),
            F.coalesce(
                F.nullif(it["quantity"], F.lit(0.0)),
                F.when(F.get(p, F.lit(1)) % F.get(p, F.lit(0)) == 0, (F.get(p, F.lit(1)) / F.get(p, F.lit(0)))),
            ).alias("quantity"),
            F.get(p, F.lit(0)).alias("unit_price"),
            F.get(p, F.lit(1)).alias("supply_amount"),
        ),
    )
    total = F.aggregate("_pairs", F.lit(0).cast("bigint"), lambda acc, p: acc + F.get(p, F.lit(1)))
    fits = F.forall(
        "_joined",
        lambda r: r["quantity"].isNull() | ((r["quantity"] * r["unit_price"]).cast("bigint") == r["supply_amount"]),
    )
    same = (F.size("_pairs") == F.size("items")) & (F.size("items") > 0) & (total == F.col("supply_amount"))
    return (
        once(staged, "_joined", F.when(same, joined))
        .withColumn("assigned", F.when(fits, F.col("_joined")))
        .drop("_pairs", "_joined")
    )


def text_items(docs: DataFrame) -> DataFrame:
    """Items from plain lines: name, W×H, quantity, unit, unit price, supply, tax and note."""
    lines = F.filter(
        F.transform(lines_of(F.col("text")), lambda s: strip(s)),
        lambda s: (s != "") & ~contains_any(s, TEXT_HEADER_WORDS) & s.rlike(TEXT_ITEM),
    )
    part = lambda i: group1(F.col("_line"), TEXT_ITEM, i)
    return (
        docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(lines).alias("item_no", "_line"))
        .withColumn("item_name", strip(part(1))).withColumn("spec", strip(part(2)))
        .withColumn("quantity", part(3).cast("double")).withColumn("unit", part(4))
        .withColumn("unit_price", to_long(part(5))).withColumn("supply_amount", to_long(part(6)))
        .withColumn("tax_amount", to_long(part(7))).withColumn("amount", F.col("supply_amount") + F.col("tax_amount"))
        .withColumn("note", part(8)).drop("_line")
    )


def layout_profiles(docs: DataFrame) -> DataFrame:
    """Names of the layout profiles all of whose patterns occur in the text."""
    hits = []
    for name, patterns in PROFILE_PATTERNS.items():
        cond = F.lit(True)
        for p in patterns:
            cond = cond & F.col("text").rlike("(?is)" + p)
        hits.append(F.when(cond, F.lit(name)))
    return docs.withColumn("profiles", F.array_compact(F.array(*hits)))


def table_fingerprint(tables: DataFrame) -> DataFrame:
    header = F.lower(F.array_join(F.get("rows", F.lit(0)), " "))
    roles = F.array_compact(F.array(*[F.when(contains_any(header, w), F.lit(r)) for r, w in FINGERPRINT_ROLES.items()]))
    return tables.withColumn("fingerprint", F.array_join(roles, "+"))
