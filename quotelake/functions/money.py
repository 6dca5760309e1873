"""Korean money, number, duration and date texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelake.functions.expr import group1, lookup, to_long

# Money units and the amount pattern of quote texts.
UNIT_VALUE = {
    "억원": 100000000, "억": 100000000, "천만원": 10000000, "천만": 10000000,
    "백만원": 1000000, "백만": 1000000, "만원": 10000, "만": 10000, "원": 1,
}
UNIT_PATTERN = "억원|억|천만원|천만|백만원|백만|만원|만|원"
AMOUNT_PATTERN = r"(?:₩|￦|\\)?\s*(\d{1,3}(?:,\d{3})+|\d{5,})"
COMMA_AMOUNT = r"(\d{1,3}(?:,\d{3})+)"
DATE_PATTERN = r"(\d{4})[.\-/년\s]+(\d{1,2})[.\-/월\s]+(\d{1,2})"


def parse_amount(text: Column) -> Column:
    """Whole won named by a text: comma amount, five or more digits, or number with a unit."""
    t = F.regexp_replace(text, r"[₩￦Ww()]|KRW|krw", "")
    unit_pattern = rf"(\d+(?:\.\d+)?)\s*({UNIT_PATTERN})?"
    unit = F.coalesce(lookup(F.regexp_extract(t, unit_pattern, 2), UNIT_VALUE), F.lit(1))
    return F.coalesce(
        to_long(F.regexp_extract(t, COMMA_AMOUNT, 1)),
        F.regexp_extract(t, r"(\d{5,})\s*원?", 1).try_cast("bigint"),
        (F.regexp_extract(t, unit_pattern, 1).try_cast("double") * unit).cast("bigint"),
    )


def amounts_in(text: Column) -> Column:
    """All amounts of a text in order (comma groups or at least five digits)."""
    return F.transform(F.regexp_extract_all(text, F.lit(AMOUNT_PATTERN), F.lit(1)), lambda a: to_long(a))


def comma_amounts(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(COMMA_AMOUNT), F.lit(1)), lambda a: to_long(a))


def unit_amounts(text: Column) -> Column:
    """All number-with-unit amounts of a text (units of ten thousand and up)."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?\s*(?:억원|억|천만원|천만|백만원|백만|만원|만))"), F.lit(1))
    return F.transform(found, lambda a: parse_amount(a))


def last_of(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def request_money(text: Column) -> Column:
    """Money of request texts, where a number may carry commas and a unit."""
    t = F.regexp_replace(text, r"[\s,]", "")
    n = group1(t, r"(\d+(?:\.\d+)?)").cast("double")
    scale = (
        F.when(t.contains("천만원"), 10000000).when(t.contains("만원"), 10000)
        .when(t.contains("억"), 100000000).otherwise(1)
    )
    return (n * scale).cast("bigint")


def budget_amount(text: Column) -> Column:
    """Budget of a request form."""
    t = F.regexp_replace(text, "[, ]", "")
    n = group1(t, r"(\d+(?:\.\d+)?)").cast("double")
    scale = (
        F.when(t.contains("억"), 100000000).when(t.contains("천만"), 10000000).when(t.contains("백만"), 1000000)
        .when(t.contains("만원"), 10000).when(t.contains("천원"), 1000).otherwise(1)
    )
    return (n * scale).cast("bigint")


def revenue_million(text: Column) -> Column:
    """Yearly revenue in million won."""
    n = F.replace(group1(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(","), F.lit("")).try_cast("double")
    return F.when(F.replace(text, F.lit(" "), F.lit("")).contains("억"), n * 100.0).otherwise(n)


def quantity_unit(text: Column) -> tuple[Column, Column]:
    """(quantity, unit): a number followed by a known unit word wins over the first number."""
    words = "EA|SETS|SET|식|개|대|조|매|units|unit"
    strict = rf"(?iU)(\d+(?:\.\d+)?)\s+({words})\b"
    loose = rf"(?i)(\d+(?:\.\d+)?)\s*({words})?"
    return (
        F.coalesce(group1(text, strict), group1(text, loose)).cast("double"),
        F.coalesce(group1(text, strict, 2), group1(text, loose, 2)),
    )


def duration_days(number: Column, unit: Column) -> Column:
    n = number.cast("int")
    return (
        F.when(unit == "영업일", F.rint(n * 1.4).cast("int")).when(unit == "주", n * 7)
        .when(unit.isin("개월", "달"), n * 30).otherwise(n)
    )


def duration_months(number: Column, unit: Column) -> Column:
    return F.when(unit == "년", number.cast("int") * 12).otherwise(number.cast("int"))


def korean_months(text: Column) -> Column:
    """Months of the first year count, else of the first month count."""
    years = group1(text, r"(\d+(?:\.\d+)?)\s*년").cast("double")
    months = group1(text, r"(\d+(?:\.\d+)?)\s*개월").cast("double")
    return F.coalesce((years * 12).cast("int"), months.cast("int"))


def normalize_date(text: Column) -> Column:
    """DATE of the first year-month-day in the text; NULL outside 2000-2100 or for impossible days."""
    y, m, d = (F.regexp_extract(text, DATE_PATTERN, i).try_cast("int") for i in (1, 2, 3))
    ok = y.between(2000, 2100) & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))


def dates_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"({DATE_PATTERN})"), F.lit(1))
    return F.array_compact(F.transform(found, lambda s: normalize_date(s)))


def excel_date(serial: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))
