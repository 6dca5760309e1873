"""Amounts are sought near the lines that name one; results stay the same."""

from pyspark.sql import functions as F

from quotelake.functions.expr import SPACE, SPACE_IN_LINE
from quotelake.operators.extract import TAX_TOKENS, summary_amounts


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_every_whitespace(spark):
    codes = spark.range(1, 65536).where("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    found = lambda pattern: {r.id for r in codes.where(F.col("c").rlike(pattern)).select("id").collect()}
    every = {*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    assert found(SPACE) == every and found(SPACE_IN_LINE) == every - {10, 13}


def test_amounts_beside_and_below_labels(spark):
    texts = [
        "공급　가액\r\n\r\n  \r1,000\x1c2,000\n세 액 300", "VAT 별도\n5,000 600\n소계 1,234\n합계 98,765", "vat\n\n12345", "VAT별도 합계 7,000",
        "안내 9,999,999\n전체 합계(VAT포함)\n문장\n8,800", "", None, "부가세 포함가 1,100\n부가가치세 100"]
    docs = spark.createDataFrame(list(enumerate(texts)), "quote_id long, text string")
    rows = summary_amounts(docs).orderBy("quote_id").select("supply_amount", "tax_amount", "total_amount").collect()
    assert list(map(tuple, rows)) == [
        (2000, None, None), (98765, None, None), (None, 12345, None), (7000, None, None), (None, None, 8800), (None, None, None),
        (None, None, None), (None, None, 1100)]


def test_a_line_is_classified_once(spark):
    docs = spark.createDataFrame([(1, "합계 1,000")], "quote_id long, text string")
    assert plan_of(summary_amounts(docs)).count("|".join(TAX_TOKENS) + ")") == 1
