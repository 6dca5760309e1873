"""Known input/output rows of single operators."""

import pytest
from pyspark.sql import functions as F

from quotelake.functions.money import excel_date, normalize_date, parse_amount
from quotelake.functions.names import normalize_company
from quotelake.functions.rules import reclassify
from quotelake.operators import extract, specs, split, tables
from quotelake.operators.evaluate import card_violations
from quotelake.operators.similarity import refresh_store
from quotelake.operators.validate import line_arithmetic


def one(spark, text, fn):
    return fn(spark.createDataFrame([(text,)], "text string")).first()


@pytest.mark.parametrize("text,months", [
    ("유지보수 : 설치완료일로부터 2년 무상 (출장실비 별도)", 24),
    ("시공후 1년 무상보증, 1년 이후 유상보증", 12),
    ("제품무상보증기간 : 준공일로부터 1년", 12),
    ("유상 보수 정비 요율 : 별도협의", None),
    ("A/S 6개월 무상", 6),
    ("무 상 보 수 기 간 : 납품완료 후 12개월", 12),
])
def test_warranty(spark, text, months):
    assert one(spark, text, extract.warranty).warranty_months == months


def test_summary_amounts(spark):
    r = one(spark, "공급금액 18,500,000\n세액 1,850,000\nVAT 포함 총금액 20,350,000", extract.summary_amounts)
    assert (r.supply_amount, r.tax_amount, r.total_amount) == (18500000, 1850000, 20350000)


@pytest.mark.parametrize("text,won", [
    ("₩1,234,000", 1234000), ("3억", 300000000), ("1.5억원", 150000000), ("5천만원", 50000000), ("250만원", 2500000),
    ("금 15000000 원", 15000000), ("없음", None),
])
def test_money(spark, text, won):
    assert spark.range(1).select(parse_amount(F.lit(text)).alias("v")).first().v == won


def test_dates(spark):
    r = spark.range(1).select(
        normalize_date(F.lit("2024년 5월 3일")).alias("a"), normalize_date(F.lit("2024-02-31")).alias("b"),
        normalize_date(F.lit("1999.1.1")).alias("c"), excel_date(F.lit(45000)).alias("d")).first()
    assert (str(r.a), r.b, r.c, str(r.d)) == ("2024-05-03", None, None, "2023-03-15")


def test_company_names(spark):
    names = ["(주) 가나 다", "주식회사 가나다", "㈜가나다", "가나다(주)"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.k for r in df.select(normalize_company(F.col("n")).alias("k")).collect()} == {"가나다"}


def test_summary_rows_removed(spark):
    items = spark.createDataFrame([("NEW DISPLAY",), ("부가세",), ("총금액",)], "item_name string").withColumn("spec", F.lit("")).withColumn("note", F.lit(""))
    assert [r.item_name for r in tables.remove_summary_items(items).collect()] == ["NEW DISPLAY"]


def test_amount_pairs(spark):
    items = [("A", None), ("B", None)]
    df = spark.createDataFrame([(items, "₩1,000,000 ₩2,000,000\n₩500,000 ₩500,000", 2500000)],
                               "items array<struct<item_name:string,quantity:double>>, text string, supply_amount long")
    got = tables.assign_amount_pairs(df).first().assigned
    assert [r.supply_amount for r in got] == [2000000, 500000]


def test_display_specs(spark):
    text = "전체화면 크기 4200 x 2363 mm 해상도 2688 x 1512 pixel pitch 1.5625 밝기 800 nit refresh rate 3840 Hz 최대소비전력 3.2 kW"
    r = specs.parse_specs(spark.createDataFrame([(text,)], "spec_raw string")).first()
    assert (r.screen_size_mm, r.resolution, r.pixel_pitch_mm, r.brightness_cd_m2) == ("4200 x 2363", "2688 x 1512", 1.5625, 800.0)
    assert (r.refresh_rate_hz, r.power_consumption_kw) == (3840.0, 3.2)
    w = specs.parse_specs(spark.createDataFrame([("최대소비전력 : 1200 W",)], "spec_raw string")).first()
    assert w.power_consumption_kw == 1.2


def test_display_category_kept(spark):
    df = spark.createDataFrame([("LED Screen Die Casting 방식", "소프트웨어 세팅 포함", "DISPLAY")], "name string, spec_raw string, category string")
    r = reclassify(df).first().rule
    assert (r.category, r.cost_type) == ("DISPLAY", "DISPLAY")


def test_line_arithmetic(spark):
    df = spark.createDataFrame([("a", 2.0, 1000000, 2900000), ("b", 1.0, 5, 5)], "name string, quantity double, unit_price long, total_price long")
    rows = line_arithmetic(df).collect()
    assert [(r.name, r.difference) for r in rows] == [("a", 900000)]


def _options(spark, amounts, targets, names=None):
    names = names or ["x"] * len(amounts)
    items = [(n, "", a) for n, a in zip(names, amounts)]
    return split.split_options(spark.createDataFrame(
        [("q", items, targets)], "quote_id string, items array<struct<name:string,spec_raw:string,amount:long>>, targets array<long>")).first()


def test_option_split(spark):
    amounts = [4000000, 3000000, 2473000, 2000000, 2000000, 1000000, 9000000, 6000000, 5000000, 800000]
    r = _options(spark, amounts, [14473000, 20800000])
    assert r.split_method == split.METHOD_SUM and r.option_numbers == [1] * 6 + [2] * 4


def test_option_split_failure(spark):
    r = _options(spark, [4000000, 3000000], [1, 7000000])
    assert r.split_method is None and r.check_required == split.MSG_SPLIT_FAILED


def test_option_lines_left_over_fail(spark):
    assert _options(spark, [100000, 200000, 50000], [100000, 200000]).split_method is None


def test_cabinet_correction(spark):
    df = spark.createDataFrame([("LED 전광판", "함체수량 4 x 5 = 20", 1.0, 4000000, 4000000), ("Player", "", 2.0, 900000, 1800000)],
                               "name string, spec_raw string, quantity double, unit_price long, total_price long")
    rows = {r.name: r for r in split.correct_lines(df).collect()}
    assert (rows["LED 전광판"].quantity, rows["LED 전광판"].unit_price) == (20.0, 200000)
    assert (rows["Player"].quantity, rows["Player"].total_price) == (1.0, 900000)


def test_embedding_refresh_only_stale(spark):
    partners = spark.createDataFrame(
        [("a", ["LED"], True, 0.1, "fast", "good", False, {"LED": 3}, 3, "서울"), ("b", ["DID"], False, 0.2, "slow", "bad", False, {"DID": 1}, 1, "부산")],
        "name string, specialty_tags array<string>, is_premium boolean, success_rate double, response_speed string, financial_status string, "
        "is_excluded boolean, solution_breakdown map<string,int>, installation_count int, company_location string")
    empty = spark.createDataFrame([], "name string, source_hash string, vec array<double>")
    first = refresh_store(partners, empty, lambda texts: [[float(len(t)), 1.0] for t in texts], 2).collect()
    assert {r.name for r in first} == {"a", "b"}
    store = spark.createDataFrame(first, "name string, source_hash string, vec array<double>")
    again = refresh_store(partners, store, lambda texts: [[-1.0, -1.0] for _ in texts], 2).collect()
    assert all(r.vec[0] > 0 for r in again)
    wider = refresh_store(partners, store, lambda texts: [[-1.0, -1.0, -1.0] for _ in texts], 3).collect()
    assert all(len(r.vec) == 3 for r in wider)


def test_violation_categories(spark):
    cards = spark.createDataFrame([("r", "q", "추측사", "최고의 선택, 총 3,000원", ["보증 12개월"], ["가격"])],
                                  "record_id string, quote_id string, vendor_name string, card_summary string, strengths array<string>, weaknesses array<string>")
    items = spark.createDataFrame([("r", "q", "", ["총 공급가 미기재"], None, None, None, None)],
                                  "record_id string, quote_id string, vendor_name string, check_required array<string>, warranty_months int, "
                                  "total_supply_price long, total_with_vat long, delivery_weeks int")
    got = card_violations(cards, items).first().categories
    assert got == ["banned_phrase", "check_required_missing", "vendor_guess", "warranty_guess", "price_guess"]
