"""Registered text-extraction queries; the SQL side returns the columns the texts were written from."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import extract as x
from quotelake.operators import specs as s
from quotelake.sources import documents as doc


def extract_amounts(spark, d):
    return x.summary_amounts(doc.quote_texts(spark, d)).select("quote_id", "supply_amount", "tax_amount", "total_amount")


def extract_labelled_amounts(spark, d):
    return x.labelled_amounts(doc.quote_texts(spark, d)).select("quote_id", "supply_amount", "tax_amount", "total_amount")


def extract_key_values(spark, d):
    kv = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    docs = doc.base(spark, d).withColumn("key_values", F.array(
        kv("견 적 일 자", doc.date_text()),
        kv("부가세 합계", doc.won(F.col("tax"))), kv("합 계", F.concat(F.lit("₩"), doc.won(F.col("supply")), F.lit("원"))),
        kv("VAT 포함", doc.won(F.col("total")))))
    return x.key_value_amounts(docs).select("quote_id", "kv_total_amount", "kv_supply_amount", "kv_tax_amount", "kv_quote_date")


def option_totals(spark, d):
    return x.option_totals(doc.quote_texts(spark, d)).select(
        "quote_id", "option_total_count", F.col("option_candidates")[0]["supply_price"].alias("first_supply"))


def extract_dates(spark, d):
    return x.quote_date(doc.quote_texts(spark, d)).select("quote_id", "quote_date")


def extract_delivery(spark, d):
    return x.delivery(doc.quote_texts(spark, d)).select("quote_id", "delivery_days", "delivery_weeks", "delivery_basis_raw")


def extract_warranty(spark, d):
    return x.warranty(doc.quote_texts(spark, d)).select("quote_id", "warranty_months", "warranty_check")


def extract_terms(spark, d):
    out = x.terms(doc.quote_texts(spark, d))
    flag = x.inclusion_flag(F.col("text"), [r"설치비\s*포함", r"CMS"], [r"CMS\s*소프트웨어\s*미포함"])
    return out.select(
        "quote_id", "quote_validity_days", "payment_terms", F.size("special_terms").alias("special_term_count"),
        flag.alias("software_included"))


def project_name_resolve(spark, d):
    k = F.col("quote_id")
    docs = doc.quote_texts(spark, d).withColumn("project_name", F.when(k % 6 == 5, "구축 사업").otherwise("견적서")).withColumn(
        "vendor_name", doc.vendor_of(k)).withColumn("file_name", F.when(k % 10 == 1, F.col("file_name")).otherwise(
            F.concat(F.lit("사업 "), (k % 100).cast("string"), F.lit("_"), doc.vendor_of(k), F.lit(".pdf"))))
    return x.resolve_project_name(docs).select("quote_id", "project_name_source", "resolved_project_name", "project_name_check")


def extract_specs(spark, d):
    docs = doc.base(spark, d).withColumn("spec_raw", doc.spec_text())
    return s.parse_specs(docs).select(
        "quote_id", "screen_size_mm", "resolution", "cabinet_size_mm", "pixel_pitch_mm", "brightness_cd_m2",
        "refresh_rate_hz", "power_consumption_kw", "bezel_mm")


def sanitize_specs(spark, d):
    docs = doc.base(spark, d).withColumn("spec_raw", doc.spec_text())
    return s.sanitize_specs(s.parse_specs(docs)).select(
        "quote_id", "screen_size_mm", "resolution", "bezel_mm",
        F.array_join(F.transform("spec_sanitization", lambda r: r["field"]), "|").alias("removed"))


def hardware_section(spark, d):
    docs = s.spec_block(doc.quote_texts(spark, d).withColumn("item_name", F.lit("LED Display")))
    parsed = s.hardware_section(s.sanitize_specs(s.parse_specs(docs)))
    return parsed.select("quote_id", "hw_screen_size_mm", "hw_resolution", "hw_pixel_pitch", "hw_brightness_cd_m2", "hw_refresh_rate", "hw_power_kw")


def best_spec_chunk(spark, d):
    """Two products in either order; the group's own part, and the whole text where no group is known."""
    k = F.col("quote_id")
    n = lambda c: c.cast("string")
    led = F.concat(F.lit("LED Display P"), n(k % 3 + 1), F.lit(".5 SMD 해상도 "), n(1000 + k % 5 * 100), F.lit(" x "), n(600 + k % 5 * 10),
                   F.lit(" 밝기 "), n(700 + k % 4 * 100), F.lit(" nit"))
    video = F.concat(F.lit("55인치 베젤 "), n(k % 5), F.lit("mm FHD"))
    docs = doc.base(spark, d).withColumn(
        "product_group", F.when(k % 7 == 0, F.lit(None)).when(k % 2 == 0, "LED전광판").otherwise("비디오월")).withColumn(
        "text", F.when(k % 4 < 2, F.concat_ws("\n", F.lit("개요 문단"), led, video)).otherwise(F.concat_ws(" · ", video, led)))
    return s.best_spec_chunk(docs).select("quote_id", "spec_chunk")


QUERIES = {f.__name__: f for f in (
    extract_amounts, extract_labelled_amounts, extract_key_values, option_totals, extract_dates, extract_delivery,
    extract_warranty, extract_terms, project_name_resolve, extract_specs, sanitize_specs, hardware_section, best_spec_chunk)}

BASE = """WITH b AS (SELECT o_orderkey AS quote_id, o_custkey AS project_id, CAST(o_orderdate AS DATE) AS dt, CAST(round(o_totalprice * 100) AS BIGINT) AS supply FROM orders),
d AS (SELECT *, supply // 10 AS tax, supply + supply // 10 AS total, quote_id % 12 + 1 AS w FROM b) """
SIZE = "(CASE WHEN quote_id % 5 = 0 THEN 600 + quote_id % 300 ELSE 1000 + quote_id % 5000 END)"
SCREEN = f"{SIZE} || ' x ' || (500 + quote_id % 3000)"
RES = "(640 + quote_id % 3000) || ' x ' || (400 + quote_id % 2000)"
PITCH = "(10 + quote_id % 30) / 10.0::DOUBLE"
POWER = "CASE WHEN quote_id % 2 = 0 THEN 1 + quote_id % 9 + 0.5 ELSE (500 + quote_id % 4000) / 1000.0 END::DOUBLE"
SAN = f"""san AS (SELECT quote_id, CASE WHEN quote_id % 7 = 0 OR {SIZE} < 1000 OR 500 + quote_id % 3000 < 500 THEN NULL ELSE {SCREEN} END AS screen,
 CASE WHEN 400 + quote_id % 2000 < 480 OR (quote_id % 7 = 0 AND abs(640 + quote_id % 3000 - {SIZE}) <= 1 AND abs(400 + quote_id % 2000 - (500 + quote_id % 3000)) <= 1) THEN NULL ELSE {RES} END AS res,
 CASE WHEN quote_id % 60 BETWEEN 1 AND 50 THEN quote_id % 60 END::DOUBLE AS bezel FROM d)"""
ORACLE = {
    "extract_amounts": BASE + "SELECT quote_id, supply AS supply_amount, tax AS tax_amount, total AS total_amount FROM d",
    "extract_labelled_amounts": BASE + """SELECT quote_id, CASE WHEN quote_id % 3 = 2 THEN tax ELSE supply END AS supply_amount,
 CASE WHEN quote_id % 3 = 2 THEN NULL ELSE tax END AS tax_amount,
 CASE WHEN quote_id % 3 = 2 AND quote_id % 4 = 0 THEN supply * 3 + tax * 3 ELSE total END AS total_amount FROM d""",
    "extract_key_values": BASE + "SELECT quote_id, total AS kv_total_amount, supply AS kv_supply_amount, tax AS kv_tax_amount, CASE WHEN year(dt) BETWEEN 2000 AND 2100 THEN dt END AS kv_quote_date FROM d",
    "option_totals": BASE + """SELECT quote_id, (CASE WHEN supply >= 100000 AND tax >= 10000 THEN 1 ELSE 0 END + CASE WHEN quote_id % 4 = 0 AND supply * 3 >= 100000 AND tax * 3 >= 10000 THEN 1 ELSE 0 END)::INT AS option_total_count,
 CASE WHEN supply >= 100000 AND tax >= 10000 THEN supply WHEN quote_id % 4 = 0 AND supply * 3 >= 100000 AND tax * 3 >= 10000 THEN supply * 3 END AS first_supply FROM d""",
    "extract_dates": BASE + "SELECT quote_id, CASE WHEN year(dt) BETWEEN 2000 AND 2100 THEN dt END AS quote_date FROM d",
    "extract_delivery": BASE + """, e AS (SELECT *, CASE quote_id % 5 WHEN 0 THEN w * 7 WHEN 1 THEN (w + 2) * 7 WHEN 3 THEN CAST(round_even(w * 5 * 1.4::DOUBLE, 0) AS BIGINT) WHEN 4 THEN w * 30 END AS days FROM d)
 SELECT quote_id, days AS delivery_days, CAST(ceil(days / 7.0) AS INT) AS delivery_weeks, CASE quote_id % 5 WHEN 0 THEN '발주 후 ' || w || '주 이내' WHEN 1 THEN '계약 후 ' || w || '~' || (w + 2) || '주' WHEN 2 THEN '별도협의' END AS delivery_basis_raw FROM e""",
    "extract_warranty": BASE + """SELECT quote_id, CASE quote_id % 7 WHEN 0 THEN 24 WHEN 1 THEN 12 WHEN 2 THEN 36 WHEN 4 THEN 6 WHEN 5 THEN 12 WHEN 6 THEN 18
  ELSE (CASE WHEN quote_id % 3 = 2 AND year(dt) % 10 = 1 THEN 12 WHEN quote_id % 3 = 2 AND year(dt) % 10 = 3 THEN 36 END) END AS warranty_months,
 CASE WHEN quote_id % 7 = 0 THEN '출장실비 별도 조건 확인 필요' END AS warranty_check FROM d""",
    "extract_terms": BASE + """SELECT quote_id, CASE WHEN quote_id % 2 = 0 THEN 30 ELSE 60 END AS quote_validity_days,
 CASE quote_id % 4 WHEN 0 THEN '선입금 50%, 설치 후 50%' WHEN 1 THEN '현금결제' WHEN 2 THEN '발주시 30%' END AS payment_terms,
 ((CASE WHEN quote_id % 3 = 2 THEN 2 WHEN quote_id % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN quote_id % 5 = 2 THEN 1 ELSE 0 END) + (CASE WHEN quote_id % 7 IN (0, 1, 2, 3, 4) THEN 1 ELSE 0 END)
  + (CASE WHEN quote_id % 4 IN (0, 1) THEN 1 ELSE 0 END) + 1 + (CASE WHEN quote_id % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN quote_id % 2 = 1 THEN 1 ELSE 0 END))::INT AS special_term_count,
 CASE WHEN quote_id % 2 = 1 THEN false END AS software_included FROM d""",
    "project_name_resolve": BASE + """, r AS (SELECT quote_id, project_id, CASE WHEN quote_id % 6 = 5 THEN 'parser' WHEN quote_id % 2 = 0 THEN 'ocr_label' ELSE 'file_name_fallback' END AS src FROM d)
 SELECT quote_id, src AS project_name_source, CASE src WHEN 'parser' THEN '구축 사업' WHEN 'ocr_label' THEN '현장 ' || project_id || ' 구축'
  ELSE (CASE WHEN quote_id % 10 = 1 THEN CAST(quote_id AS VARCHAR) ELSE '사업 ' || (quote_id % 100) END) || ' Supplier#' END AS resolved_project_name,
 CASE WHEN src = 'file_name_fallback' THEN '프로젝트명이 문서에서 명확히 추출되지 않아 파일명 기준으로 보정됨' END AS project_name_check FROM r""",
    "extract_specs": BASE + f"""SELECT quote_id, {SCREEN} AS screen_size_mm, {RES} AS resolution, CASE WHEN quote_id % 7 = 0 THEN {SCREEN} END AS cabinet_size_mm,
 {PITCH} AS pixel_pitch_mm, (300 + quote_id % 900)::DOUBLE AS brightness_cd_m2, (60 + (quote_id % 8) * 500)::DOUBLE AS refresh_rate_hz, {POWER} AS power_consumption_kw, (quote_id % 60)::DOUBLE AS bezel_mm FROM d""",
    "sanitize_specs": BASE + f""", {SAN} SELECT quote_id, screen AS screen_size_mm, res AS resolution, bezel AS bezel_mm,
 concat_ws('|', CASE WHEN screen IS NULL THEN 'screen_size_mm' END, CASE WHEN res IS NULL THEN 'resolution' END, CASE WHEN bezel IS NULL THEN 'bezel_mm' END) AS removed FROM san""",
    "hardware_section": BASE + f""", {SAN} SELECT d.quote_id, screen AS hw_screen_size_mm, res AS hw_resolution, {PITCH.replace('quote_id', 'd.quote_id')} AS hw_pixel_pitch,
 (300 + d.quote_id % 900)::INT AS hw_brightness_cd_m2, (60 + (d.quote_id % 8) * 500)::INT AS hw_refresh_rate, {POWER.replace('quote_id', 'd.quote_id')} AS hw_power_kw FROM d JOIN san USING (quote_id)""",
    "best_spec_chunk": BASE + """, p AS (SELECT quote_id, 'LED Display P' || (quote_id % 3 + 1) || '.5 SMD 해상도 ' || (1000 + quote_id % 5 * 100) || ' x ' || (600 + quote_id % 5 * 10)
  || ' 밝기 ' || (700 + quote_id % 4 * 100) || ' nit' AS led, '55인치 베젤 ' || (quote_id % 5) || 'mm FHD' AS video FROM d)
 SELECT quote_id, CASE WHEN quote_id % 7 = 0 THEN (CASE WHEN quote_id % 4 < 2 THEN '개요 문단 ' || led || ' ' || video ELSE video || ' ' || led END)
  WHEN quote_id % 2 = 0 THEN led ELSE video END AS spec_chunk FROM p""",
}
