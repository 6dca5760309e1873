"""Registered table, vendor and request queries; the SQL side returns the columns the inputs were written from."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import requests as rq
from quotelake.operators import tables as t
from quotelake.operators import vendors as vn
from quotelake.sources import documents as doc
from quotelake.sources import marts as m


def table_header(spark, d):
    return t.table_fingerprint(t.with_header(doc.quote_tables(spark, d))).select(
        "quote_id", "table_no", "header_index", "role_count", F.col("roles.item_name").alias("name_col"),
        F.col("roles.supply_amount").alias("amount_col"), "fingerprint")


def items_of(spark, d):
    items = t.table_items(doc.quote_tables(spark, d))
    return t.remove_invalid_items(t.remove_summary_items(items)).withColumn("item_no", F.col("table_no") * 1000 + F.col("block_no"))


def table_items(spark, d):
    return items_of(spark, d).select("quote_id", "item_no", "item_name", "spec", "quantity", "unit_price", "amount", "row_count")


def headerless_items(spark, d):
    return t.headerless_items(doc.quote_tables(spark, d)).select("quote_id", "row_no", "item_name", "spec", "quantity", "unit", "amount")


def overhead_dropped(spark, d):
    """Items left after the overhead row that breaks the sum is removed (every second quote states that sum)."""
    totals = doc.base(spark, d).select("quote_id", F.expr(
        "CASE WHEN quote_id % 2 = 0 THEN (supply div 10) * (quote_id % 4 + 1) + supply div 20 ELSE supply END").alias("supply_amount"))
    return t.drop_overhead(items_of(spark, d), totals).select("quote_id", "item_no", "item_name", "amount")


def detailed_tables(spark, d):
    both = t.with_header(doc.quote_tables(spark, d)).withColumn(
        "is_detailed", F.coalesce(F.col("roles.quantity").isNotNull() & F.col("roles.unit_price").isNotNull(), F.lit(False)))
    return t.detailed_tables_only(both).select("quote_id", "table_no", "is_detailed")


def amount_pairs(spark, d):
    k = F.col("quote_id")
    s = F.expr("supply div 10")
    docs = doc.base(spark, d).select(
        "quote_id", F.array(F.struct(F.lit("디스플레이").alias("item_name"), F.lit(2.0).alias("quantity")),
                            F.struct(F.lit("설치").alias("item_name"), F.lit(None).cast("double").alias("quantity"))).alias("items"),
        F.concat_ws("\n", F.lit("견적"), F.concat(F.lit("₩"), doc.won(s), F.lit(" ₩"), doc.won(s * 2)),
                    F.concat(F.lit("₩"), doc.won(s), F.lit("  ₩"), doc.won(s)), F.concat(F.lit("합계 ₩"), doc.won(s * 3))).alias("text"),
        F.when(k % 5 == 0, s * 3 + 1).otherwise(s * 3).alias("supply_amount"))
    return t.assign_amount_pairs(docs).select(
        "quote_id", F.get("assigned", F.lit(0))["unit_price"].alias("first_price"), F.get("assigned", F.lit(1))["quantity"].alias("second_quantity"))


def text_line_items(spark, d):
    k = F.col("quote_id")
    docs = doc.base(spark, d).select("quote_id", F.concat_ws(
        "\n", F.lit("품 명 규 격 수 량"),
        F.concat(F.lit("LED 전광판 "), (k % 5 + 1).cast("string"), F.lit(".5 x 2.4m "), (k % 9 + 1).cast("string"), F.lit(" 식 "),
                 doc.won(F.col("supply")), F.lit(" "), doc.won(F.col("supply")), F.lit(" "), doc.won(F.col("tax")), F.lit(" 실내용")),
        F.lit("합 계 1 x 1 1 식 1,000 1,000 100"), F.lit("설명 문장")).alias("text"))
    return t.text_items(docs).select("quote_id", "item_name", "spec", "quantity", "unit", "supply_amount", "tax_amount", "amount", "note")


def layout_profiles(spark, d):
    docs = doc.base(spark, d).select("quote_id", F.when(F.col("quote_id") % 2 == 0, "VAT 별도\n품 명 / 수량 / 단위 / 단가 / 공급가액 / 세 액\nVAT 합계").otherwise("견적").alias("text"))
    return t.layout_profiles(docs).select("quote_id", F.array_join("profiles", "|").alias("profiles"))


def vendor_docs(spark, d):
    return doc.quote_texts(spark, d).select(F.col("quote_id").alias("doc_id"), "text", "file_name", F.lit("공급자").alias("vendor_name"))


def vendor_name_resolve(spark, d):
    known = m.table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    docs = vendor_docs(spark, d).withColumn("file_name", F.when(F.col("doc_id") % 5 == 0, "견적서_스캔.pdf").otherwise(F.col("file_name")))
    return vn.resolve_vendor_names(docs, known).drop("candidate_count")


def request_form_parse(spark, d):
    return rq.form_requirements(doc.request_forms(spark, d)).select(
        "project_id", "customer_name", "region", "install_schedule_text", "project_name", "usage", "category", "quantity",
        "quantity_unit", "width_mm", "height_mm", "budget_max", "review_preset", "request_summary",
        F.array_join("required_keywords", "|").alias("required_keywords"))


def request_readiness(spark, d):
    return rq.readiness(rq.form_requirements(doc.request_forms(spark, d)), F.lit("2024-01-01").cast("date")).select(
        "project_id", "field_score", "required_filled", "readiness", "readiness_message", "schedule_message")


def request_text_parse(spark, d):
    out = rq.text_requirements(doc.request_texts(spark, d))
    p = F.get("products", F.lit(0))
    p2 = F.get("products", F.lit(1))
    return out.select(
        "project_id", "customer_name", "commission_rate", "request_summary", "region", "install_schedule_text", "project_stage",
        "budget_min", "budget_max", F.size("products").alias("product_count"), p["name"].alias("name1"), p["pitch_mm"].alias("pitch1"),
        p["width_mm"].alias("width1"), p["height_mm"].alias("height1"), p["display_type"].alias("type1"), p["product_type"].alias("kind1"),
        p2["diagonal_inch"].alias("inch2"), p2["layout_rows"].alias("rows2"), p2["layout_cols"].alias("cols2"), p2["name"].alias("name2"),
        F.array_join("notes", "|").alias("notes"), F.array_join("required_keywords", "|").alias("keywords"))


QUERIES = {f.__name__: f for f in (
    table_header, table_items, headerless_items, overhead_dropped, detailed_tables, amount_pairs, text_line_items, layout_profiles,
    vendor_name_resolve, request_form_parse, request_readiness, request_text_parse)}

BASE = """WITH b AS (SELECT o_orderkey AS quote_id, o_custkey AS project_id, CAST(round(o_totalprice * 100) AS BIGINT) AS supply FROM orders),
d AS (SELECT *, supply // 10 AS tax, supply // 20 AS bracket, supply // 50 AS overhead, quote_id % 4 + 1 AS q FROM b) """


def _ok(x: str) -> str:
    # an amount is recognised from five digits, or from four digits written with a comma
    return f"CASE WHEN {x} >= 1000 THEN {x} END"


ITEMS = BASE + f""", it AS (
 SELECT quote_id, 1000 AS item_no, 'LED 전광판' AS item_name, 'P1.5 실내용 함체 500 x 500 밝기 800 nit' AS spec, q::DOUBLE AS quantity, {_ok('tax')} AS unit_price, {_ok('tax * q')} AS amount, 3 AS row_count FROM d
 UNION ALL SELECT quote_id, 1001, '브라켓', '스틸 제작형', 1.0, {_ok('bracket')}, {_ok('bracket')}, 2 FROM d
 UNION ALL SELECT quote_id, 1002, '관리비', NULL, 1.0, {_ok('overhead')}, {_ok('overhead')}, 1 FROM d),
vi AS (SELECT * FROM it WHERE amount IS NOT NULL OR unit_price IS NOT NULL)"""
FORM = """WITH f AS (SELECT c_custkey AS k, c_name, c_nationkey FROM customer),
g AS (SELECT *, CASE k % 4 WHEN 0 THEN 'LED 전광판' WHEN 1 THEN '비디오월' WHEN 2 THEN '키오스크' END AS category,
 CASE k % 3 WHEN 0 THEN '로비 안내' WHEN 1 THEN '회의실' END AS usage,
 CASE WHEN k % 2 = 0 THEN (1000 + k % 5000) || ' x ' || (500 + k % 900) || 'mm' ELSE '-' END AS size,
 '야간 시공, 현장실사 ' || (k % 3) AS other, (k % 9 + 1) || '대' AS qty,
 CASE WHEN k % 5 = 0 THEN NULL ELSE '지점 ' || c_nationkey END AS region, CASE WHEN k % 4 <> 0 THEN CAST(DATE '2024-01-01' + CAST(k % 400 AS INT) AS VARCHAR) END AS sched FROM f) """
ORACLE = {
    "table_header": BASE + """SELECT quote_id, 1 AS table_no, 1 AS header_index, 6 AS role_count, 1 AS name_col, 5 AS amount_col, '' AS fingerprint FROM d
 UNION ALL SELECT quote_id, 2, NULL, NULL, NULL, NULL, '' FROM d WHERE quote_id % 3 = 0""",
    "table_items": ITEMS + " SELECT quote_id, item_no, item_name, spec, quantity, unit_price, amount, row_count FROM vi",
    "headerless_items": BASE + f""" SELECT quote_id, 0 AS row_no, '설치비' AS item_name, NULL AS spec, 2.0::DOUBLE AS quantity, '식' AS unit, bracket AS amount FROM d WHERE quote_id % 3 = 0 AND overhead >= 1000
 UNION ALL SELECT quote_id, 1, '케이블', 'HDMI 10m', 3.0, 'EA', overhead FROM d WHERE quote_id % 3 = 0 AND overhead >= 1000""",
    "overhead_dropped": ITEMS + """, sm AS (SELECT quote_id AS sq, sum(coalesce(amount, 0)) AS s FROM vi GROUP BY 1)
 SELECT v.quote_id, item_no, item_name, amount FROM vi v JOIN d ON d.quote_id = v.quote_id JOIN sm ON sq = v.quote_id
 WHERE NOT (item_no = 1002 AND (CASE WHEN v.quote_id % 2 = 0 THEN tax * q + bracket ELSE supply END) > 0 AND s - coalesce(amount, 0) = (CASE WHEN v.quote_id % 2 = 0 THEN tax * q + bracket ELSE supply END))""",
    "detailed_tables": BASE + "SELECT quote_id, 1 AS table_no, true AS is_detailed FROM d",
    "amount_pairs": BASE + "SELECT quote_id, CASE WHEN quote_id % 5 <> 0 AND tax >= 1000 THEN tax END AS first_price, CASE WHEN quote_id % 5 <> 0 AND tax >= 1000 THEN 1.0 END::DOUBLE AS second_quantity FROM d",
    "text_line_items": BASE + """SELECT quote_id, 'LED 전광판' AS item_name, (quote_id % 5 + 1) || '.5 x 2.4m' AS spec, (quote_id % 9 + 1)::DOUBLE AS quantity, '식' AS unit, supply AS supply_amount, tax AS tax_amount, supply + tax AS amount, '실내용' AS note FROM d""",
    "layout_profiles": BASE + "SELECT quote_id, CASE WHEN quote_id % 2 = 0 THEN 'generic_quote_table|vat_separate_item_tax_table' ELSE 'generic_quote_table' END AS profiles FROM d",
    "vendor_name_resolve": """WITH v AS (SELECT o_orderkey AS k, 'Supplier#' || lpad(CAST(o_orderkey % 40 AS VARCHAR), 9, '0') AS name, o_orderkey % 40 < (SELECT count(*) FROM supplier) AS known FROM orders)
 SELECT k AS doc_id, CASE WHEN known AND (k % 3 <> 2 OR k % 5 <> 0) THEN name WHEN k % 3 = 0 THEN name WHEN k % 3 = 1 THEN name || ' 영업부' WHEN k % 5 = 0 THEN '스캔' ELSE name END AS vendor_name,
  CASE WHEN known AND (k % 3 <> 2 OR k % 5 <> 0) THEN 'partner_master_text' WHEN k % 3 = 0 THEN 'ocr_label_next_line' WHEN k % 3 = 1 THEN 'header_company_candidate' ELSE 'file_name_fallback' END AS vendor_name_source,
  CASE WHEN known AND (k % 3 <> 2 OR k % 5 <> 0) THEN 0.95 WHEN k % 3 = 0 THEN 0.9 WHEN k % 3 = 1 THEN 0.75 ELSE 0.6 END::DOUBLE AS confidence FROM v""",
    "request_form_parse": FORM + """SELECT k AS project_id, c_name AS customer_name, region, sched AS install_schedule_text, '사업 ' || k AS project_name, usage, category,
 (k % 9 + 1)::DOUBLE AS quantity, '대' AS quantity_unit, CASE WHEN k % 2 = 0 THEN 1000 + k % 5000 END AS width_mm, CASE WHEN k % 2 = 0 THEN 500 + k % 900 END AS height_mm,
 CASE k % 5 WHEN 0 THEN (k % 9 + 1) * 100000000 WHEN 1 THEN (k % 50 + 1) * 1000000 WHEN 2 THEN (k % 90 + 10) * 100 * 10000 WHEN 3 THEN (k % 1000 + 1) * 10000 END AS budget_max,
 CASE WHEN k % 6 <> 0 THEN '가격 우선' END AS review_preset, concat_ws(' / ', usage, category, size, other) AS request_summary,
 array_to_string(list_concat(CASE category WHEN 'LED 전광판' THEN ['LED', '전광판'] WHEN '비디오월' THEN ['비디오월'] WHEN '키오스크' THEN ['키오스크'] ELSE [] END,
  CASE usage WHEN '로비 안내' THEN ['로비', '안내'] WHEN '회의실' THEN ['회의실'] ELSE [] END,
  CASE WHEN k % 2 = 0 THEN list_distinct_ordered ELSE [] END, ['야간', '시공', '현장실사'], [qty], ['디스플레이', '설치']), '|') AS required_keywords
 FROM (SELECT *, CASE WHEN k % 2 = 0 THEN [CAST(1000 + k % 5000 AS VARCHAR), (500 + k % 900) || 'mm'] ELSE [] END AS list_distinct_ordered FROM g)""",
    "request_readiness": FORM + """, h AS (SELECT *, 14 + (CASE WHEN region IS NOT NULL THEN 14 ELSE 0 END) + (CASE WHEN usage IS NOT NULL THEN 14 ELSE 0 END) + 10 + (CASE WHEN sched IS NOT NULL THEN 10 ELSE 0 END)
   + 16 + 10 + (CASE WHEN k % 5 <> 4 THEN 14 ELSE 0 END) + (CASE WHEN category IS NOT NULL THEN 6 ELSE 0 END) + (CASE WHEN k % 6 <> 0 THEN 16 ELSE 0 END) AS earned,
  2 + (region IS NOT NULL)::INT + (usage IS NOT NULL)::INT + (sched IS NOT NULL)::INT + (category IS NOT NULL)::INT AS required_filled FROM g),
 i AS (SELECT *, CAST(floor(earned / 124.0::DOUBLE * 100 + 0.5) AS INT) AS field_score FROM h),
 j AS (SELECT *, CAST(floor(field_score * 0.55::DOUBLE + (CASE WHEN required_filled = 6 THEN 100 ELSE 0 END) * 0.45::DOUBLE + 0.5) AS INT) AS readiness FROM i)
 SELECT k AS project_id, field_score, required_filled, readiness,
  CASE WHEN readiness >= 85 AND required_filled = 6 THEN '입력과 사전 검증이 충분해요. 지금 상태로 파트너 매칭을 진행해도 좋아요.' WHEN readiness >= 60 THEN '기본 조건은 갖춰졌어요. 남은 항목을 보완하면 추천 정확도가 더 높아져요.' ELSE '항목들을 채우면 매칭 준비도가 높아져요.' END AS readiness_message,
  CASE WHEN sched IS NULL THEN '일정이 없으면 납기 기준 매칭 정확도가 낮아져요.' WHEN CAST(sched AS DATE) > DATE '2024-07-01' THEN '일정이 6개월을 초과해 우선 매칭 보류 대상으로 표시돼요.' ELSE '프로젝트 기간이 가능한 범위예요.' END AS schedule_message FROM j""",
    "request_text_parse": """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer)
SELECT k AS project_id, '고객 ' || k AS customer_name, CASE WHEN k % 3 = 0 THEN (k % 7 + 3)::DOUBLE END AS commission_rate,
 CASE WHEN k % 2 = 0 THEN '로비 개선 추가 설명' ELSE '로비 개선' END AS request_summary, CASE WHEN k % 4 <> 0 THEN '지역 ' || n END AS region,
 (k % 8 + 2) || '주 이내' AS install_schedule_text, CASE WHEN k % 5 = 0 THEN '설계 검토' END AS project_stage,
 CASE k % 4 WHEN 0 THEN (k % 9 + 1) * 10000000 WHEN 3 THEN (k % 9 + 1) * 100000000 END AS budget_min,
 CASE k % 4 WHEN 0 THEN (k % 9 + 2) * 10000000 WHEN 1 THEN (k % 9 + 1) * 100000000 WHEN 2 THEN (k % 90 + 10) * 10000 ELSE (CASE WHEN k % 5 = 0 THEN 6 ELSE 7 END) END AS budget_max,
 (1 + k % 2)::INT AS product_count, 'LED 전광판 P' || (k % 4 + 1) || '.5' AS name1, k % 4 + 1.5::DOUBLE AS pitch1, 4000 + k % 900 AS width1, 2000 + k % 700 AS height1,
 '커브드' AS type1, 'LED 전광판' AS kind1, CASE WHEN k % 2 = 1 THEN 55.0 END::DOUBLE AS inch2, CASE WHEN k % 2 = 1 THEN k % 3 + 2 END AS rows2, CASE WHEN k % 2 = 1 THEN k % 4 + 2 END AS cols2,
 CASE WHEN k % 2 = 1 THEN '비디오월 55인치' END AS name2, CASE WHEN k % 2 = 0 THEN '현장실사 필요|야간 작업' ELSE '현장실사 필요' END AS notes,
 CASE WHEN k % 2 = 1 THEN 'LED 전광판|커브드|비디오월|설치' ELSE 'LED 전광판|커브드|설치' END AS keywords FROM c""",
}
