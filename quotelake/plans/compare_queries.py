"""Registered comparison queries with their plain-SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import compare as c
from quotelake.operators.scale import hot_keys
from quotelake.plans.check_queries import typed_lines
from quotelake.plans.mart_sql import with_marts
from quotelake.plans.ranking_queries import BY_GROUP, BY_PROJECT, GROUP, PARTS, ranked_sql, scored_by_group, scored_by_project
from quotelake.sources import marts as m

BUCKET_COLS = [f"{b}_{s}" for b in c.v.BUCKETS for s in ("amount", "status")]


def breakdown_of(spark, d):
    scored = scored_by_project(spark, d).withColumn(
        "context",
        F.concat_ws(" ", F.coalesce("notes_raw", F.lit("")), F.array_join("check_required", " "), F.array_join("rule_warnings", " ")))
    items = c.cost_items(typed_lines(spark, d))
    return c.cost_breakdown(scored.select("project_id", "quote_id", "context"), items)


def cost_breakdown(spark, d):
    return breakdown_of(spark, d).select("quote_id", *BUCKET_COLS)


def cost_items(spark, d):
    return c.cost_items(typed_lines(spark, d)).select("quote_id", "name", "category", "bucket", "amount")


def with_total(rows):
    confirmed, text = c.total_section(F.col("check_required"))
    return rows.withColumn("is_confirmed", confirmed).withColumn("total_display", text)


def compare_highlights(spark, d):
    rows = with_total(scored_by_group(spark, d))
    both = c.highlights(c.highlights(rows, GROUP, "_in_group"), ["project_id"], "_overall")
    return both.select(
        "project_id", "product_group", "quote_id", "is_confirmed", "total_display",
        *[f"{n}{s}" for n in ("is_lowest_total_price", "is_fastest_delivery", "is_longest_warranty", "is_highest_score")
          for s in ("_in_group", "_overall")])


def top3(spark, d):
    from quotelake.operators.ranking import top_quotes

    return top_quotes(scored_by_project(spark, d), ["project_id"], 3)


def relative_position(spark, d):
    return c.relative_position(top3(spark, d), ["project_id"]).select(
        "project_id", "quote_id", "rank", *c.POSITION_FLAGS)


def representative_item(spark, d):
    li = typed_lines(spark, d).withColumn("line_order", m.line_key())
    q = m.quotes(spark, d).select("quote_id", m.product_group_of(F.col("product_type")).alias("product_group"))
    return c.representative_line(li.join(q, "quote_id"), F.col("product_group")).select(
        "quote_id", "name", "category", "total_price", "spec_raw")


def vendor_option_no(spark, d):
    rows = scored_by_project(spark, d).withColumn("vendor_name", F.coalesce("vendor_name", F.lit("공급사명 확인 필요")))
    hot = hot_keys(m.quotes(spark, d).withColumn("vendor_name", F.coalesce("vendor_name", F.lit("공급사명 확인 필요"))), ["project_id", "vendor_name"])
    return c.vendor_options(rows, ["project_id"], hot).select(
        "project_id", "quote_id", "vendor_name", "option_no", "option_count", "display_name")


def compare_table(spark, d):
    """Top ten rows per project (explicitly chosen quotes where the project names some) with texts and badges."""
    from quotelake.operators.ranking import rank_quotes

    ranked = rank_quotes(scored_by_project(spark, d), ["project_id"], hot_keys(m.quotes(spark, d), ["project_id"]))
    wanted = m.table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("quote_id"))
    chosen = c.first_per_quote(c.select_rows(ranked, wanted, 10), ["project_id"])
    rows = c.highlights(with_total(c.conditions(chosen)), ["project_id"])
    hot = hot_keys(m.quotes(spark, d), ["project_id"])
    return c.display_order(c.badges(rows), ["project_id"], hot, 8, F.col("chosen")).select(
        "project_id", "quote_id", "position", "rank", "final_score", "delivery_text", "warranty_display", "as_method",
        "total_display", F.array_join("badges", "|").alias("badges"), "strength_text", "weakness_text")


def compare_cells(spark, d):
    """Cost cells with manual overrides on top, rows missing everywhere hidden."""
    cells = c.bucket_cells(breakdown_of(spark, d))
    manual = m.table(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(
        F.col("o_orderkey").alias("supplier_id"), F.lit("콘텐츠").alias("row_label"), F.lit("확인함").alias("value"))
    return c.visible_rows(c.apply_overrides(cells, manual)).select("project_id", "supplier_id", "row_label", "value", "status")


def installation_included(spark, d):
    li = typed_lines(spark, d)
    scores = scored_by_project(spark, d).select("project_id", "quote_id", "installation_score", "notes_raw", "has_install")
    return c.installation_included(li, scores).select(
        "project_id", "quote_id", "installation_included",
        c.install_from_notes(F.col("notes_raw"), F.col("has_install")).alias("included_by_notes"))


def visible_notes(spark, d):
    visible, internal = c.split_notes(F.col("check_required"))
    return scored_by_project(spark, d).select(
        "quote_id", F.array_join(visible, "|").alias("visible"), F.array_join(internal, "|").alias("internal"))


QUERIES = {
    "cost_breakdown": cost_breakdown,
    "cost_items": cost_items,
    "compare_highlights": compare_highlights,
    "relative_position": relative_position,
    "representative_item": representative_item,
    "vendor_option_no": vendor_option_no,
    "compare_table": compare_table,
    "compare_cells": compare_cells,
    "installation_included": installation_included,
    "visible_notes": visible_notes,
}

BUCKET = "CASE line_seq WHEN 1 THEN 'display_hw' WHEN 2 THEN 'materials' WHEN 3 THEN 'materials' WHEN 4 THEN 'system_equipment' WHEN 5 THEN 'software' WHEN 6 THEN 'installation' ELSE 'travel_expense' END"
USED = {"display_hw": "1", "system_equipment": "4", "installation": "6", "materials": "2, 3", "travel_expense": "7", "etc": "0", "software": "5", "content": "0"}


def _bucket_sql(b: str) -> str:
    seqs = USED[b]
    start = "'to_be_discussed'" if b == "travel_expense" else "'missing'"
    zero = ", 0" if b in ("etc", "software", "content") else ""
    marks = {
        # the context always carries a separation word when one of these notes is present
        "installation": "(sep AND (contains(ctx, '설치') OR contains(ctx, '시공')))",
        "travel_expense": "(sep AND contains(ctx, '출장'))",
        "software": "(sep AND contains(ctx, '소프트웨어'))",
    }
    sep = marks.get(b, "false")
    return (f"coalesce(a.{b}_sum{zero}) AS {b}_amount, CASE WHEN coalesce(a.{b}_n, 0) > 0 THEN 'included' WHEN {sep} THEN 'separate' ELSE {start} END AS {b}_status"
            if zero else f"a.{b}_sum AS {b}_amount, CASE WHEN coalesce(a.{b}_n, 0) > 0 THEN 'included' WHEN {sep} THEN 'separate' ELSE {start} END AS {b}_status")


BREAKDOWN = """,
agg AS (SELECT quote_id AS aq, """ + ", ".join(
    f"CAST(sum(CASE WHEN line_seq IN ({s}) THEN total_price END) AS BIGINT) AS {b}_sum, count(CASE WHEN line_seq IN ({s}) THEN 1 END) AS {b}_n" for b, s in USED.items()
) + """ FROM lines GROUP BY quote_id),
ctx AS (SELECT *, notes || ' ' || check_required || ' ' || concat_ws(' ', CASE WHEN NOT partner_found THEN '파트너 마스터 미등록' END,
   CASE WHEN is_excluded THEN '제외 파트너 견적서' END, CASE WHEN wide THEN '가격 차이 5% 초과' END) AS ctx FROM ranked),
sepq AS (SELECT *, contains(ctx, '별도') OR contains(ctx, '미포함') OR contains(ctx, '제외') AS sep FROM ctx),
brk AS (SELECT project_id, quote_id, """ + ", ".join(_bucket_sql(b) for b in USED) + " FROM sepq LEFT JOIN agg a ON quote_id = aq)"
TOTAL = """,
tot AS (SELECT *, coalesce(total_with_vat, 0) <> 0 AND NOT (contains(check_required, '금액') OR contains(check_required, '가격'))
  AND coalesce(nullif(total_supply_price, 0), nullif(total_with_vat, 0)) IS NOT NULL AS is_confirmed,
 coalesce(format('{:,}', coalesce(nullif(total_supply_price, 0), nullif(total_with_vat, 0))) || '원', '미확정') AS total_display FROM ranked)"""


def _high(keys: str, s: str) -> str:
    w = f"OVER (PARTITION BY {keys})"
    return (f"is_confirmed AND coalesce(total_with_vat = min(CASE WHEN is_confirmed THEN total_with_vat END) {w}, false) AS is_lowest_total_price{s}, "
            f"coalesce(delivery_weeks = min(delivery_weeks) {w}, false) AS is_fastest_delivery{s}, "
            f"coalesce(warranty_months = max(warranty_months) {w}, false) AS is_longest_warranty{s}, "
            f"coalesce(final_score = max(final_score) {w}, false) AS is_highest_score{s}")


W3 = "OVER (PARTITION BY project_id)"
LABELS = ("[{'l': '디스플레이 H/W', 'v': CAST(display_hw_amount AS VARCHAR), 's': display_hw_status}, {'l': '시스템 장비', 'v': CAST(system_equipment_amount AS VARCHAR), 's': system_equipment_status}, "
          "{'l': '설치 공사비', 'v': CAST(installation_amount AS VARCHAR), 's': installation_status}, {'l': '자재비(케이블·브라켓 등)', 'v': CAST(materials_amount AS VARCHAR), 's': materials_status}, "
          "{'l': '출장비', 'v': CAST(travel_expense_amount AS VARCHAR), 's': travel_expense_status}, {'l': '기타', 'v': CAST(etc_amount AS VARCHAR), 's': etc_status}, "
          "{'l': '소프트웨어', 'v': CAST(software_amount AS VARCHAR), 's': software_status}, {'l': '콘텐츠', 'v': CAST(content_amount AS VARCHAR), 's': content_status}]")
ORACLE = {
    "cost_breakdown": with_marts(ranked_sql(BY_PROJECT) + BREAKDOWN + f" SELECT quote_id, {', '.join(BUCKET_COLS)} FROM brk", *PARTS),
    "cost_items": with_marts(f" SELECT quote_id, name, category, {BUCKET} AS bucket, total_price AS amount FROM lines", PARTS[0]),
    "compare_highlights": with_marts(ranked_sql(BY_GROUP) + TOTAL + f""" SELECT project_id, product_group, quote_id, is_confirmed, total_display,
 {_high(BY_GROUP, '_in_group')}, {_high(BY_PROJECT, '_overall')} FROM tot""", *PARTS),
    "relative_position": with_marts(ranked_sql(BY_PROJECT) + " SELECT project_id, quote_id, rank, " + ", ".join(
        f"coalesce({col} = {'max' if agg is F.max else 'min'}({col}) {W3}, false) AS {flag}" for flag, (col, agg) in c.POSITION_FLAGS.items()
    ) + " FROM (SELECT * FROM ranked WHERE rank <= 3)", *PARTS),
    "representative_item": with_marts(""", rp AS (SELECT l.*, row_number() OVER (PARTITION BY l.quote_id ORDER BY
   CASE WHEN product_type = 'SMALL' THEN (CASE WHEN contains(lower(name), '비디오월') THEN 0 ELSE 2 END)
        WHEN product_type = 'STANDARD' THEN (CASE WHEN contains(lower(name), 'led') OR contains(name, '전광판') THEN 0 ELSE 2 END) ELSE 2 END,
   total_price DESC, length(l.spec_raw) DESC, line_no) AS rn FROM lines l JOIN quotes q ON l.quote_id = q.quote_id WHERE line_seq = 1)
 SELECT quote_id, name, category, total_price, spec_raw FROM rp WHERE rn = 1""", *PARTS[:2]),
    "vendor_option_no": with_marts(ranked_sql(BY_PROJECT) + """, vo AS (SELECT project_id, quote_id, coalesce(vendor_name, '공급사명 확인 필요') AS vendor_name, final_score, input_no FROM ranked),
 vn AS (SELECT *, row_number() OVER (PARTITION BY project_id, vendor_name ORDER BY final_score DESC, input_no) AS option_no, count(*) OVER (PARTITION BY project_id, vendor_name) AS option_count FROM vo)
 SELECT project_id, quote_id, vendor_name, option_no, option_count, CASE WHEN option_count > 1 THEN vendor_name || ' ' || option_no || '안' ELSE vendor_name END AS display_name FROM vn""", *PARTS),
    "compare_table": with_marts(ranked_sql(BY_PROJECT) + TOTAL + f""",
 wanted AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
 pick AS (SELECT * FROM (SELECT *, project_id IN (SELECT o_custkey FROM wanted) AS chosen FROM tot) WHERE CASE WHEN chosen THEN quote_id IN (SELECT o_orderkey FROM wanted) ELSE rank <= 10 END),
 hl AS (SELECT *, {_high(BY_PROJECT, '')}, row_number() OVER (PARTITION BY project_id ORDER BY final_score DESC, input_no) AS position FROM pick)
 SELECT project_id, quote_id, position, rank, final_score,
  coalesce(delivery_basis_raw, delivery_weeks || '주', '미기재') AS delivery_text,
  coalesce(warranty_months || '개월', '미기재') || (CASE WHEN warranty_months IS NOT NULL AND contains(notes, '출장실비') THEN ', 출장실비 별도' ELSE '' END) AS warranty_display,
  CASE WHEN contains(notes, '현장 방문') OR contains(notes, '방문 A/S') OR contains(notes, '출장') THEN '현장 방문' WHEN contains(notes, '택배') OR contains(notes, '입고') OR contains(notes, '센터') THEN '택배/입고 수리' ELSE '미기재' END AS as_method,
  total_display,
  coalesce(nullif(concat_ws('|', CASE WHEN is_lowest_total_price THEN '최저가' END, CASE WHEN is_fastest_delivery THEN '납기 우위' END, CASE WHEN is_premium THEN '프리미엄 파트너' END, CASE WHEN NOT is_confirmed THEN '총액 미확정' END), ''), '검토 대상') AS badges,
  coalesce(nullif(concat_ws(', ', CASE WHEN is_lowest_total_price THEN '가격 경쟁력' END, CASE WHEN is_fastest_delivery THEN '납기 우위' END, CASE WHEN is_longest_warranty THEN '보증 조건 우수' END, CASE WHEN is_premium THEN '프리미엄 파트너' END), ''), '조건 확인 후 판단 가능') AS strength_text,
  coalesce(nullif(concat_ws(', ', nullif(replace(check_required, '|', ', '), ''), CASE WHEN NOT partner_found THEN '파트너 마스터 미등록' END, CASE WHEN is_excluded THEN '제외 파트너 견적서' END, CASE WHEN wide THEN '가격 차이 5% 초과' END), ''), '특이 단점 없음') AS weakness_text
 FROM hl WHERE position <= 8 OR chosen""", *PARTS),
    "compare_cells": with_marts(ranked_sql(BY_PROJECT) + BREAKDOWN + f""",
 cl AS (SELECT project_id, quote_id AS supplier_id, unnest({LABELS}) AS c FROM brk),
 ov AS (SELECT project_id, supplier_id, c.l AS row_label, CASE WHEN c.l = '콘텐츠' AND supplier_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW') THEN '확인함' ELSE c.v END AS value,
   CASE WHEN c.l = '콘텐츠' AND supplier_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW') THEN NULL ELSE c.s END AS status FROM cl)
 SELECT project_id, supplier_id, row_label, value, status FROM (SELECT *, bool_or(status IS NULL OR status <> 'missing') OVER (PARTITION BY project_id, row_label) AS shown FROM ov) WHERE shown""", *PARTS),
    "installation_included": with_marts(ranked_sql(BY_PROJECT) + """, il AS (SELECT DISTINCT quote_id AS iq FROM lines WHERE line_seq = 6 AND total_price > 0)
 SELECT project_id, quote_id, iq IS NOT NULL OR installation_score >= 80 AS installation_included, CASE WHEN has_install THEN true END AS included_by_notes FROM ranked LEFT JOIN il ON quote_id = iq""", *PARTS),
    "visible_notes": with_marts(ranked_sql(BY_PROJECT) + """ SELECT quote_id, array_to_string(list_filter(string_split(check_required, '|'), lambda x: x <> '요구 납기 정규화 필요'), '|') AS visible,
 CASE WHEN contains(check_required, '요구 납기 정규화 필요') THEN '요구 납기 정규화 필요' ELSE '' END AS internal FROM ranked""", *PARTS),
}
