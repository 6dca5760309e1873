"""Registered product-group and classification queries with their plain-SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.functions.groups import canonical_group, canonical_solution
from quotelake.functions.rules import reclassify
from quotelake.operators import groups as g
from quotelake.operators.ranking import run_counters as count_run
from quotelake.plans.check_queries import named_quotes
from quotelake.plans.mart_sql import LINES, QUOTES, REQUIREMENTS, with_marts
from quotelake.sources import marts as m
from quotelake.sources.intake import screen_candidates


def grouped(spark, d):
    return g.quote_groups(named_quotes(spark, d), m.lines(spark, d))


def reqs(spark, d):
    return g.requirement_groups(m.requirements(spark, d), ["category", "request_summary"], ["required_keywords"])


def product_group_classify(spark, d):
    """Groups of every quote, its primary group and the fixed display order."""
    return g.competing_groups(grouped(spark, d)).select(
        "quote_id", F.array_join("product_groups", "|").alias("product_groups"), "product_group", "group_order")


def dominant_product_group(spark, d):
    return g.dominant_group(grouped(spark, d))


def product_group_scope(spark, d):
    return g.product_group_scope(grouped(spark, d), reqs(spark, d)).select(
        "project_id", "quote_id", "source", F.array_join("selected_groups", "|").alias("selected_groups"),
        "included", "uncertain", "fallback_used", "exclusion_reason")


def group_counts(spark, d):
    return g.group_counts(g.competing_groups(grouped(spark, d)))


def split_parent_dropped(spark, d):
    """The quotes of one order status also exist as two option children."""
    base = m.quotes(spark, d).select(F.col("quote_id").cast("string").alias("quote_id"), "project_id")
    split = m.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("quote_id"))
    parents = base.join(split, "quote_id", "left_semi")
    kids = parents.withColumn("no", F.explode(F.array(F.lit("1"), F.lit("2")))).select(
        F.concat("quote_id", F.lit("_opt"), "no").alias("quote_id"),
        "project_id", F.col("quote_id").alias("parent_quote_id"))
    return g.drop_split_parents(base.withColumn("parent_quote_id", F.lit(None).cast("string")).unionByName(kids))


def run_counters(spark, d):
    valid = screen_candidates(m.quotes(spark, d))
    return count_run(valid, g.product_group_scope(grouped(spark, d), reqs(spark, d)))


def classify_lines(spark, d):
    """Category and cost type re-derived from names; every second line starts as ETC."""
    before = F.when(F.col("part_key") % 2 == 0, F.col("category")).otherwise("ETC")
    li = m.lines(spark, d).withColumn("before", before)
    return reclassify(li, before="before", out="r").select(
        "quote_id", "line_seq", "part_key", "before", F.coalesce("r.category", "before").alias("after"),
        F.col("r.cost_type").alias("cost_type"), F.col("r.reason").alias("reason"))


def text_to_solution(spark, d):
    """Canonical solution and product group of every line name, aggregated."""
    li = m.lines(spark, d)
    return li.select(
        canonical_solution(F.col("name")).alias("solution"), canonical_group(F.col("name")).alias("product_group"),
    ).groupBy("solution", "product_group").agg(F.count("*").alias("n"))


QUERIES = {
    "product_group_classify": product_group_classify,
    "dominant_product_group": dominant_product_group,
    "product_group_scope": product_group_scope,
    "group_counts": group_counts,
    "split_parent_dropped": split_parent_dropped,
    "run_counters": run_counters,
    "classify_lines": classify_lines,
    "text_to_solution": text_to_solution,
}

G = """CASE p_type WHEN 'STANDARD' THEN 'LED전광판' WHEN 'SMALL' THEN '비디오월' WHEN 'ECONOMY' THEN '사이니지'
 WHEN 'MEDIUM' THEN '투명디스플레이' WHEN 'PROMO' THEN '키오스크' WHEN 'LARGE' THEN '디스플레이' END"""
RANK = """CASE {0} WHEN '투명디스플레이' THEN 0 WHEN '비디오월' THEN 1 WHEN 'LED전광판' THEN 2 WHEN '사이니지' THEN 3 WHEN '키오스크' THEN 4 WHEN '미분류' THEN 6 ELSE 5 END"""
GROUPED = f""",
qg AS (SELECT DISTINCT quote_id, {G} AS grp FROM lines WHERE line_seq = 1),
gq AS (SELECT q.quote_id, q.project_id, q.vendor_name, q.line_count, count(grp) AS n,
  coalesce(string_agg(grp, '|' ORDER BY grp), '') AS product_groups,
  CASE WHEN count(grp) = 0 THEN '미분류' WHEN count(grp) = 1 THEN max(grp) WHEN bool_or(grp = '비디오월') THEN '비디오월'
   WHEN bool_or(grp = 'LED전광판') THEN 'LED전광판' WHEN bool_or(grp = '디스플레이') THEN '디스플레이'
   ELSE arg_min(grp, {RANK.format('grp')}) END AS product_group
  FROM quotes q LEFT JOIN qg ON q.quote_id = qg.quote_id GROUP BY 1, 2, 3, 4)"""
DOMINANT = """,
pg AS (SELECT project_id, grp, count(*) AS c FROM gq JOIN qg USING (quote_id) GROUP BY 1, 2),
pt AS (SELECT project_id, arg_max(grp, c) AS grp, max(c) AS top, sum(c) AS known, coalesce((list_sort(list(c), 'DESC'))[2], 0) AS second FROM pg GROUP BY 1),
dom AS (SELECT p.project_id, CASE WHEN top > second AND (top >= 2 OR top / known >= 0.6::DOUBLE) THEN grp END AS selected_group,
  coalesce(top, 0) AS top_count, CAST(coalesce(known, 0) AS BIGINT) AS known_count, known IS NULL AS nothing
  FROM (SELECT DISTINCT project_id FROM quotes) p LEFT JOIN pt USING (project_id))"""
SCOPE = DOMINANT + """,
rg AS (SELECT project_id, list_sort(list_distinct(list_filter([
  CASE category WHEN '키오스크 도입' THEN '키오스크' WHEN 'LED 전광판 교체' THEN 'LED전광판' WHEN '로비 비디오월' THEN '비디오월' WHEN '디지털 사이니지' THEN '사이니지' END,
  CASE WHEN project_id % 4 = 0 THEN '비디오월' END, CASE project_id % 6 WHEN 0 THEN '투명디스플레이' WHEN 1 THEN '키오스크' END], lambda x: x IS NOT NULL))) AS rg FROM reqs),
sc AS (SELECT gq.project_id, gq.quote_id, gq.n, product_groups, CASE WHEN len(rg) > 0 THEN 'requirement' WHEN selected_group IS NOT NULL THEN 'quote_pool_dominant_group' ELSE 'quote_pool_ambiguous' END AS source,
  CASE WHEN len(rg) > 0 THEN rg WHEN selected_group IS NOT NULL THEN [selected_group] ELSE [] END AS sel
  FROM gq JOIN rg USING (project_id) JOIN dom USING (project_id)),
sm AS (SELECT *, len(sel) = 0 OR n = 0 OR list_has_any(string_split(product_groups, '|'), sel) AS m FROM sc),
scope AS (SELECT *, bool_or(m) OVER (PARTITION BY project_id) AS any_m FROM sm)"""
P = (LINES, QUOTES, REQUIREMENTS)
ORACLE = {
    "product_group_classify": with_marts(GROUPED + f" SELECT quote_id, product_groups, product_group, {RANK.format('product_group')} AS group_order FROM gq", *P),
    "dominant_product_group": with_marts(GROUPED + DOMINANT + """ SELECT project_id, selected_group, top_count, known_count, selected_group IS NULL AS selection_required,
 CASE WHEN nothing THEN '비교 제품군 정보가 없습니다.' WHEN selected_group IS NULL THEN '비교 제품군을 자동 결정할 수 없음' END AS reason FROM dom""", *P),
    "product_group_scope": with_marts(GROUPED + SCOPE + """ SELECT project_id, quote_id, source, array_to_string(sel, '|') AS selected_groups, m OR NOT any_m AS included,
 (m OR NOT any_m) AND n = 0 AND len(sel) > 0 AS uncertain, NOT any_m AS fallback_used,
 CASE WHEN NOT (m OR NOT any_m) THEN (CASE WHEN source = 'requirement' THEN '고객 요구사항의 비교 제품군과 불일치' ELSE '다른 업로드 견적서의 주요 제품군과 불일치' END) END AS exclusion_reason FROM scope""", *P),
    "group_counts": with_marts(GROUPED + """ SELECT project_id, product_group, count(*) AS quote_count, grouping(project_id, product_group)::INT AS level
 FROM gq GROUP BY ROLLUP (project_id, product_group)""", *P),
    "split_parent_dropped": """SELECT CAST(o_orderkey AS VARCHAR) AS quote_id, o_custkey AS project_id, NULL::VARCHAR AS parent_quote_id FROM orders WHERE o_orderstatus <> 'P'
 UNION ALL SELECT o_orderkey || '_opt' || k, o_custkey, CAST(o_orderkey AS VARCHAR) FROM orders, (VALUES ('1'), ('2')) t(k) WHERE o_orderstatus = 'P'""",
    "run_counters": with_marts(GROUPED + SCOPE + """ SELECT project_id, count(CASE WHEN q.vendor_name IS NOT NULL OR q.line_count > 0 THEN 1 END) AS candidate_count,
 count(CASE WHEN q.vendor_name IS NULL AND q.line_count = 0 THEN 1 END) AS failed_candidate_count, count(CASE WHEN NOT (m OR NOT any_m) THEN 1 END) AS filtered_candidate_count
 FROM scope JOIN quotes q USING (project_id, quote_id) GROUP BY project_id""", *P),
    "classify_lines": with_marts("""SELECT quote_id, line_seq, part_key, CASE WHEN part_key % 2 = 0 THEN category ELSE 'ETC' END AS before,
 CASE WHEN line_seq = 1 AND part_key % 2 = 1 AND p_type IN ('MEDIUM', 'PROMO', 'LARGE') THEN 'ETC' ELSE category END AS after,
 CASE line_seq WHEN 1 THEN (CASE WHEN part_key % 2 = 1 AND p_type IN ('MEDIUM', 'PROMO', 'LARGE') THEN NULL ELSE 'DISPLAY' END) WHEN 2 THEN 'MATERIALS'
  WHEN 3 THEN 'MATERIALS' WHEN 4 THEN 'SYSTEM_EQUIPMENT' WHEN 5 THEN 'SOFTWARE' WHEN 6 THEN 'INSTALL' ELSE 'TRAVEL' END AS cost_type,
 CASE line_seq WHEN 1 THEN (CASE WHEN p_type = 'SMALL' THEN 'item_name priority keyword' WHEN part_key % 2 = 0 THEN 'preserve existing display classification'
   WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'display keyword' END) WHEN 2 THEN 'item_name functional mount keyword' WHEN 3 THEN 'item_name functional material keyword'
  WHEN 4 THEN 'item_name functional system equipment keyword' WHEN 5 THEN 'item_name functional software keyword'
  WHEN 6 THEN 'item_name functional install keyword' ELSE 'item_name functional travel keyword' END AS reason FROM lines""", LINES),
    "text_to_solution": with_marts(f"""SELECT nullif(CASE WHEN line_seq = 1 THEN {G} END, '디스플레이') AS solution, CASE WHEN line_seq = 1 THEN {G} END AS product_group, count(*) AS n
 FROM lines GROUP BY 1, 2""", LINES),
}
