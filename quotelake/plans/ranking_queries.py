"""Registered ranking queries and their plain-SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import ranking as r
from quotelake.operators.contain import few_enough
from quotelake.operators.scale import hot_keys, position, rank_all
from quotelake.plans.mart_sql import CORE, GROUP_CASE, PARTNERS, case, r2, with_marts
from quotelake.sources import marts as m

GROUP = ["project_id", "product_group"]


def _inputs(spark, d):
    vectors = m.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return m.quotes(spark, d), m.requirements(spark, d), vectors, m.partners(spark, d)


def grouped_quotes(spark, d):
    return m.quotes(spark, d).withColumn("product_group", m.product_group_of(F.col("product_type")))


def build_standing(spark, d):
    """Every quote next to its request, partner and the lowest prices it competes with: all that scores are made of.

    Lowest prices come as one row of a project, those of its few groups as a map, so that quotes meet them and their
    request in one shuffle by project; it is a join's own, which Spark splits where a project is large.
    """
    _, req, vec, par = _inputs(spark, d)
    quotes = grouped_quotes(spark, d)
    lowest = r.lowest_prices(quotes, GROUP).groupBy("project_id").agg(
        F.min("lowest_price").alias("lowest_in_project"),
        F.map_from_entries(F.collect_list(F.struct("product_group", "lowest_price"))).alias("_lowest"))
    priced = quotes.join(lowest, "project_id", "left").withColumn(
        "lowest_in_group", F.try_element_at("_lowest", F.col("product_group"))).drop("_lowest")
    rows = r.compare_inputs(priced, req, vec, par, r.few_vectors(vec), few_enough(par, "name"))
    facts = [f"partner.{name}" for name in ("is_premium", "success_rate", "response_speed", "financial_status", "is_excluded")]
    return rows.withColumn("partner", F.when(F.col("partner_found"), F.struct(*facts))).drop("partner_key")


def standing(spark, d):
    """The rows of :func:`build_standing`, written once: scores are a narrow pass over them, whatever the query does next."""
    return m.stored(spark, d, "standing", build_standing)


def scored_by_project(spark, d):
    rows = standing(spark, d).withColumnRenamed("lowest_in_project", "lowest_price")
    return r.score_compared(rows.drop("lowest_in_group", "product_group"))


def scored_by_group(spark, d):
    rows = standing(spark, d).withColumnRenamed("lowest_in_group", "lowest_price")
    return r.score_compared(rows.drop("lowest_in_project"))


SCORE_COLS = [
    "project_id", "quote_id", "rank", "final_score", "spec_score", "price_score", "delivery_score",
    "warranty_score", "installation_score",
]


def rank_top3_quotes(spark, d):
    return r.top_quotes(scored_by_project(spark, d), ["project_id"], 3).select(*SCORE_COLS)


def ranked_by_group(spark, d):
    hot = hot_keys(grouped_quotes(spark, d), GROUP)
    return r.rank_quotes(scored_by_group(spark, d), GROUP, hot)


def rank_all_in_product_group(spark, d):
    return ranked_by_group(spark, d).select(
        *SCORE_COLS, "product_group", "is_premium", "partner_found",
        F.array_join("comparison_risks", "|").alias("comparison_risks"),
        F.array_join("rule_warnings", "|").alias("rule_warnings"),
        F.array_join("matched_rules", "|").alias("matched_rules"),
        F.array_join("check_required", "|").alias("check_required"),
    )


def top3_per_product_group(spark, d):
    top = r.top_quotes(scored_by_group(spark, d), GROUP, 3)
    return top.select(*SCORE_COLS, "product_group")


def rank_score_consistency(spark, d):
    """Check an older ranking (by arrival) against today's scores."""
    scored = scored_by_project(spark, d)
    base = m.quotes(spark, d).select("project_id", "quote_id")
    hot = hot_keys(base, ["project_id"])
    stale = rank_all(
        scored, ["project_id"], position(F.col("received_at"), F.col("quote_id")),
        [F.col("received_at"), F.col("quote_id")], hot,
    ).select("project_id", "business_rule_passed", "quote_id", "rank", "final_score")
    return r.rank_score_conflicts(stale, ["project_id"]).drop("message")


def selected_partner_filter(spark, d):
    sel = m.table(spark, d, "customer").select(
        F.col("c_custkey").alias("project_id"),
        F.format_string("Supplier#%09d", F.col("c_custkey") % 50).alias("partner_name"),
    )
    return r.selected_partner_filter(m.quotes(spark, d), sel).select("project_id", "quote_id", "vendor_name")


def partner_enrich(spark, d):
    from quotelake.operators.partners import snapshot

    return snapshot(m.quotes(spark, d), m.partners(spark, d)).select(
        "quote_id", "vendor_name", "partner_found",
        F.col("vendor_snapshot.vendor_name").alias("partner_name"),
        F.col("vendor_snapshot.is_premium_partner").alias("is_premium"),
        F.col("vendor_snapshot.past_success_rate").alias("success_rate"),
        F.col("vendor_snapshot.response_speed_score").alias("response_speed_score"),
        F.col("vendor_snapshot.financial_status").alias("financial_status"),
        F.col("vendor_snapshot.installation_count").alias("installation_count"),
        F.array_join("check_required", "|").alias("check_required"),
    )


QUERIES = {
    "rank_top3_quotes": rank_top3_quotes,
    "rank_all_in_product_group": rank_all_in_product_group,
    "top3_per_product_group": top3_per_product_group,
    "rank_score_consistency": rank_score_consistency,
    "selected_partner_filter": selected_partner_filter,
    "partner_enrich": partner_enrich,
}

# ------------------------------------------------------------------------ oracle SQL

NORM = "lower(regexp_replace(regexp_replace(coalesce({0}, ''), '(?i)\\(주\\)|㈜|주식회사|주\\)', '', 'g'), '[^0-9A-Za-z가-힣]', '', 'g'))"
CLAMP = "greatest(0.0, least(100.0, {0}))"


def scored_sql(keys: str, group: bool = False) -> str:
    """CTEs ``q0`` (quotes with price and group) .. ``scored``."""
    return f""",
q0 AS (SELECT *, CASE WHEN total_supply_price > 0 THEN total_supply_price ELSE priced_sum END AS price,
  {GROUP_CASE} AS product_group FROM quotes),
q1 AS (SELECT *, min(CASE WHEN price > 0 THEN price END) OVER (PARTITION BY {keys}) AS lowest_price FROM q0),
pidx AS (SELECT *, {NORM.format('name')} AS pkey, row_number() OVER (PARTITION BY {NORM.format('name')} ORDER BY supp_key DESC) AS prn FROM partners),
q2 AS (
 SELECT q1.*, r.budget_max, r.install_schedule_text, r.required_weeks, r.target_months,
  greatest(-1.0, least(1.0, list_dot_product(rv.vec, qv.vec)
   / (sqrt(list_dot_product(rv.vec, rv.vec)) * sqrt(list_dot_product(qv.vec, qv.vec))))) AS cos,
  qv.vec IS NULL AS no_vec, p.name IS NOT NULL AS partner_found, coalesce(p.is_premium, false) AS is_premium,
  coalesce(p.success_rate, 0.0) AS success_rate, coalesce(p.is_excluded, false) AS is_excluded,
  p.response_speed, coalesce({case('p.response_speed', {'fast': 3, 'normal': 2, 'slow': 1})}, 0) AS speed_ordinal,
  coalesce({case('p.financial_status', {'good': 3, 'normal': 2, 'caution': 1, 'bad': 0})}, 0) AS finance_ordinal,
  regexp_replace(coalesce(notes_raw, ''), '[\\s|]+', '', 'g') AS cnotes, coalesce(notes_raw, '') AS notes
 FROM q1 JOIN reqs r ON q1.project_id = r.project_id
 LEFT JOIN vecs rv ON r.vec_id = rv.vec_id LEFT JOIN vecs qv ON q1.vec_id = qv.vec_id
 LEFT JOIN (SELECT * FROM pidx WHERE prn = 1) p ON {NORM.format('q1.vendor_name')} = p.pkey),
q3 AS (
 SELECT *, coalesce(price > 0 AND lowest_price IS NOT NULL, false) AS priced,
  has_install AND (cnotes LIKE '%설치비:미포함%' OR cnotes LIKE '%설치비미포함%' OR cnotes LIKE '%설치비:별도%'
   OR cnotes LIKE '%설치비별도%' OR cnotes LIKE '%시공비별도%') AS conflict,
  notes LIKE '%설치비 별도%' OR notes LIKE '%시공비 별도%' AS separate,
  install_schedule_text IS NOT NULL AS sched, coalesce(delivery_basis_raw = '별도협의', false) AS talk
 FROM q2),
q4 AS (
 SELECT *, CASE WHEN no_vec THEN 50.0 ELSE {CLAMP.format('(cos + 1.0) / 2.0 * 100.0')} END AS s1,
  CASE WHEN priced THEN {CLAMP.format('lowest_price / price * 100.0 - (CASE WHEN coalesce(price > budget_max, false) THEN 10.0 ELSE 0.0 END)')} ELSE 50.0 END AS s2,
  CASE WHEN NOT sched THEN 100.0 WHEN required_weeks IS NULL THEN 70.0 WHEN talk THEN 70.0
   WHEN delivery_weeks IS NULL THEN 50.0 WHEN delivery_weeks <= required_weeks THEN 100.0
   ELSE {CLAMP.format('required_weeks / delivery_weeks * 100.0')} END AS s3,
  CASE WHEN warranty_months IS NULL THEN 50.0 WHEN warranty_months >= target_months THEN 100.0
   ELSE {CLAMP.format('warranty_months / target_months * 100.0')} END AS s4,
  CASE WHEN conflict THEN 100.0 WHEN separate THEN 0.0 WHEN has_install THEN 100.0 ELSE 0.0 END AS s5,
  (price - lowest_price) / lowest_price AS gap FROM q3),
scored AS (
 SELECT *, {r2(CLAMP.format('s1 * 0.3::DOUBLE + s2 * 0.3::DOUBLE + s3 * 0.2::DOUBLE + s4 * 0.1::DOUBLE + s5 * 0.1::DOUBLE'))} AS final_score,
  {r2('s1')} AS spec_score, {r2('s2')} AS price_score, {r2('s3')} AS delivery_score, {r2('s4')} AS warranty_score,
  {r2('s5')} AS installation_score, coalesce(price <> 0 AND gap > 0.05, false) AS wide,
  concat_ws('|', CASE WHEN no_vec THEN '견적서 임베딩 없음' END,
   CASE WHEN NOT priced THEN '가격 비교 정보 부족' END, CASE WHEN priced AND price > budget_max THEN '예산 초과' END,
   CASE WHEN sched AND required_weeks IS NULL THEN '요구 납기 정규화 필요' END,
   CASE WHEN sched AND required_weeks IS NOT NULL AND talk THEN '납기 별도협의' END,
   CASE WHEN sched AND required_weeks IS NOT NULL AND NOT talk AND delivery_weeks IS NULL THEN '견적 납기 미기재' END,
   CASE WHEN warranty_months IS NULL THEN '보증기간 미기재' END,
   CASE WHEN conflict THEN '설치비 포함 여부 문서 내 상충 확인 필요' END,
   CASE WHEN NOT conflict AND separate THEN '설치비 별도' END,
   CASE WHEN NOT conflict AND NOT separate AND NOT has_install AND (notes LIKE '%설치%' OR notes LIKE '%시공%') THEN '설치 범위 확인 필요' END
  ) AS check_required FROM q4)"""


ORDER = ("final_score DESC, price_score DESC, spec_score DESC, is_premium DESC, success_rate DESC, "
         "speed_ordinal DESC, finance_ordinal DESC, input_no")
COLS = ("project_id, quote_id, rank, final_score, spec_score, price_score, delivery_score, warranty_score, "
        "installation_score")


def ranked_sql(keys: str) -> str:
    return scored_sql(keys) + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {ORDER}) AS rank FROM scored)"""


PARTS = (*CORE, PARTNERS)
BY_PROJECT = "project_id"
BY_GROUP = "project_id, product_group"

ORACLE = {
    "rank_top3_quotes": with_marts(
        ranked_sql(BY_PROJECT) + f" SELECT {COLS} FROM ranked WHERE rank <= 3", *PARTS),
    "top3_per_product_group": with_marts(
        ranked_sql(BY_GROUP) + f" SELECT {COLS}, product_group FROM ranked WHERE rank <= 3", *PARTS),
    "rank_all_in_product_group": with_marts(
        ranked_sql(BY_GROUP) + f""" SELECT {COLS}, product_group, is_premium, partner_found,
  CASE WHEN wide THEN '최저가 대비 가격 차이 5% 초과' ELSE '' END AS comparison_risks,
  concat_ws('|', CASE WHEN NOT partner_found THEN '파트너 마스터 미등록' END,
   CASE WHEN is_excluded THEN '제외 파트너 견적서' END, CASE WHEN wide THEN '가격 차이 5% 초과' END) AS rule_warnings,
  concat_ws('|', CASE WHEN is_premium THEN 'premium_partner' END,
   CASE WHEN success_rate >= 0.10 THEN 'high_success_rate' END,
   CASE WHEN response_speed = 'fast' THEN 'fast_response' END) AS matched_rules, check_required FROM ranked""", *PARTS),
    "rank_score_consistency": with_marts(
        scored_sql(BY_PROJECT) + """,
stale AS (SELECT project_id, quote_id, final_score, true AS business_rule_passed,
  row_number() OVER (PARTITION BY project_id ORDER BY received_at, quote_id) AS rank FROM scored),
best AS (SELECT *, max(final_score) OVER (PARTITION BY project_id ORDER BY rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_score FROM stale),
later AS (SELECT b.*, p.quote_id AS cq, p.rank AS cr,
  row_number() OVER (PARTITION BY b.project_id, b.rank ORDER BY p.rank) AS rn
  FROM best b JOIN stale p ON p.project_id = b.project_id AND p.rank < b.rank AND p.final_score = b.prev_score
  WHERE b.final_score > b.prev_score + 0.01::DOUBLE),
both_roles AS (
 SELECT project_id, business_rule_passed, quote_id, rank, final_score, cq AS compared_quote_id, cr AS compared_rank,
  prev_score AS compared_final_score, 0 AS role FROM later WHERE rn = 1
 UNION ALL
 SELECT project_id, business_rule_passed, cq, cr, prev_score, quote_id, rank, final_score, 1 FROM later WHERE rn = 1)
SELECT project_id, business_rule_passed, quote_id, rank, final_score, compared_quote_id, compared_rank, compared_final_score
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, quote_id ORDER BY role, compared_rank) AS k FROM both_roles)
WHERE k = 1""", *PARTS),
    "selected_partner_filter": with_marts(
        f""", sel AS (SELECT c_custkey AS project_id, {NORM.format("'Supplier#' || lpad(CAST(c_custkey % 50 AS VARCHAR), 9, '0')")} AS pk
  FROM customer),
flag AS (SELECT q.project_id, q.quote_id, q.vendor_name, sel.pk IS NOT NULL AS hit,
  bool_or(sel.pk IS NOT NULL) OVER (PARTITION BY q.project_id) AS any_hit
  FROM quotes q LEFT JOIN sel ON q.project_id = sel.project_id AND {NORM.format('q.vendor_name')} = sel.pk)
SELECT project_id, quote_id, vendor_name FROM flag WHERE hit OR NOT any_hit""", *PARTS),
    "partner_enrich": with_marts(
        f""", pidx AS (SELECT *, {NORM.format('name')} AS pkey, row_number() OVER (PARTITION BY {NORM.format('name')} ORDER BY supp_key DESC) AS prn FROM partners)
SELECT quote_id, vendor_name, p.name IS NOT NULL AS partner_found, p.name AS partner_name, p.is_premium, p.success_rate,
 CASE p.response_speed WHEN 'fast' THEN 100.0 WHEN 'normal' THEN 70.0 WHEN 'slow' THEN 40.0 END::DOUBLE AS response_speed_score,
 p.financial_status, p.installation_count,
 CASE WHEN p.name IS NULL THEN '파트너 마스터 매칭 필요' ELSE '' END AS check_required
FROM quotes q LEFT JOIN (SELECT * FROM pidx WHERE prn = 1) p ON {NORM.format('q.vendor_name')} = p.pkey""", *PARTS),
}
