"""Registered validation and quality queries with their plain-SQL counterparts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quotelake.functions.names import normalize_company
from quotelake.functions.rules import initial_category, reclassify
from quotelake.operators import validate as q
from quotelake.plans.mart_sql import LINES, QUOTES, with_marts
from quotelake.sources import marts as m



def named_quotes(spark, d):
    """Quotes with a project name and where it came from."""
    k = F.col("project_id")
    return (
        m.quotes(spark, d)
        .withColumn("project_name", F.when(F.col("quote_id") % 9 == 0, "").otherwise(F.concat(F.lit("현장 "), k.cast("string"), F.lit(" 구축"))))
        .withColumn("project_name_source", F.when(F.col("quote_id") % 9 == 1, "file_name_fallback").otherwise("parser"))
    )


def typed_lines(spark, d):
    """Lines with their rule-based cost type."""
    ruled = reclassify(m.lines(spark, d))
    return ruled.withColumn("cost_type", F.col("rule.cost_type")).drop("rule").withColumn("spec_parsed", F.lit(None).cast("map<string,string>"))


AMOUNT_COLS = [
    "quote_id", "calculated_total_with_vat", "difference", "expected_tax_amount", "tax_difference",
    "line_items_sum", "line_items_difference", "validation_status", "amount_message",
]


def amount_validation(spark, d):
    return q.amount_validation(m.quotes(spark, d)).select(*AMOUNT_COLS)


def initial_categories(spark, d):
    """First category of every line from its texts alone."""
    return m.lines(spark, d).select(
        "quote_id", "line_seq", "part_key", "supp_key", initial_category(F.col("name"), F.col("spec_raw")).alias("first_category"))


def line_arithmetic(spark, d):
    return q.line_arithmetic(m.lines(spark, d)).select(
        "quote_id", "line_seq", "name", "quantity", "unit_price", "total_price", "calculated_amount", "difference")


def line_sum_reconcile(spark, d):
    return q.reconcile_line_sum(m.quotes(spark, d)).select(
        "quote_id", "supply", "line_sum", "residual_amount", "reconciled_supply", "reconciled_total")


def residual_lines(spark, d):
    base = q.reconcile_line_sum(m.quotes(spark, d)).withColumn("t", m.product_group_of(F.col("product_type")))
    return q.residual_lines(base, F.col("t"))


def delivery_validation(spark, d):
    return q.delivery_validation(m.quotes(spark, d)).select(
        "quote_id", "delivery_raw", "delivery_source", "delivery_weeks", "normalized_delivery_weeks",
        "delivery_status", "delivery_message")


def issues_of(spark, d, quotes=None):
    """Issues of a run over the stored quotes, or over the given ones."""
    quotes = named_quotes(spark, d) if quotes is None else quotes
    partners = m.table(spark, d, "supplier").select(normalize_company(F.col("s_name")).alias("pk")).distinct()
    known = (
        quotes.withColumn("pk", normalize_company(F.col("vendor_name")))
        .join(partners.withColumn("partner_found", F.lit(True)), "pk", "left")
        .withColumn("partner_found", F.coalesce("partner_found", F.lit(False)))
        .withColumn("source_text", F.col("notes_raw"))
        .withColumn("is_multi_option_possible", F.lit(False))
        .drop("pk")
    )
    checked = q.delivery_validation(q.amount_validation(known))
    return q.quote_issues(checked, q.line_flags(typed_lines(spark, d)))


def quote_issues(spark, d):
    return q.check_required(issues_of(spark, d)).select(
        "quote_id", F.array_join("detected_issues", "|").alias("detected_issues"),
        F.array_join("check_required", "|").alias("check_required"))


def issue_top10(spark, d):
    return q.issue_top(issues_of(spark, d), 10)


def quality_summary(spark, d):
    return q.quality_summary(issues_of(spark, d), typed_lines(spark, d))


def quality_diff(spark, d):
    """Issues of the stored quotes and of a second run over the corrected ones."""
    return q.quality_diff(issues_of(spark, d), issues_of(spark, d, corrected_quotes(spark, d)))


def corrected_quotes(spark, d):
    """Delivery weeks taken from the text, supply and total made to fit the lines, and residuals as a line."""
    stored = named_quotes(spark, d)
    fixed = q.reconcile_line_sum(q.apply_delivery(q.delivery_validation(stored)))
    new = {
        "total_supply_price": F.col("reconciled_supply"), "total_with_vat": F.col("reconciled_total"),
        "line_sum": F.when(F.col("residual_amount").isNull(), F.col("line_sum")).otherwise(
            F.coalesce("line_sum", F.lit(0)) + F.col("residual_amount"))}
    return fixed.select(*[new.get(c, F.col(c)).alias(c) for c in stored.columns])


QUERIES = {
    "amount_validation": amount_validation,
    "initial_categories": initial_categories,
    "line_arithmetic": line_arithmetic,
    "line_sum_reconcile": line_sum_reconcile,
    "residual_lines": residual_lines,
    "delivery_validation": delivery_validation,
    "quote_issues": quote_issues,
    "issue_top10": issue_top10,
    "quality_summary": quality_summary,
    "quality_diff": quality_diff,
}

AMOUNT = """,
av0 AS (SELECT *, total_supply_price + tax_amount AS calculated_total_with_vat,
  CAST(round_even(total_supply_price * 0.1::DOUBLE, 0) AS BIGINT) AS expected_tax_amount,
  nullif(line_sum, 0) AS line_items_sum FROM quotes),
av1 AS (SELECT *, total_with_vat - calculated_total_with_vat AS difference, tax_amount - expected_tax_amount AS tax_difference,
  total_supply_price - line_items_sum AS line_items_difference FROM av0),
av2 AS (SELECT *, coalesce(abs(tax_difference), 0) > greatest(10000, trunc(coalesce(expected_tax_amount, 0) * 0.02::DOUBLE)) AS tax_bad,
  coalesce(abs(line_items_difference), 0) > greatest(10000, trunc(coalesce(total_supply_price, 0) * 0.03::DOUBLE)) AS lines_bad,
  total_with_vat IS NULL OR tax_amount IS NULL AS unknown,
  abs(difference) <= 50000 OR (coalesce(tax_difference, 0) = 0 AND coalesce(line_items_difference, 0) = 0
   AND (abs(difference) <= 100000 OR (CASE WHEN total_with_vat <> 0 THEN abs(difference) / total_with_vat ELSE 1.0 END) <= 0.005::DOUBLE)) AS small
  FROM av1),
av AS (SELECT *, CASE WHEN unknown THEN 'not_enough_data' WHEN difference = 0 THEN
    (CASE WHEN tax_bad OR lines_bad THEN 'amount_mismatch' ELSE 'normal' END)
   WHEN small THEN 'rounding_or_adjustment_possible' ELSE 'amount_mismatch' END AS validation_status,
  nullif(concat_ws(' / ',
   CASE WHEN NOT unknown AND difference <> 0 THEN '공급가+VAT와 견적서 총액이 ' || format('{:,}', abs(difference)) ||
    (CASE WHEN small THEN '원 차이납니다. 만원 단위 절사 또는 조정금액 가능성 확인 필요' ELSE '원 차이납니다. 금액 확인 필요' END) END,
   CASE WHEN tax_bad THEN 'VAT가 공급가의 10%와 ' || format('{:,}', abs(tax_difference)) || '원 차이납니다. VAT 확인 필요' END,
   CASE WHEN lines_bad THEN 'line_items 합계와 공급가가 일치하지 않아 금액 확인 필요' END), '') AS amount_message FROM av2)"""

RECON = """,
rc0 AS (SELECT *, coalesce(total_supply_price, total_with_vat - tax_amount, total_with_vat, 0) AS supply FROM quotes),
rc1 AS (SELECT *, coalesce(supply <> 0 AND line_sum <> 0 AND abs(supply - line_sum) > greatest(10000, trunc(supply * 0.03::DOUBLE)), false) AS apply FROM rc0),
rc2 AS (SELECT *, CASE WHEN apply AND supply > line_sum THEN supply - line_sum WHEN line_sum IS NULL AND supply > 0 THEN supply END AS residual_amount,
  CASE WHEN apply AND supply < line_sum THEN line_sum ELSE supply END AS reconciled_supply FROM rc1),
rc AS (SELECT *, CASE WHEN reconciled_supply > 0 AND (total_with_vat IS NULL OR total_with_vat <= reconciled_supply
   OR abs(total_with_vat - CAST(round_even(reconciled_supply * 1.1::DOUBLE, 0) AS BIGINT)) > greatest(50000, trunc(reconciled_supply * 0.02::DOUBLE)))
  THEN CAST(round_even(reconciled_supply * 1.1::DOUBLE, 0) AS BIGINT) ELSE total_with_vat END AS reconciled_total FROM rc2)"""

DELIVERY = """,
dl0 AS (SELECT *, CASE WHEN delivery_basis_raw IS NOT NULL THEN delivery_basis_raw END AS delivery_raw,
 CASE WHEN quote_id % 6 IN (1, 2, 4) THEN delivery_weeks WHEN quote_id % 6 = 5 THEN delivery_weeks + 1 END AS norm_weeks FROM quotes),
dl AS (SELECT *, CASE WHEN delivery_raw IS NOT NULL THEN 'delivery_basis_raw' END AS delivery_source,
 CASE WHEN delivery_raw = '별도협의' THEN 'discussion_required' WHEN delivery_raw IS NULL THEN 'missing'
  WHEN norm_weeks IS NULL THEN 'needs_review' WHEN norm_weeks <> delivery_weeks THEN 'normalized' ELSE 'normal' END AS delivery_status,
 CASE WHEN delivery_raw = '별도협의' THEN '납기 별도협의' WHEN delivery_raw IS NULL THEN '납기 정보 미기재'
  WHEN norm_weeks IS NULL THEN '납기 원문은 있으나 주 단위 변환 확인 필요' END AS delivery_message FROM dl0)"""

ISSUES = AMOUNT + DELIVERY + """,
arith AS (SELECT quote_id, bool_or(CAST(quantity AS BIGINT) * unit_price <> total_price) AS bad,
 bool_or(quantity = 1 AND total_price >= 1000000) AS swapped FROM lines GROUP BY quote_id),
iss AS (SELECT av.*, dl.delivery_status, dl.delivery_message, arith.bad,
 av.supp_key IS NOT NULL AS known,
 concat_ws('|', CASE WHEN av.vendor_name IS NULL THEN 'vendor_name_missing' END,
  CASE WHEN av.supp_key IS NULL THEN 'vendor_name_partner_not_matched' END,
  CASE WHEN av.quote_id % 9 = 0 THEN 'project_name_missing' END, CASE WHEN av.quote_id % 9 = 1 THEN 'project_name_fallback_used' END,
  CASE WHEN coalesce(av.total_supply_price, 0) = 0 THEN 'total_supply_price_missing' END,
  CASE WHEN av.tax_amount IS NULL THEN 'tax_amount_missing' END, CASE WHEN av.total_with_vat IS NULL THEN 'total_with_vat_missing' END,
  CASE validation_status WHEN 'amount_mismatch' THEN 'amount_mismatch' WHEN 'rounding_or_adjustment_possible' THEN 'amount_rounding_or_adjustment' END,
  CASE WHEN coalesce(line_items_difference, 0) <> 0 THEN 'line_items_sum_mismatch' END,
  CASE WHEN coalesce(tax_difference, 0) <> 0 THEN 'tax_total_mismatch' END,
  CASE WHEN av.line_count = 0 THEN 'line_items_empty' END, CASE WHEN arith.swapped AND validation_status NOT IN ('normal', 'rounding_or_adjustment_possible') THEN 'quantity_unit_price_swapped' END,
  CASE WHEN arith.bad THEN 'line_item_arithmetic_mismatch' END,
  CASE delivery_status WHEN 'missing' THEN 'delivery_missing' WHEN 'discussion_required' THEN 'delivery_to_be_discussed'
   WHEN 'normalized' THEN 'delivery_weeks_not_normalized' END,
  CASE WHEN av.warranty_months IS NULL THEN 'warranty_missing' END,
  CASE WHEN av.warranty_months IS NULL AND contains(coalesce(av.notes_raw, ''), 'A/S') THEN 'warranty_raw_exists_but_not_parsed' END) AS detected_issues,
 concat_ws('|', CASE WHEN validation_status NOT IN ('normal', 'not_enough_data') THEN amount_message END,
  CASE WHEN arith.bad THEN '일부 품목의 수량×단가와 금액이 일치하지 않아 확인 필요' END, delivery_message) AS check_required
 FROM av JOIN dl USING (quote_id) LEFT JOIN arith ON av.quote_id = arith.quote_id)"""

#: The same checks over the corrected quotes; weeks that the text decides are then normal.
SECOND_RUN = re.sub(
    r"\b(av0|av1|av2|av|dl|iss|quotes)\b", r"\1_2", AMOUNT + ISSUES[ISSUES.index(",\niss AS"):])


P = (LINES, QUOTES)
ORACLE = {
    "amount_validation": with_marts(AMOUNT + f" SELECT {', '.join(AMOUNT_COLS)} FROM av", *P),
    "initial_categories": with_marts(r""", t AS (SELECT *, lower(name || ' ' || spec_raw) AS x FROM lines)
SELECT quote_id, line_seq, part_key, supp_key, CASE
 WHEN regexp_matches(x, '비디오월|video wall|패널|panel|did') THEN 'DISPLAY' WHEN regexp_matches(x, '브라켓|bracket|마운트|거치') THEN 'MOUNT'
 WHEN regexp_matches(x, '케이블|잡자재|cable') THEN 'CABLE' WHEN regexp_matches(x, '설치|시운전|install') THEN 'INSTALL'
 WHEN regexp_matches(x, 'led|전광판|lcd|display') THEN 'DISPLAY' WHEN regexp_matches(x, '구조물|보강대') THEN 'MOUNT'
 WHEN regexp_matches(x, '플레이어|player|colorlight|processor|프로세서|controller') THEN 'PLAYER'
 WHEN regexp_matches(x, '시공|교육') THEN 'INSTALL' WHEN regexp_matches(x, 'software|소프트웨어|라이선스') THEN 'SOFTWARE' ELSE 'ETC' END AS first_category FROM t""", LINES),
    "line_arithmetic": with_marts("""SELECT quote_id, line_seq, name, quantity, unit_price, total_price,
 CAST(quantity AS BIGINT) * unit_price AS calculated_amount, total_price - CAST(quantity AS BIGINT) * unit_price AS difference
FROM lines WHERE total_price <> CAST(quantity AS BIGINT) * unit_price""", LINES),
    "line_sum_reconcile": with_marts(RECON + " SELECT quote_id, supply, line_sum, residual_amount, reconciled_supply, reconciled_total FROM rc", *P),
    "residual_lines": with_marts(RECON + """ SELECT quote_id, CASE WHEN product_type IN ('STANDARD', 'SMALL', 'MEDIUM', 'LARGE') THEN 'Display hardware' ELSE '견적 품목' END AS name,
 CASE WHEN product_type IN ('STANDARD', 'SMALL', 'MEDIUM', 'LARGE') THEN 'DISPLAY' ELSE 'ETC' END AS category, 1.0::DOUBLE AS quantity,
 residual_amount AS unit_price, residual_amount AS total_price, true AS reconciliation_residual FROM rc WHERE residual_amount IS NOT NULL""", *P),
    "delivery_validation": with_marts(DELIVERY + " SELECT quote_id, delivery_raw, delivery_source, delivery_weeks, norm_weeks AS normalized_delivery_weeks, delivery_status, delivery_message FROM dl", *P),
    "quote_issues": with_marts(ISSUES + " SELECT quote_id, detected_issues, check_required FROM iss", *P),
    "issue_top10": with_marts(ISSUES + """ SELECT issue, count(*) AS count FROM (SELECT unnest(string_split(detected_issues, '|')) AS issue FROM iss WHERE detected_issues <> '')
 GROUP BY issue ORDER BY count DESC, issue LIMIT 10""", *P),
    "quality_summary": with_marts(ISSUES + """ SELECT count(*) AS quote_result_count, count(vendor_name) AS vendor_name_extracted_count,
 count(CASE WHEN quote_id % 9 <> 0 THEN 1 END) AS project_name_extracted_count,
 count(CASE WHEN coalesce(total_with_vat, 0) <> 0 OR coalesce(total_supply_price, 0) <> 0 THEN 1 END) AS total_amount_extracted_count,
 count(tax_amount) AS tax_amount_extracted_count, count(received_at) AS quote_date_valid_count,
 count(CASE WHEN line_count > 0 THEN 1 END) AS line_items_extracted_count, count(warranty_months) AS warranty_extracted_count,
 count(CASE WHEN coalesce(delivery_weeks, 0) <> 0 OR delivery_basis_raw IS NOT NULL THEN 1 END) AS delivery_extracted_count,
 count(CASE WHEN validation_status = 'normal' THEN 1 END) AS amount_validation_normal_count,
 count(CASE WHEN validation_status = 'rounding_or_adjustment_possible' THEN 1 END) AS amount_rounding_or_adjustment_count,
 count(CASE WHEN validation_status = 'amount_mismatch' THEN 1 END) AS amount_mismatch_count,
 count(CASE WHEN validation_status NOT IN ('normal', 'not_enough_data') THEN 1 END) AS remaining_amount_mismatch_count,
 count(CASE WHEN known THEN 1 END) AS partner_matched_count,
 CAST(sum(CASE WHEN detected_issues = '' THEN 0 ELSE len(string_split(detected_issues, '|')) END) AS BIGINT) AS detected_issue_count,
 0 AS line_item_amount_missing_count, (SELECT count(CASE WHEN line_seq = 1 THEN 1 END) FROM lines) AS display_item_count,
 (SELECT count(CASE WHEN line_seq = 1 THEN 1 END) FROM lines) AS display_spec_raw_present_count, 0 AS display_screen_size_extracted_count,
 0 AS display_resolution_extracted_count, 0 AS display_brightness_extracted_count, 0 AS display_pixel_pitch_extracted_count,
 0 AS display_power_consumption_extracted_count FROM iss""", *P),
    "quality_diff": with_marts(ISSUES + RECON + """,
quotes_2 AS (SELECT rc.* EXCLUDE (supply, apply, residual_amount, reconciled_supply, reconciled_total) REPLACE (
  reconciled_supply AS total_supply_price, reconciled_total AS total_with_vat,
  CASE WHEN residual_amount IS NULL THEN line_sum ELSE coalesce(line_sum, 0) + residual_amount END AS line_sum) FROM rc),
dl_2 AS (SELECT * REPLACE (CASE delivery_status WHEN 'normalized' THEN 'normal' ELSE delivery_status END AS delivery_status) FROM dl)"""
        + SECOND_RUN + """,
n AS (SELECT a.quote_id, len(string_split(a.detected_issues, '|')) - (a.detected_issues = '')::INT AS after_issue_count,
  len(string_split(b.detected_issues, '|')) - (b.detected_issues = '')::INT AS before_issue_count FROM iss_2 a JOIN iss b USING (quote_id))
SELECT quote_id, after_issue_count::INT AS after_issue_count, before_issue_count::INT AS before_issue_count,
  (after_issue_count - before_issue_count)::INT AS delta, after_issue_count < before_issue_count AS improved FROM n""", *P),
}
