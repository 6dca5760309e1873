"""Registered option-split, explanation and evaluation queries with their plain-SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import compare as c
from quotelake.operators import evaluate as ev
from quotelake.operators import explain as e
from quotelake.operators import extract as x
from quotelake.operators import sections as sec
from quotelake.operators import split as sp
from quotelake.operators.ranking import rank_quotes, top_quotes
from quotelake.operators.scale import hot_keys
from quotelake.plans.mart_sql import with_marts
from quotelake.plans.ranking_queries import BY_PROJECT, PARTS, ranked_sql, scored_by_project
from quotelake.sources import documents as doc
from quotelake.sources import marts as m


def option_docs(spark, d):
    """Documents quoting two options whose lines follow each other."""
    k, s = F.col("quote_id"), F.col("s")
    base = doc.base(spark, d).select("quote_id", (F.col("supply") + 1000000).alias("s")).withColumn("a1", F.expr("s div 2")).withColumn(
        "a2", F.expr("s div 3")).withColumn("b2", F.expr("s div 4"))
    item = lambda n, a: F.struct(F.lit(n).alias("name"), F.lit("").alias("spec_raw"), a.alias("amount"))
    second = s * 2 + F.col("b2")
    targets = F.when(k % 4 == 0, F.array(s, second)).when(k % 4 == 1, F.array(s + 100000, second)).when(
        k % 4 == 2, F.array(s * 2, second)).otherwise(F.array(s))
    return base.select("quote_id", "s", F.array(
        item("LED 전광판", F.col("a1")), item("브라켓", F.col("a2")), item("설치비", s - F.col("a1") - F.col("a2")),
        item("비디오월 패널", s * 2), item("설치비", F.col("b2"))).alias("items"), targets.alias("targets"))


def split_multi_option(spark, d):
    return sp.split_options(option_docs(spark, d)).select(
        "quote_id", "split_method", "split_confidence", F.array_join("option_numbers", ",").alias("option_numbers"),
        "split_failed_reason", "check_required")


def split_children(spark, d):
    return sp.option_children(sp.split_options(option_docs(spark, d))).select(
        "quote_id", "parent_quote_id", "option_no", "line_count", "line_sum", "supply_price", "residual", "label")


def option_sum_check(spark, d):
    """Long-table form of the option check over the real lines."""
    li = m.lines(spark, d).select("quote_id", (F.col("line_seq") % 2 + 1).alias("option_no"), F.col("total_price").alias("amount"))
    k = F.col("quote_id")
    sums = li.groupBy("quote_id", "option_no").agg(F.sum("amount").alias("s"))
    totals = sums.select("quote_id", "option_no", F.when(k % 3 == 0, F.col("s")).when(k % 3 == 1, F.expr("s + s div 5")).otherwise(F.expr("s div 2")).alias("supply_price"))
    return sp.option_sum_check(li, totals).select("quote_id", "option_no", "line_sum", "supply_price", "difference", "status")


def corrected_lines(spark, d):
    """Player lines whose quantity is a row number, among all lines."""
    li = m.lines(spark, d).withColumn("spec_raw", F.when(F.col("line_seq") == 1, "함체 수량 4 x 5 = 20").otherwise("controller"))
    li = li.withColumn("quantity", F.when(F.col("line_seq") == 1, 1.0).otherwise(F.col("quantity"))).withColumn(
        "unit_price", F.when(F.col("line_seq") == 1, F.col("total_price")).otherwise(F.col("unit_price")))
    return sp.correct_lines(li).where("correction IS NOT NULL").select(
        "quote_id", "line_seq", "part_key", "quantity", "unit_price", "total_price", F.substring("correction", 1, 11).alias("reason"))


def section_items(spark, d):
    k, s = F.col("quote_id"), F.col("s")
    docs = option_docs(spark, d).select("quote_id", F.concat_ws(
        "\n", F.lit("상세내역"), F.lit("LED Display"), F.lit("수량"), (k % 4 + 2).cast("string"), doc.won(s), doc.won(s * (k % 4 + 2)),
        F.lit("브라켓"), F.lit("1"), doc.won(s * 3), doc.won(s * 3), F.lit("소계"), doc.won(s * (k % 4 + 5))).alias("text"))
    return sp.section_triples(docs).select("quote_id", "item_name", "quantity", "unit_price", "supply_amount")


def split_sections(spark, d):
    """Documents with two subtotalled sections; in every fourth a subtotal differs from its option."""
    k, s = F.col("quote_id"), F.col("s")
    n = k % 4 + 2
    total = lambda c: doc.won(c)
    docs = option_docs(spark, d).select("quote_id", F.concat_ws(
        "\n", F.lit("번호"), F.lit("품목"), F.lit("수량"), F.lit("견적단가"), F.lit("실내 LED Display P1.5"), F.lit("| 전체 수량"), F.lit("모델 AB12"),
        n.cast("string"), total(s), total(s * n), F.lit("출장비 (개당)"), F.lit("2"), total(s * 2), total(s * 4), F.lit("소 계"),
        total(s * (n + 4)), F.lit("부가세"), F.lit("비디오월 패널"), F.lit("3"), total(s * 5), total(s * 15), F.lit("3"), total(s * 5), total(s * 15),
        F.lit("All-in-one"), F.lit("VX400"), F.lit("1"), total(s), total(s), F.lit("소계:"),
        total(F.when(k % 4 == 3, s * 16 + 50000).otherwise(s * 16))).alias("text"), F.array(s * (n + 4), s * 16).alias("targets"))
    return sec.split_sections(docs).select(
        "quote_id", "option_no", "item_name", "quantity", "unit_price", "supply_amount", "option_sum", "split_method")


def top3(spark, d):
    return c.relative_position(top_quotes(scored_by_project(spark, d), ["project_id"], 3), ["project_id"])


def reasons_template(spark, d):
    """With the card limits of the compared system: two strengths, two weaknesses, 45 characters."""
    return e.template_reasons(top3(spark, d), keep=2, chars=45).select(
        "project_id", "quote_id", "rank", "card_summary", F.array_join("strengths", "|").alias("strengths"),
        F.array_join("weaknesses", "|").alias("weaknesses"))


def reasons_summary(spark, d):
    return e.overall_summaries(e.template_reasons(top3(spark, d), keep=2, chars=45), ["project_id"])


def risk_split(spark, d):
    out = e.split_comparison(scored_by_project(spark, d))
    return out.select("quote_id", F.array_join("relative_risks", "|").alias("relative_risks"), F.size("operational_checks").alias("check_count"),
                      F.size(e.decision_risks(F.col("check_required"))).alias("decision_count"), F.size(e.parser_notes(F.col("check_required"))).alias("parser_count"))


def cards_of(spark, d):
    t = top_quotes(scored_by_project(spark, d), ["project_id"], 3)
    return t.select(F.col("project_id").alias("record_id"), F.col("quote_id").cast("string").alias("quote_id"), "vendor_name", "rank", "check_required",
                    "warranty_months", "total_supply_price", "total_with_vat", "delivery_weeks", "final_score", F.col("quote_id").alias("k"))


def reasons_reconcile(spark, d):
    """Generated cards with gaps, repeats and strangers, filled from templates."""
    base = cards_of(spark, d)
    gen = base.where("warranty_months IS NOT NULL").select("record_id", "quote_id", F.lit(1).alias("position"), F.concat(F.lit("생성 "), "quote_id").alias("card_summary"))
    twice = base.where("warranty_months = 12").select("record_id", "quote_id", F.lit(2).alias("position"), F.lit("두번째").alias("card_summary"))
    odd = base.where("rank = 1").select("record_id", F.concat(F.lit("x"), "quote_id").alias("quote_id"), F.lit(3).alias("position"), F.lit("모름").alias("card_summary"))
    template = base.select("record_id", "quote_id", F.lit("템플릿").alias("card_summary"))
    cards, warnings = e.reconcile(base.select("record_id", "quote_id"), gen.unionByName(twice).unionByName(odd), template)
    return cards.select("record_id", "quote_id", "card_summary", F.when(F.col("fallback_used"), "fallback").otherwise("generated").alias("kind")).unionByName(
        warnings.select("record_id", "quote_id", F.lit(None).cast("string").alias("card_summary"), F.col("issue").alias("kind")))


def generated(spark, d):
    k = F.col("k")
    extra = F.when(k % 6 == 0, " 최고 수준").when(k % 6 == 1, " 보증 12개월 제공").when(k % 6 == 3, " 납기 3주").when(k % 6 == 4, " 금액 1,234원").otherwise("")
    weak = F.when(k % 6 == 2, F.array(F.lit("보증기간 미기재"), F.lit("나"), F.lit("다"))).when(k % 2 == 0, F.array(F.lit("보증기간 미기재"))).otherwise(F.array(F.lit("조건 확인")))
    base = cards_of(spark, d)
    cards = base.select("record_id", "quote_id", "vendor_name", "k", F.concat(F.lit("비교 후보"), extra).alias("card_summary"),
                        F.array(F.lit("비교 검토 가능")).alias("strengths"), weak.alias("weaknesses"))
    return cards, base


def reasons_violations(spark, d):
    cards, items = generated(spark, d)
    return ev.card_violations(cards, items).select("record_id", "quote_id", F.array_join("categories", "|").alias("categories"))


def violation_rates(spark, d):
    cards, items = generated(spark, d)
    rec = ev.card_violations(cards, items).select(
        F.when(F.col("record_id") % 2 == 0, "trap").otherwise("control").alias("grp"), F.when(F.col("k") % 9 != 0, F.col("categories")).alias("categories"))
    return ev.violation_rates(rec, "grp")


def violation_categories(spark, d):
    cards, items = generated(spark, d)
    rec = ev.card_violations(cards, items).withColumn("grp", F.when(F.col("record_id") % 2 == 0, "trap").otherwise("control"))
    return ev.category_counts(rec, "grp")


def record_violations(spark, d):
    cards, items = generated(spark, d)
    bad = cards.withColumn("card_summary", F.when(F.col("record_id") % 3 == 0, "모두 우수").otherwise("가장 우수"))
    wide = items.withColumn("final_score", F.when(F.col("rank") == 1, F.col("final_score") - 60).otherwise(F.col("final_score")))
    return ev.record_violations(bad, wide).select("record_id", F.array_join("categories", "|").alias("categories"))


def eval_field_accuracy(spark, d):
    docs = doc.quote_texts(spark, d)
    got = x.quote_date(x.labelled_amounts(docs))
    fields = ["supply_amount", "tax_amount", "total_amount"]
    want = doc.base(spark, d).select("quote_id", F.col("supply").alias("supply_amount"), F.col("tax").alias("tax_amount"), F.col("total").alias("total_amount"))
    cmp = ev.compare_fields(ev.to_long(want, "quote_id", fields), ev.to_long(got, "quote_id", fields), "quote_id")
    return ev.field_accuracy(cmp)


def eval_recall_mrr(spark, d):
    vec = m.vectors(spark, d).select("vec_id", "label")
    req = m.requirements(spark, d).select("project_id", F.col("vec_id").alias("rv"))
    scored = scored_by_project(spark, d)
    ranked = rank_quotes(scored, ["project_id"], hot_keys(m.quotes(spark, d), ["project_id"])).select("project_id", "quote_id", "rank", "vec_id")
    both = ranked.join(req, "project_id").join(vec.select("vec_id", F.col("label").alias("ql")), "vec_id", "left").join(
        vec.select(F.col("vec_id").alias("rv"), F.col("label").alias("rl")), "rv", "left")
    return ev.ranking_quality(both.withColumn("relevant", F.coalesce(F.col("ql") == F.col("rl"), F.lit(False))), "project_id")


QUERIES = {f.__name__: f for f in (
    split_multi_option, split_children, option_sum_check, corrected_lines, section_items, split_sections, reasons_template, reasons_summary, risk_split,
    reasons_reconcile, reasons_violations, violation_rates, violation_categories, record_violations, eval_field_accuracy, eval_recall_mrr)}

BASE = """WITH b AS (SELECT o_orderkey AS quote_id, CAST(round(o_totalprice * 100) AS BIGINT) AS supply FROM orders),
o AS (SELECT quote_id, supply + 1000000 AS s, quote_id % 4 AS m FROM b) """
TOPSQL = ranked_sql(BY_PROJECT) + """,
t3 AS (SELECT * FROM ranked WHERE rank <= 3),
pos AS (SELECT *, final_score = max(final_score) OVER w AS hi_final, price_score = max(price_score) OVER w AS hi_price, spec_score = max(spec_score) OVER w AS hi_spec FROM t3 WINDOW w AS (PARTITION BY project_id)),
rk AS (SELECT *, talk AND sched AND required_weeks IS NOT NULL AS open_delivery, conflict OR (NOT separate AND NOT has_install AND (contains(notes, '설치') OR contains(notes, '시공'))) AS open_install,
 list_filter([CASE WHEN sched AND required_weeks IS NULL THEN '요구 납기 정규화 필요' END, CASE WHEN sched AND required_weeks IS NOT NULL AND talk THEN '납기 별도협의' END,
  CASE WHEN sched AND required_weeks IS NOT NULL AND NOT talk AND delivery_weeks IS NULL THEN '납기 정보 미기재' END, CASE WHEN warranty_months IS NULL THEN '보증기간 미기재' END,
  CASE WHEN conflict THEN '설치비 포함 여부 문서 내 상충 확인 필요' END,
  CASE WHEN NOT conflict AND NOT separate AND NOT has_install AND (contains(notes, '설치') OR contains(notes, '시공')) THEN '설치 범위 확인 필요' END,
  CASE WHEN wide THEN '가격 차이 5% 초과' END], lambda z: z IS NOT NULL) AS risks FROM pos),
wk AS (SELECT *, CASE WHEN len(risks) > 0 THEN risks[1:2] ELSE list_filter([CASE WHEN delivery_score < 70 AND NOT open_delivery THEN '납기 조건 확인 필요' END, CASE WHEN warranty_score < 70 THEN '보증기간 확인 필요' END,
  CASE WHEN installation_score < 70 THEN '설치 범위 확인 필요' END, CASE WHEN NOT partner_found THEN '파트너 매칭 확인 필요' END], lambda z: z IS NOT NULL)[1:2] END AS w0 FROM rk),
rs AS (SELECT *, CASE WHEN len(w0) > 0 THEN w0 ELSE ['특이 리스크 없음'] END AS weak, coalesce(delivery_weeks, 0) <> 0 AND NOT open_delivery AS clear,
 list_filter([CASE WHEN hi_final THEN '최종 점수 ' || printf('%.2f', final_score) || '로 1위' END, CASE WHEN hi_price THEN '가격 점수 ' || CAST(round_even(price_score, 0) AS BIGINT) || '점으로 경쟁력 우수' END,
  CASE WHEN hi_spec AND spec_score >= 75 THEN '사양 점수가 Top3 중 우수' END, CASE WHEN coalesce(delivery_weeks, 0) <> 0 AND NOT open_delivery AND delivery_score >= 80 THEN '납기 ' || delivery_weeks || '주로 조건 명확' END,
  CASE WHEN warranty_months IS NOT NULL AND warranty_score >= 80 THEN '보증 ' || warranty_months || '개월' END, CASE WHEN installation_score >= 80 AND NOT open_install THEN '설치 조건 반영' END], lambda z: z IS NOT NULL)[1:2] AS strong FROM wk)"""
VIOL = ranked_sql(BY_PROJECT) + """,
vc AS (SELECT project_id AS record_id, CAST(quote_id AS VARCHAR) AS quote_id, quote_id AS k, rank, final_score, concat_ws('|',
  CASE WHEN quote_id % 6 = 0 THEN '최고 수준' END, NULL) AS banned,
  CASE WHEN quote_id % 2 <> 0 AND ((sched AND required_weeks IS NOT NULL AND NOT talk AND delivery_weeks IS NULL) OR warranty_months IS NULL) THEN 'check_required_missing' END AS miss,
  CASE WHEN quote_id % 6 = 1 AND warranty_months IS NULL THEN 'warranty_guess' END AS wg, CASE WHEN quote_id % 6 = 4 AND total_with_vat IS NULL AND total_supply_price IS DISTINCT FROM 1234 THEN 'price_guess' END AS pg,
  CASE WHEN quote_id % 6 = 3 AND delivery_weeks IS NULL THEN 'delivery_guess' END AS dg, CASE WHEN quote_id % 6 = 2 THEN 'weakness_too_many' END AS wm,
  CASE WHEN vendor_name IS NULL THEN NULL END AS vg FROM ranked WHERE rank <= 3),
vv AS (SELECT *, concat_ws('|', CASE WHEN banned <> '' THEN 'banned_phrase' END, miss, wg, pg, dg, wm) AS categories FROM vc)"""
ORACLE = {
    "split_multi_option": BASE + """SELECT quote_id, CASE m WHEN 0 THEN 'sequential_line_item_sum' WHEN 1 THEN 'product_group_boundary_with_unparsed_residual' END AS split_method,
 CASE m WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS split_confidence, CASE WHEN m < 2 THEN '1,1,1,2,2' END AS option_numbers,
 CASE WHEN m = 2 THEN 'line_items cumulative sum did not match option total candidates' END AS split_failed_reason, CASE WHEN m = 2 THEN '복수 옵션 자동 분리 실패, 수동 확인 필요' END AS check_required FROM o""",
    "split_children": BASE + """SELECT quote_id || '_opt' || n || '_' || (CASE n WHEN 1 THEN 'LED전광판' ELSE '비디오월' END) AS quote_id, CAST(quote_id AS VARCHAR) AS parent_quote_id, n AS option_no, CASE n WHEN 1 THEN 3 ELSE 2 END AS line_count,
 CASE n WHEN 1 THEN s ELSE s * 2 + s // 4 END AS line_sum, CASE WHEN n = 1 THEN s + (CASE WHEN m = 1 THEN 100000 ELSE 0 END) ELSE s * 2 + s // 4 END AS supply_price,
 CASE WHEN m = 1 AND n = 1 THEN 100000 END AS residual, CASE n WHEN 1 THEN 'LED전광판' ELSE '비디오월' END AS label FROM o, (VALUES (1), (2)) t(n) WHERE m < 2""",
    "option_sum_check": with_marts(""", s AS (SELECT quote_id, line_seq % 2 + 1 AS option_no, CAST(sum(total_price) AS BIGINT) AS s FROM lines GROUP BY 1, 2),
 t AS (SELECT *, CASE quote_id % 3 WHEN 0 THEN s WHEN 1 THEN s + s // 5 ELSE s // 2 END AS p FROM s)
 SELECT quote_id, option_no, s AS line_sum, p AS supply_price, p - s AS difference, CASE WHEN abs(p - s) <= 10000 THEN 'match' WHEN p > s AND p - s <= trunc(p * 0.3::DOUBLE) THEN 'residual' ELSE 'mismatch' END AS status FROM t""", PARTS[0]),
    "corrected_lines": with_marts(""" SELECT quote_id, line_seq, part_key, CASE WHEN line_seq = 1 THEN 20.0 ELSE 1.0 END::DOUBLE AS quantity, CASE WHEN line_seq = 1 THEN total_price // 20 ELSE unit_price END AS unit_price,
 CASE WHEN line_seq = 1 THEN total_price ELSE unit_price END AS total_price, CASE WHEN line_seq = 1 THEN 'LED cabinet' ELSE 'row number ' END AS reason
 FROM lines WHERE (line_seq = 1 AND p_type = 'STANDARD' AND total_price % 20 = 0) OR (line_seq > 1 AND quantity IN (2, 3, 4))""", PARTS[0]),
    "section_items": BASE + """SELECT quote_id, 'LED Display' AS item_name, (quote_id % 4 + 2)::DOUBLE AS quantity, s AS unit_price, s * (quote_id % 4 + 2) AS supply_amount FROM o
 UNION ALL SELECT quote_id, '브라켓', 1.0, s * 3, s * 3 FROM o""",
    "split_sections": BASE + """, i AS (
  SELECT *, 1 AS option_no, 'LED Display' AS item_name, (m + 2)::DOUBLE AS quantity, s AS unit_price, s * (m + 2) AS supply_amount FROM o
  UNION ALL SELECT *, 1, '출장비', 2.0, s * 2, s * 4 FROM o
  UNION ALL SELECT *, 2, '비디오월 패널', 3.0, s * 5, s * 15 FROM o
  UNION ALL SELECT *, 2, '비디오월 패널', 1.0, s, s FROM o)
 SELECT quote_id, option_no, item_name, quantity, unit_price, supply_amount, CASE option_no WHEN 1 THEN s * (m + 6) ELSE s * 16 END AS option_sum,
  'product_group_boundary_section_reconstructed' AS split_method FROM i WHERE m <> 3""",
    "reasons_template": with_marts(TOPSQL + """ SELECT project_id, quote_id, rank,
 CASE WHEN rank = 1 AND hi_final AND hi_price THEN '최저가와 종합 점수에서 가장 우수한 견적입니다.' WHEN rank = 1 AND hi_final THEN '종합 점수가 가장 높은 추천 견적입니다.' WHEN clear THEN '납기는 명확하지만 가격과 조건 확인이 필요합니다.'
  WHEN weak[1] <> '특이 리스크 없음' THEN replace(weak[1], ' 확인 필요', '') || ' 확인이 필요한 견적입니다.' ELSE '주요 점수가 균형적인 비교 후보입니다.' END AS card_summary,
 CASE WHEN len(strong) > 0 THEN array_to_string(strong, '|') ELSE '비교 검토 가능' END AS strengths, array_to_string(weak, '|') AS weaknesses FROM rs""", *PARTS),
    "reasons_summary": with_marts(TOPSQL + """, vn AS (SELECT *, vendor_name AS v FROM rs)
 SELECT project_id, concat_ws(' ', max(CASE WHEN rank = 1 THEN '1순위 ' || v || '는 최종 점수 ' || printf('%.2f', final_score) || (CASE WHEN hi_price THEN '로 가장 우수하며 가격 경쟁력도 가장 높습니다.' ELSE '로 가장 우수하며 가격과 사양을 함께 고려한 결과입니다.' END) END),
 max(CASE WHEN rank = 2 THEN v || (CASE WHEN clear THEN '은 납기 조건이 명확하지만 가격 리스크 확인이 필요합니다.' ELSE '은 사양과 가격 조건을 추가 비교할 후보입니다.' END) END),
 max(CASE WHEN rank = 3 AND weak[1] <> '특이 리스크 없음' THEN v || '은 ' || replace(array_to_string(weak, ', '), ' 확인 필요', '') || ' 확인이 필요합니다.' END)) AS overall_summary FROM vn GROUP BY project_id""", *PARTS),
    "risk_split": with_marts(TOPSQL + """ SELECT quote_id, CASE WHEN wide THEN '최저가 대비 가격 차이 5% 초과' ELSE '' END AS relative_risks,
 CASE WHEN check_required = '' THEN 0 ELSE len(string_split(check_required, '|')) END::INT AS check_count,
 len(list_filter(string_split(check_required, '|'), lambda z: contains(z, '납기') OR contains(z, '보증') OR contains(z, '확인 필요')))::INT AS decision_count, 0 AS parser_count FROM ranked""", *PARTS),
    "reasons_reconcile": with_marts(ranked_sql(BY_PROJECT) + """, t AS (SELECT project_id AS record_id, CAST(quote_id AS VARCHAR) AS quote_id, warranty_months AS w, rank FROM ranked WHERE rank <= 3)
 SELECT record_id, quote_id, CASE WHEN w IS NOT NULL THEN '생성 ' || quote_id ELSE '템플릿' END AS card_summary, CASE WHEN w IS NOT NULL THEN 'generated' ELSE 'fallback' END AS kind FROM t
 UNION ALL SELECT record_id, quote_id, NULL, 'missing' FROM t WHERE w IS NULL UNION ALL SELECT record_id, quote_id, NULL, 'duplicate' FROM t WHERE w = 12
 UNION ALL SELECT record_id, 'x' || quote_id, NULL, 'unknown' FROM t WHERE rank = 1""", *PARTS),
    "reasons_violations": with_marts(VIOL + " SELECT record_id, quote_id, categories FROM vv", *PARTS),
    "violation_rates": with_marts(VIOL + """ SELECT CASE WHEN record_id % 2 = 0 THEN 'trap' ELSE 'control' END AS grp, count(CASE WHEN k % 9 <> 0 THEN 1 END) AS total_llm, count(CASE WHEN k % 9 <> 0 AND categories <> '' THEN 1 END) AS violations_raw,
 round(count(CASE WHEN k % 9 <> 0 AND categories <> '' THEN 1 END) / count(CASE WHEN k % 9 <> 0 THEN 1 END), 6)::DOUBLE AS violation_rate_primary, round(count(CASE WHEN k % 9 = 0 THEN 1 END) / count(*), 6)::DOUBLE AS fallback_rate, count(*) AS total_records FROM vv GROUP BY 1""", *PARTS),
    "violation_categories": with_marts(VIOL + """ SELECT grp, category, count(*) AS count FROM (SELECT CASE WHEN record_id % 2 = 0 THEN 'trap' ELSE 'control' END AS grp, unnest(string_split(categories, '|')) AS category FROM vv WHERE categories <> '') GROUP BY 1, 2""", *PARTS),
    "record_violations": with_marts(VIOL + """, s AS (SELECT record_id, k, CASE WHEN rank = 1 THEN final_score - 60 ELSE final_score END AS f, rank FROM vv),
 g AS (SELECT record_id, max(f) AS hi, min(f) AS lo, count(*) AS n, arg_min(f, rank) AS first FROM s GROUP BY 1)
 SELECT record_id, concat_ws('|', CASE WHEN n >= 2 AND first < hi THEN 'rank_score_mismatch' END, CASE WHEN n >= 2 AND hi - lo > 50 AND record_id % 3 = 0 THEN 'score_gap_ignored' END) AS categories FROM g""", *PARTS),
    "eval_field_accuracy": """WITH d AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS s FROM orders),
 f AS (SELECT k, unnest([{'f': 'supply_amount', 'ok': k % 3 <> 2 OR s = s // 10}, {'f': 'tax_amount', 'ok': k % 3 <> 2}, {'f': 'total_amount', 'ok': NOT (k % 3 = 2 AND k % 4 = 0)}]) AS r FROM d)
 SELECT r.f AS field, count(CASE WHEN r.ok THEN 1 END) AS passed, count(*) AS total, round(count(CASE WHEN r.ok THEN 1 END) / count(*) * 100, 1)::DOUBLE AS pass_rate FROM f GROUP BY ROLLUP (r.f)""",
    "eval_recall_mrr": with_marts(ranked_sql(BY_PROJECT) + """, j AS (SELECT r.project_id, r.rank, coalesce(qv.label = rv.label, false) AS rel FROM ranked r JOIN reqs q ON r.project_id = q.project_id LEFT JOIN vecs qv ON r.vec_id = qv.vec_id LEFT JOIN vecs rv ON q.vec_id = rv.vec_id),
 p AS (SELECT project_id, max(CASE WHEN rel AND rank <= 3 THEN 1.0 ELSE 0.0 END) AS hit, 1.0 / min(CASE WHEN rel THEN rank END) AS rr, count(CASE WHEN rel AND rank <= 3 THEN 1 END) / 3.0 AS pr FROM j GROUP BY 1 HAVING bool_or(rel))
 SELECT count(*) AS query_count, round(avg(hit), 6)::DOUBLE AS recall_at_k, round(avg(rr), 6)::DOUBLE AS mrr, round(avg(pr), 6)::DOUBLE AS precision_at_k FROM p""", *PARTS),
}
