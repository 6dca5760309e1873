"""Registered remark queries; the SQL side returns the remarks the texts were written with."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import notes as n
from quotelake.sources import documents as doc


def remark_docs(spark, d):
    k = F.col("quote_id")
    return doc.base(spark, d).select("quote_id", F.concat_ws(
        "\n", F.lit("견적서"), F.lit("결 제 조 건"), F.lit("납 기"),
        F.concat(F.lit("선입금 "), (k % 9 + 1).cast("string"), F.lit("0%")), F.concat((k % 12 + 1).cast("string"), F.lit("주 이내")),
        F.lit("특기사항"), F.when(k % 3 == 0, F.lit("1. 전기 인입공사 별도")).otherwise(F.lit("- 현장실사 후 비용이 변경될 수 있습니다")),
        F.when(k % 2 == 0, F.lit("무상 보증 1년")), F.lit("품명"), F.lit("합계 1,000,000"), F.lit("안내 문장")).alias("text"))


def note_sections(spark, d):
    return n.with_section(n.note_lines(remark_docs(spark, d))).groupBy("quote_id").agg(
        F.count_if(F.col("section") == "특기사항").alias("in_section"), F.count("*").alias("line_count"))


def label_value_zip(spark, d):
    return n.label_value_zip(remark_docs(spark, d)).select("quote_id", "label", "value")


def note_terms(spark, d):
    out = n.note_terms(remark_docs(spark, d))
    return out.select("quote_id", "payment_terms", F.array_join("delivery_terms", "|").alias("delivery_terms"),
                      F.array_join("warranty_terms", "|").alias("warranty_terms"), F.array_join("special_notes", "|").alias("special_notes"), "excluded_count")


QUERIES = {f.__name__: f for f in (note_sections, label_value_zip, note_terms)}
K = "SELECT o_orderkey AS quote_id, o_orderkey % 3 = 0 AS e, o_orderkey % 2 = 0 AS w FROM orders"
ORACLE = {
    "note_sections": f"SELECT quote_id, 1 + w::INT AS in_section, 9 + w::INT AS line_count FROM ({K})",
    "label_value_zip": f"""SELECT quote_id, '결제조건' AS label, '선입금 ' || (quote_id % 9 + 1) || '0%' AS value FROM ({K})
 UNION ALL SELECT quote_id, '납기', (quote_id % 12 + 1) || '주 이내' FROM ({K})""",
    "note_terms": f"""SELECT quote_id, '선입금 ' || (quote_id % 9 + 1) || '0%' AS payment_terms, (quote_id % 12 + 1) || '주 이내' AS delivery_terms,
 CASE WHEN w THEN '무상 보증 1년' ELSE '' END AS warranty_terms, CASE WHEN e THEN '전기 인입공사 별도' ELSE '현장실사 후 비용이 변경될 수 있습니다' END AS special_notes, 2 AS excluded_count FROM ({K})""",
}
