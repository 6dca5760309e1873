"""Registered intake, record-keeping, embedding-store and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.operators import partners as p
from quotelake.operators import similarity as sim
from quotelake.plans.mart_sql import LINES, PARTNERS, QUOTES, REQUIREMENTS, with_marts
from quotelake.sources import intake as i
from quotelake.sources import lifecycle as lc
from quotelake.sources import marts as m
from quotelake.streaming import jobs


def project_latest_state(spark, d):
    return lc.latest_state(m.project_events(spark, d), ["project_id"], ["created_at", "id"], ["status", "value"])


def latest_purchase(spark, d):
    """Latest record that carries a result."""
    return lc.latest_state(m.project_events(spark, d), ["project_id"], ["created_at", "id"], ["value"], F.col("status") == "purchase")


def project_status_counts(spark, d):
    return lc.status_counts(project_latest_state(spark, d))


def projects(spark, d):
    c = m.table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("company_name"),
                                             F.concat(F.lit("사업 "), F.col("c_mktsegment")).alias("name"))
    first = m.table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("created_at"), F.max("o_orderstatus").alias("status"))
    return c.join(first, c.project_id == first.o_custkey).drop("o_custkey")


def project_search(spark, d):
    return lc.search_projects(projects(spark, d), "building", "P", page=2, size=20)


def recent_records(spark, d):
    return lc.recent(m.project_events(spark, d).select("id", "project_id", "created_at"), 50, [F.col("created_at").desc(), F.col("id").desc()])


def upsert_quotes(spark, d):
    """Stored quotes, then the amounts of all their lines as the newer state of every quote that has some."""
    cur = m.table(spark, d, "orders").select(F.col("o_orderkey").alias("quote_id"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    new = m.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("quote_id")).agg(
        F.max("l_linestatus").alias("status"), F.max("l_quantity").cast("double").alias("o_totalprice"))
    return lc.upsert(cur, new, ["quote_id"])


def patch_projects(spark, d):
    c = m.table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("location"), "c_acctbal")
    changes = c.where("location = 'BUILDING'").select("project_id", F.when(F.col("c_acctbal") < 0, F.lit("새 회사")).alias("company_name"), F.lit("서울").alias("location"))
    return lc.patch(c.drop("c_acctbal"), changes, ["project_id"], ["company_name", "location"])


def delete_projects(spark, d):
    gone = m.table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("project_id"))
    kids = m.table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("quote_id"))
    return lc.delete_projects({"quotes": kids}, gone)["quotes"]


def confirmed_selection(spark, d):
    ev = m.table(spark, d, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("product_group"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderkey").alias("id"))
    return lc.latest_state(ev, ["project_id", "product_group"], ["created_at", "id"], [])


def file_dedupe(spark, d):
    docs = i.with_file_hash(m.table(spark, d, "documents"), "text")
    return i.dedupe_files(docs, "doc_id")


def intake_good_bad(spark, d):
    ext = F.when(F.col("doc_id") % 4 == 0, ".pdf").when(F.col("doc_id") % 8 == 1, ".XLSX").when(F.col("doc_id") % 8 == 5, ".xls").when(F.col("doc_id") % 4 == 2, ".exe").otherwise(".png")
    files = m.table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("/in/doc"), F.col("doc_id").cast("string"), ext).alias("path"), F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.length("text")).alias("length"))
    good, bad = i.split_good_bad(i.screen_files(files), "reject_reason")
    return good.select("doc_id", F.lit(None).cast("string").alias("reject_reason"), i.document_kind(F.col("path")).alias("kind")).unionByName(
        bad.select("doc_id", "reject_reason", i.document_kind(F.col("path")).alias("kind")))


def json_quotes_typed(spark, d):
    k = F.col("o_orderkey")
    row = F.to_json(F.struct(
        F.concat(F.lit("업체 "), k.cast("string")).alias("vendor_name"),
        F.concat(F.lit("₩"), F.format_number(F.round(F.col("o_totalprice")), 0), F.lit("원")).alias("total_supply_price"),
        F.when(k % 2 == 0, (k % 9).cast("string")).otherwise("").alias("delivery_weeks"),
        F.array(F.struct(F.lit("LED").alias("name"), F.when(k % 3 == 0, "display").otherwise("unknown").alias("category"), F.lit("1,000").alias("quantity"),
                         (k % 7 == 0).cast("string").alias("is_optional"))).alias("line_items")))
    raw = m.table(spark, d, "orders").select(k.alias("quote_id"), F.when(k % 11 == 0, F.lit("{broken")).otherwise(row).alias("raw_json"))
    t = i.parse_json_quotes(raw)
    line = F.get("line_items", F.lit(0))
    return t.select("quote_id", "failure_reason", "vendor_name", "total_supply_price", "delivery_weeks", "extraction_confidence",
                    line["category"].alias("category"), line["quantity"].alias("quantity"), line["is_optional"].alias("is_optional"))


def quote_ids(spark, d):
    q = m.quotes(spark, d).select("quote_id", "vendor_name", "received_at")
    h = F.substring(F.sha2(F.col("quote_id").cast("string"), 256), 1, 8)
    return q.select("quote_id", i.quote_id(F.coalesce("vendor_name", F.lit("")), F.col("received_at"), h).alias("new_id")).withColumn(
        "is_temporary", i.is_temporary_id(F.col("new_id"))).withColumn(
        "option_id", i.option_quote_id(F.col("quote_id").cast("string"), F.lit(2), F.lit("LED 전광판 / A")))


def stale_embeddings(spark, d):
    par = m.partners(spark, d)
    k = F.col("supp_key")
    paid = m.table(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("supp_key"))
    store = par.join(paid, "supp_key", "left_semi").select(
        "name", F.when(k % 4 == 0, F.lit("old")).otherwise(sim.source_hash()).alias("source_hash"),
        F.array_repeat(F.lit(0.5), F.when(k % 7 == 0, 32).otherwise(64)).alias("vec"))
    return sim.stale_partners(par, store, 64).select("name")


def embedding_text(spark, d):
    return m.requirements(spark, d).select("project_id", sim.requirement_text().alias("text"))


def quote_embedding_text(spark, d):
    return m.quotes(spark, d).select("quote_id", sim.quote_text().alias("text"))


def partner_history_text(spark, d):
    return m.partners(spark, d).select("name", p.format_history(F.col("solution_breakdown"), limit=6).alias("history"))


def storage_projection(spark, d):
    docs = m.table(spark, d, "documents").select("doc_id", F.col("text").alias("source_text"), F.lit("k").alias("api_key"))
    return i.strip_heavy(docs)  # whole texts: the cut is a parameter


def json_round_trip(spark, d):
    src = m.table(spark, d, "orders").select(F.col("o_orderkey").alias("quote_id"), "o_totalprice", "o_orderstatus")
    return i.from_record(i.to_record(src, ["quote_id"]), src.schema)


def stream_latest_state(spark, d):
    stream = m.table_stream(spark, d, "events").select(
        F.col("user_id").alias("project_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("status"), "value")
    return jobs.stream_latest_state(stream, jobs.work_folder(spark, "latest")).select("project_id", "created_at", "id", "status", "value")


def stream_quote_intake(spark, d):
    stream = m.table_stream(spark, d, "documents").select(
        "doc_id", "text", F.timestamp_seconds(F.col("doc_id") + 1700000000).alias("ts"))
    good, bad = jobs.stream_intake(stream, jobs.work_folder(spark, "intake"))
    return good.unionByName(bad).select("file_hash", "reject_reason")


QUERIES = {f.__name__: f for f in (
    project_latest_state, latest_purchase, project_status_counts, project_search, recent_records, upsert_quotes, patch_projects,
    delete_projects, confirmed_selection, file_dedupe, intake_good_bad, json_quotes_typed, quote_ids, stale_embeddings, embedding_text,
    quote_embedding_text, partner_history_text, storage_projection, json_round_trip, stream_latest_state, stream_quote_intake)}

LATEST = "SELECT user_id AS project_id, ts AS created_at, event_id AS id, event_type AS status, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
ORACLE = {
    "project_latest_state": LATEST,
    "latest_purchase": "SELECT user_id AS project_id, ts AS created_at, event_id AS id, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "project_status_counts": f"SELECT status, count(*) AS n FROM ({LATEST}) GROUP BY ROLLUP (status)",
    "project_search": """WITH f AS (SELECT o_custkey, max(o_orderdate) AS created_at, max(o_orderstatus) AS status FROM orders GROUP BY 1)
 SELECT c_custkey AS project_id, c_name AS company_name, '사업 ' || c_mktsegment AS name, created_at, status FROM customer JOIN f ON c_custkey = o_custkey
 WHERE status = 'P' AND (contains(lower(c_mktsegment), 'building') OR contains(lower(c_name), 'building')) ORDER BY created_at DESC, project_id LIMIT 20 OFFSET 20""",
    "recent_records": "SELECT event_id AS id, user_id AS project_id, ts AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "upsert_quotes": """SELECT coalesce(o_orderkey, k) AS quote_id, coalesce(s, o_orderstatus) AS status, coalesce(p, o_totalprice) AS o_totalprice
 FROM orders FULL JOIN (SELECT l_orderkey AS k, max(l_linestatus) AS s, max(l_quantity)::DOUBLE AS p FROM lineitem GROUP BY 1) ON k = o_orderkey""",
    "patch_projects": "SELECT c_custkey AS project_id, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN '새 회사' ELSE c_name END AS company_name, CASE WHEN c_mktsegment = 'BUILDING' THEN '서울' ELSE c_mktsegment END AS location FROM customer",
    "delete_projects": "SELECT o_custkey AS project_id, o_orderkey AS quote_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
    "confirmed_selection": "SELECT o_custkey AS project_id, o_orderpriority AS product_group, o_orderdate AS created_at, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "file_dedupe": "SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "intake_good_bad": """SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'unsupported_extension' WHEN doc_id % 10 = 0 THEN 'empty_file' END AS reject_reason,
 CASE WHEN doc_id % 4 = 1 THEN 'sheet' ELSE 'recognition' END AS kind FROM documents""",
    "json_quotes_typed": """SELECT o_orderkey AS quote_id, CASE WHEN o_orderkey % 11 = 0 THEN 'invalid_json' END AS failure_reason, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '업체 ' || o_orderkey END AS vendor_name,
 CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE CAST(round(o_totalprice) AS BIGINT) END AS total_supply_price, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0 THEN o_orderkey % 9 END AS delivery_weeks,
 0.5::DOUBLE AS extraction_confidence, CASE WHEN o_orderkey % 11 <> 0 THEN (CASE WHEN o_orderkey % 3 = 0 THEN 'DISPLAY' ELSE 'ETC' END) END AS category,
 CASE WHEN o_orderkey % 11 <> 0 THEN 1000.0 END::DOUBLE AS quantity, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 7 = 0 END AS is_optional FROM orders""",
    "quote_ids": with_marts(""" SELECT quote_id, CASE WHEN vendor_name IS NULL THEN 'unknown_vendor' WHEN quote_id % 3 = 0 THEN '주_' || replace(s_name, '#', '_') WHEN quote_id % 3 = 1 THEN replace(s_name, '#', '_') || '_주식회사' ELSE replace(s_name, '#', '_') END
  || '_' || strftime(received_at, '%Y%m%d_%H%M%S') || '_' || substr(sha256(CAST(quote_id AS VARCHAR)), 1, 8) AS new_id, false AS is_temporary, quote_id || '_opt2_LED_전광판_A' AS option_id
 FROM quotes LEFT JOIN supplier ON supp_key = s_suppkey""", LINES, QUOTES),
    "stale_embeddings": "SELECT s_name AS name FROM supplier WHERE s_acctbal < 0 OR s_suppkey % 4 = 0 OR s_suppkey % 7 = 0",
    "embedding_text": with_marts(""" SELECT project_id, concat_ws(chr(10), '고객사: ' || customer_name, '요청 요약: ' || request_summary, '카테고리: ' || category, '지역: ' || region,
 '설치 일정: ' || install_schedule_text, '예산 상한: ' || budget_max || '원', CASE WHEN len(required_keywords) > 0 THEN '키워드: ' || array_to_string(required_keywords, ', ') END) AS text FROM reqs""", REQUIREMENTS),
    "quote_embedding_text": with_marts(""" SELECT quote_id, concat_ws(chr(10), '업체명: ' || nullif(trim(vendor_name), ''), '공급가 합계: ' || total_supply_price, 'VAT 포함 총액: ' || total_with_vat,
 '납기 주수: ' || delivery_weeks || '주', '납기 원문: ' || delivery_basis_raw, '보증기간: ' || warranty_months || '개월', '비고: ' || nullif(trim(notes_raw), '')) AS text FROM quotes""", LINES, QUOTES),
    "partner_history_text": with_marts(""" SELECT s_name AS name, coalesce(h, '') AS history FROM supplier LEFT JOIN (SELECT supp_key, string_agg(solution || ' ' || n || '건', ', ' ORDER BY n DESC, solution) AS h FROM phist WHERE kept GROUP BY 1) ON supp_key = s_suppkey""", LINES, QUOTES, PARTNERS),
    "storage_projection": "SELECT doc_id, text AS source_text FROM documents",
    "json_round_trip": "SELECT o_orderkey AS quote_id, o_totalprice, o_orderstatus FROM orders",
    "stream_latest_state": LATEST,
    "stream_quote_intake": "SELECT sha256(text) AS file_hash, CASE WHEN trim(min(text)) = '' THEN 'empty_text' END AS reject_reason FROM documents GROUP BY 1",
}
