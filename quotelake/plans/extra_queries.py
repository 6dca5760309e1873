"""Registered queries for request intake, grids, candidate edits, context maps, cards, category lists and embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelake.functions.money import amounts_in, dates_in, quantity_unit
from quotelake.functions.rules import initial_category
from quotelake.operators import evaluate as ev
from quotelake.operators import explain as e
from quotelake.operators import requests as rq
from quotelake.operators import similarity as sim
from quotelake.operators import specs as s
from quotelake.operators.extract import lines_of
from quotelake.plans.check_queries import ORACLE as CHECK_SQL
from quotelake.plans.mart_sql import LINES, with_marts
from quotelake.plans.ranking_queries import BY_PROJECT, PARTS, ranked_sql
from quotelake.plans.reason_queries import cards_of
from quotelake.plans.record_queries import ORACLE as RECORD_SQL
from quotelake.sources import intake as i
from quotelake.sources import lifecycle as lc
from quotelake.sources import marts as m


def request_intake(spark, d):
    """Every chat turn as a request text: accepted, or on the failure list."""
    turns = m.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("request_text"))
    return rq.intake_requests(turns).select("conv_id", "turn", "failure_reason")


def dense_grids(spark, d):
    """Recognised cells of every order, filled up to a whole grid."""
    cells = m.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("quote_id"), F.lit(1).alias("table_no"), F.col("l_linenumber").cast("int").alias("row_no"),
        (F.col("l_quantity").cast("int") % 4 + 1).alias("col_no"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("value"))
    return i.dense_grid(cells).select("quote_id", "row_no", "col_no", "value")


def edit_candidates(spark, d):
    """Candidates keyed by project and vendor class; an edit overwrites only what it names."""
    by = m.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("vendor_name"))
    now = by.agg(F.max("o_totalprice").alias("price"), F.max("o_orderstatus").alias("memo"))
    edits = by.agg(F.when(F.count("*") > 1, F.min("o_totalprice")).alias("price"), F.when(F.max("o_orderstatus") == "P", F.lit("확인")).alias("memo"))
    return lc.patch(now, edits, ["project_id", "vendor_name"], ["price", "memo"])


def line_context(spark, d):
    """Specification map of every line over its document's context."""
    li = m.lines(spark, d)
    own = F.when(F.col("category") == "DISPLAY", F.create_map(F.lit("spec"), F.col("spec_raw")))
    context = F.create_map(F.lit("spec"), F.col("name"), F.lit("kind"), F.col("category"))
    merged = li.withColumn("spec", s.merge_context(own, context))
    return merged.select("quote_id", "line_seq", "part_key", "supp_key", F.col("spec")["spec"].alias("spec"), F.col("spec")["kind"].alias("kind"))


def rank_cards(spark, d):
    """Card of each of the first three suppliers, by quote id or else by vendor name."""
    base = cards_of(spark, d)
    card = lambda kind, k: F.concat(F.lit(f"{kind} "), k)
    cards = base.select(
        "record_id", F.when(F.col("rank") != 2, F.col("quote_id")).alias("quote_id"), F.col("vendor_name"), F.col("rank").alias("position"),
        card("카드", F.col("quote_id")).alias("card_summary"))
    return e.attach_cards(base.select("record_id", "quote_id", "vendor_name", "rank"), cards).select("record_id", "quote_id", "card_summary")


def category_sequences(spark, d):
    """Whether the first categories of a quote's lines equal the stated ones, in order."""
    order = ["line_seq", "part_key", "supp_key", "l_extendedprice"]
    li = m.lines(spark, d).withColumn("first", initial_category(F.col("name"), F.col("spec_raw")))
    listed = li.groupBy("quote_id").agg(F.sort_array(F.collect_list(F.struct(*order, "category", "first"))).alias("x"))  # lines of one quote
    return listed.select("quote_id", ev.same_categories(F.col("x.category"), F.col("x.first")).alias("same"))


def embed_requests(spark, d):
    """The embedding hook with a model that measures texts."""
    texts = m.requirements(spark, d).select("project_id", sim.requirement_text().alias("text"))
    measured = sim.embed(texts, "text", lambda batch: [[float(len(t)), float(t.count("\n"))] for t in batch], 2)
    return measured.select("project_id", F.col("vec")[0].alias("chars"), F.col("vec")[1].alias("breaks"))


def _figures(texts, key):
    """Amounts, dates, quantities and durations of texts that nobody prepared for these rules."""
    t = F.col("text")
    staged = texts.withColumn("_amounts", amounts_in(t)).withColumn("_dates", dates_in(t))
    number, unit = quantity_unit(t)
    return staged.select(
        key, F.size("_amounts").alias("n_amounts"), F.array_max("_amounts").alias("largest"), F.size("_dates").alias("n_dates"),
        number.alias("quantity"), unit.alias("unit"), F.size(lines_of(t)).alias("n_lines"))


def document_figures(spark, d):
    return _figures(m.table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def page_figures(spark, d):
    """The same on web pages, tags taken out."""
    return _figures(m.table(spark, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text")), "page_id")


QUERIES = {f.__name__: f for f in (
    request_intake, dense_grids, edit_candidates, line_context, rank_cards, category_sequences, embed_requests,
    document_figures, page_figures)}



def _figures_sql(texts: str, key: str) -> str:
    """Written from the rules: comma groups or five digits and more; a number and a unit word, else the first number."""
    words = "EA|SETS|SET|식|개|대|조|매|units|unit"
    strict, loose = rf"(\d+(?:\.\d+)?)[\s]+({words})(?:[^\p{{L}}\p{{N}}_]|$)", rf"(\d+(?:\.\d+)?)\s*({words})?"
    return rf"""WITH t AS ({texts}), x AS (SELECT *, [TRY_CAST(replace(a, ',', '') AS BIGINT) FOR a IN regexp_extract_all(text, '(\d{{1,3}}(?:,\d{{3}})+|\d{{5,}})')] AS amounts,
  [[TRY_CAST(regexp_extract(g, '(\d{{4}})[.\-/년\s]+(\d{{1,2}})[.\-/월\s]+(\d{{1,2}})', 1) AS INT), TRY_CAST(regexp_extract(g, '(\d{{4}})[.\-/년\s]+(\d{{1,2}})[.\-/월\s]+(\d{{1,2}})', 2) AS INT), TRY_CAST(regexp_extract(g, '(\d{{4}})[.\-/년\s]+(\d{{1,2}})[.\-/월\s]+(\d{{1,2}})', 3) AS INT)]
   FOR g IN regexp_extract_all(text, '\d{{4}}[.\-/년\s]+\d{{1,2}}[.\-/월\s]+\d{{1,2}}')] AS days,
  nullif(regexp_extract(text, '(?i){strict}', 1), '') AS n1, nullif(regexp_extract(text, '(?i){loose}', 1), '') AS n2,
  nullif(regexp_extract(text, '(?i){strict}', 2), '') AS u1, nullif(regexp_extract(text, '(?i){loose}', 2), '') AS u2 FROM t)
SELECT k AS {key}, len(amounts)::INT AS n_amounts, list_max(amounts) AS largest,
 len([y FOR y IN days IF y[1] BETWEEN 2000 AND 2100 AND TRY_CAST(y[1] || '-' || y[2] || '-' || y[3] AS DATE) IS NOT NULL])::INT AS n_dates,
 coalesce(n1, n2)::DOUBLE AS quantity, coalesce(u1, u2) AS unit, len(regexp_split_to_array(text, '\r\n|\r|\n'))::INT AS n_lines FROM x"""


_CATEGORY = CHECK_SQL["initial_categories"]
ORACLE = {
    "request_intake": """SELECT conv_id, turn, CASE WHEN text IS NULL OR lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) IN ('', '미입력', '없음', 'null', 'undefined', 'none')
 THEN 'empty_request_text' END AS failure_reason FROM conversations""",
    "dense_grids": """WITH c AS (SELECT l_orderkey AS q, l_linenumber::INT AS r, (l_quantity::INT % 4 + 1)::INT AS c, max(concat_ws(' ', l_returnflag, l_linestatus)) AS v FROM lineitem GROUP BY ALL),
s AS (SELECT q, max(r) AS h, max(c) AS w FROM c GROUP BY q), rows AS (SELECT q, w, unnest(range(1, h + 1)) AS r FROM s), g AS (SELECT q, r, unnest(range(1, w + 1)) AS c FROM rows)
SELECT g.q AS quote_id, g.r::INT AS row_no, g.c::INT AS col_no, coalesce(v, '') AS value FROM g LEFT JOIN c ON c.q = g.q AND c.r = g.r AND c.c = g.c""",
    "edit_candidates": """SELECT o_custkey AS project_id, o_orderpriority AS vendor_name, min(o_totalprice) AS price,
 CASE WHEN max(o_orderstatus) = 'P' THEN '확인' ELSE max(o_orderstatus) END AS memo FROM orders GROUP BY 1, 2""",
    "line_context": with_marts(""" SELECT quote_id, line_seq, part_key, supp_key, CASE WHEN category = 'DISPLAY' THEN spec_raw ELSE name END AS spec, category AS kind FROM lines""", LINES),
    "rank_cards": with_marts(ranked_sql(BY_PROJECT) + """, t AS (SELECT project_id, quote_id, vendor_name, rank FROM ranked WHERE rank <= 3)
 SELECT t.project_id AS record_id, t.quote_id::VARCHAR AS quote_id, CASE WHEN rank <> 2 THEN '카드 ' || t.quote_id
  ELSE coalesce('카드 ' || (SELECT arg_min(o.quote_id, o.rank) FROM t o WHERE o.project_id = t.project_id AND o.vendor_name = t.vendor_name AND o.vendor_name <> ''), '') END AS card_summary FROM t""", *PARTS),
    "category_sequences": f"""SELECT l.quote_id, bool_and(l.category = i.first_category) AS same FROM (
 SELECT DISTINCT l_orderkey AS quote_id, l_linenumber AS line_seq, l_partkey AS part_key, l_suppkey AS supp_key,
  CASE l_linenumber WHEN 1 THEN 'DISPLAY' WHEN 2 THEN 'MOUNT' WHEN 3 THEN 'CABLE' WHEN 4 THEN 'PLAYER' WHEN 5 THEN 'SOFTWARE' WHEN 6 THEN 'INSTALL' WHEN 7 THEN 'ETC' END AS category
 FROM lineitem) l JOIN ({_CATEGORY}) i USING (quote_id, line_seq, part_key, supp_key) GROUP BY l.quote_id""",
    "embed_requests": f"""SELECT project_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS breaks
 FROM ({RECORD_SQL["embedding_text"]})""",
    "document_figures": _figures_sql("SELECT doc_id AS k, text FROM documents", "doc_id"),
    "page_figures": _figures_sql("SELECT page_id AS k, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages", "page_id"),
}
