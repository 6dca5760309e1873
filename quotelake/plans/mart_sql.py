"""The derived tables again as plain SQL, used as the prefix of every oracle query."""

from __future__ import annotations

from quotelake.sources import marts as m


def case(expr: str, table: dict, default: str = "NULL") -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def r2(expr: str) -> str:
    return f"(round_even(({expr})*100.0, 0)/100.0)"


NOTES_SQL = case("(o_orderkey % 8)", m.NOTES).replace("\n", "' || chr(10) || '")

LINES = f"""
lines AS (
 SELECT l_orderkey AS quote_id, l_linenumber AS line_seq, l_partkey AS part_key, l_suppkey AS supp_key,
  l_extendedprice, l_shipdate AS ship_date, l_quantity AS quantity, l_discount, l_tax,
  CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS total_price,
  CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS unit_price,
  {case('l_linenumber', m.LINE_CATEGORY)} AS category, (l_linenumber = 7) AS is_optional,
  (CASE WHEN l_linenumber = 1 THEN {case('p_type', m.TYPE_NAMES)} ELSE {case('l_linenumber', m.LINE_WORD)} END)
    || ' ' || p_name AS name,
  p_brand || ' size ' || CAST(p_size AS VARCHAR) AS spec_raw, p_type,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    l_shipdate, l_quantity, l_discount, l_tax) AS line_no
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""

QUOTES = f"""
nvec AS (SELECT count(*) AS n FROM embeddings),
qsums AS (
 SELECT quote_id AS qk, max(CASE WHEN line_no = 1 THEN supp_key END) AS supp_key,
  max(CASE WHEN line_no = 1 THEN p_type END) AS product_type,
  CAST(sum(total_price) AS BIGINT) AS line_sum,
  CAST(sum(CASE WHEN NOT is_optional THEN total_price END) AS BIGINT) AS priced_sum,
  count(*) AS line_count, bool_or(category = 'INSTALL') AS has_install, max(ship_date) AS last_ship
 FROM lines GROUP BY quote_id),
qbase AS (
 SELECT o_orderkey AS quote_id, o_custkey AS project_id, o_orderkey AS input_no, o_orderdate AS received_at,
  o_orderstatus AS status, supp_key, product_type, line_sum, priced_sum,
  coalesce(line_count, 0) AS line_count, coalesce(has_install, false) AS has_install,
  CASE WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 10 = 1 THEN (line_sum * 105) // 100
   ELSE line_sum END AS total_supply_price,
  CASE WHEN datediff('day', o_orderdate, last_ship) > 0
   THEN CAST(1 + (datediff('day', o_orderdate, last_ship) % 84) // 7 AS INT) END AS delivery_weeks,
  {case('(o_orderkey % 5)', m.WARRANTY)} AS warranty_months, {NOTES_SQL} AS notes_raw,
  CASE WHEN o_orderkey % 13 <> 0 THEN (7 * o_orderkey + 3) % n END AS vec_id
 FROM orders LEFT JOIN qsums ON o_orderkey = qk CROSS JOIN nvec),
qtax AS (
 SELECT *, CASE WHEN quote_id % 7 <> 0 THEN (total_supply_price + 5) // 10
   + (CASE WHEN quote_id % 7 = 1 THEN 30000 ELSE 0 END) END AS tax_amount FROM qbase),
quotes AS (
 SELECT qtax.*, total_supply_price + tax_amount
   + (CASE quote_id % 11 WHEN 1 THEN 20000 WHEN 2 THEN 500000 ELSE 0 END) AS total_with_vat,
  CASE WHEN quote_id % 6 = 0 THEN '별도협의' WHEN quote_id % 6 = 3 THEN '재고 확인 후 안내'
   WHEN delivery_weeks IS NULL THEN NULL
   WHEN quote_id % 6 = 1 THEN '발주 후 ' || delivery_weeks || '주 이내'
   WHEN quote_id % 6 = 2 THEN (delivery_weeks * 7 - 2) || '일'
   WHEN quote_id % 6 = 5 THEN (delivery_weeks + 1) || '주' ELSE delivery_weeks || '주' END AS delivery_basis_raw,
  (CASE WHEN quote_id % 3 = 0 THEN '(주) ' ELSE '' END) || s_name
   || (CASE WHEN quote_id % 3 = 1 THEN ' 주식회사' ELSE '' END) AS vendor_name
 FROM qtax LEFT JOIN supplier ON supp_key = s_suppkey)"""

REQUIREMENTS = f"""
reqs AS (
 SELECT c_custkey AS project_id, c_name AS customer_name, n_name AS region,
  {case('c_mktsegment', m.SEGMENT_SOLUTION)} AS category,
  CASE WHEN c_custkey % 4 = 0 THEN '비디오월 포함 요청' ELSE '일반 요청' END AS request_summary,
  CASE c_custkey % 7 WHEN 0 THEN '보증 2년 이상 요청' WHEN 1 THEN '36개월 이상 보증'
   WHEN 2 THEN '무상보증 12개월' ELSE '일반 견적 요청' END AS raw_text,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN '일정 협의'
   WHEN c_custkey % 11 = 2 THEN (1 + c_custkey % 4) || '개월 이내'
   ELSE (4 + c_custkey % 9) || '주 이내' END AS install_schedule_text,
  CASE WHEN c_custkey % 11 IN (0, 1) THEN NULL WHEN c_custkey % 11 = 2 THEN (1 + c_custkey % 4) * 4
   ELSE 4 + c_custkey % 9 END AS required_weeks,
  CASE c_custkey % 7 WHEN 0 THEN 24 WHEN 1 THEN 36 ELSE 12 END AS target_months,
  CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 50 + 1) * 1000000 END AS budget_max,
  CASE WHEN c_custkey % 6 = 0 THEN ['투명 OLED', '현장설치'] WHEN c_custkey % 6 = 1 THEN ['보증', '키오스크']
   ELSE [] END AS required_keywords,
  c_custkey % (SELECT count(*) FROM embeddings) AS vec_id
 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""

VECTORS = """
vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"""

PARTNERS = f"""
phist AS (
 SELECT supp_key, {case('p_type', m.TYPE_NAMES)} AS solution, count(*) AS n,
  ({case('p_type', m.TYPE_INDEX)} + supp_key) % 3 = 0 AS kept
 FROM lines GROUP BY supp_key, p_type),
pinst AS (SELECT supp_key AS pk, CAST(sum(n) AS INT) AS installation_count FROM phist GROUP BY supp_key),
partners AS (
 SELECT s_name AS name, s_suppkey AS supp_key, s_suppkey % 9 = 0 AS is_premium, (s_suppkey % 20) / 100.0::DOUBLE AS success_rate,
  CASE WHEN s_suppkey % 17 <> 0 THEN {case('(s_suppkey % 3)', m.SPEED)} END AS response_speed,
  {case('(s_suppkey % 4)', m.FINANCE)} AS financial_status, s_acctbal < 0 AS is_excluded, installation_count,
  CASE WHEN s_suppkey % 23 <> 0 THEN (11 * s_suppkey + 5) % (SELECT count(*) FROM embeddings) END AS vec_id,
  '본사 ' || s_nationkey AS company_location
 FROM supplier LEFT JOIN pinst ON s_suppkey = pk)"""

GROUP_CASE = (
    "coalesce("
    + case(
        "product_type",
        {
            "STANDARD": "LED전광판", "SMALL": "비디오월", "ECONOMY": "사이니지",
            "MEDIUM": "투명디스플레이", "PROMO": "키오스크", "LARGE": "디스플레이",
        },
    )
    + ", '미분류')"
)


def with_marts(body: str, *parts: str, recursive: bool = False) -> str:
    """``WITH`` prefix holding the chosen derived tables, then ``body``.

    ``body`` may open with further CTEs: start it with a comma.
    """
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join(parts) + "\n" + body.strip()


CORE = (LINES, QUOTES, REQUIREMENTS, VECTORS)
