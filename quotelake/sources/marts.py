"""Domain tables derived from the order/line/part/supplier star schema.

``lines``, ``quotes``, ``requirements``, ``partners`` and ``vectors`` are the
inputs of every operator. Quotes and partners need all lines, so they are written
once to the shared folder and read from there, pruned to the columns a query uses.

Whole-quote figures use map-side-combinable aggregates (``min`` of a struct,
``sum``, ``count_if``) rather than windows, so one giant quote, project or
vendor is reduced on every executor before anything is shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.functions.expr import lookup
from quotelake.session import checkpoint_dir

# Business names shown for the star schema's part types, in type order.
TYPE_NAMES = {
    "STANDARD": "LED 전광판",
    "SMALL": "비디오월",
    "ECONOMY": "디지털 사이니지",
    "MEDIUM": "투명 OLED",
    "PROMO": "키오스크",
    "LARGE": "회의실 모니터",
}
TYPE_INDEX = {name: i for i, name in enumerate(TYPE_NAMES)}
SEGMENT_SOLUTION = {
    "FURNITURE": "키오스크 도입",
    "MACHINERY": "LED 전광판 교체",
    "BUILDING": "로비 비디오월",
    "AUTOMOBILE": "디지털 사이니지",
    "HOUSEHOLD": "기타 장비",
}
LINE_CATEGORY = {1: "DISPLAY", 2: "MOUNT", 3: "CABLE", 4: "PLAYER", 5: "SOFTWARE", 6: "INSTALL", 7: "ETC"}
LINE_WORD = {2: "브라켓", 3: "케이블", 4: "제어PC", 5: "CMS 소프트웨어", 6: "설치비", 7: "배송비"}
NOTES = {
    0: "설치비 별도",
    1: "설치비 : 미포함\n부가세 별도",
    2: "현장 시공 협의",
    3: "",
    4: "소프트웨어 별도",
    5: "출장실비 별도\nA/S 센터 입고",
    6: "설치비 포함, 현장 방문 A/S",
}
WARRANTY = {0: None, 1: 6, 2: 12, 3: 24, 4: 36}
SPEED = {0: "fast", 1: "normal", 2: "slow"}
FINANCE = {0: "good", 1: "normal", 2: "caution", 3: "bad"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files, be it one file or a folder of parts.

    The stream source takes a single file by a pattern only; the one here matches that name and no other.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def vector_count(spark: SparkSession, sf_dir: str) -> int:
    """Row count from Parquet footers; used only to wrap vector ids."""
    return table(spark, sf_dir, "embeddings").count()


LINE_ORDER = [
    "line_seq", "part_key", "supp_key", "l_extendedprice", "ship_date", "quantity", "l_discount", "l_tax",
]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per quoted line. Line order is ``LINE_ORDER`` (total up to exact copies)."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    total = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint")
    word = F.when(F.col("l_linenumber") == 1, lookup(F.col("p_type"), TYPE_NAMES)).otherwise(
        lookup(F.col("l_linenumber"), LINE_WORD)
    )
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .select(
            F.col("l_orderkey").alias("quote_id"),
            F.col("l_linenumber").alias("line_seq"),
            F.col("l_partkey").alias("part_key"),
            F.col("l_suppkey").alias("supp_key"),
            "l_extendedprice",
            F.col("l_shipdate").alias("ship_date"),
            F.col("l_quantity").alias("quantity"),
            "l_discount",
            "l_tax",
            total.alias("total_price"),
            F.expr("CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) div CAST(l_quantity AS BIGINT)").alias("unit_price"),
            lookup(F.col("l_linenumber"), LINE_CATEGORY).alias("category"),
            (F.col("l_linenumber") == 7).alias("is_optional"),
            F.concat_ws(" ", word, F.col("p_name")).alias("name"),
            F.concat(F.col("p_brand"), F.lit(" size "), F.col("p_size").cast("string")).alias("spec_raw"),
            "p_type",
        )
    )


def line_key() -> Column:
    return F.struct(*LINE_ORDER)


def quote_sums(line_df: DataFrame) -> DataFrame:
    """Per-quote figures in one map-side-combined pass over the lines."""
    return line_df.groupBy("quote_id").agg(
        F.min(F.struct(*LINE_ORDER, "p_type")).alias("first_line"),
        F.sum("total_price").alias("line_sum"),
        F.sum(F.when(~F.col("is_optional"), F.col("total_price"))).alias("priced_sum"),
        F.count("*").alias("line_count"),
        F.bool_or(F.col("category") == "INSTALL").alias("has_install"),
        F.max("ship_date").alias("last_ship"),
    )


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A mart written once per application to the shared folder; every branch of every query reads that one table.

    Inputs are taken as fixed while the application runs; :func:`forget` makes the next call write anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = f"{checkpoint_dir(spark).rstrip('/')}/marts-{uuid.uuid4().hex}/{name}"
        build(spark, sf_dir).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def forget() -> None:
    _stored.clear()


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per quote with the figures of its lines."""
    return stored(spark, sf_dir, "quotes", build_quotes)


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partner master: one row per supplier with delivery history from its lines."""
    return stored(spark, sf_dir, "partners", build_partners)


def build_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = vector_count(spark, sf_dir)
    sums = quote_sums(lines(spark, sf_dir))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    k = F.col("o_orderkey")
    days = F.datediff(F.col("last_ship"), F.col("o_orderdate"))
    weeks = F.when(days > 0, F.expr("CAST(1 + (datediff(last_ship, o_orderdate) % 84) div 7 AS INT)"))
    supply = (
        F.when(k % 10 == 0, F.lit(0).cast("bigint"))
        .when(k % 10 == 1, F.expr("(line_sum * 105) div 100"))
        .otherwise(F.col("line_sum"))
    )
    base = (
        o.join(sums, o.o_orderkey == sums.quote_id, "left")
        .drop("quote_id")
        .select(
            k.alias("quote_id"),
            F.col("o_custkey").alias("project_id"),
            k.alias("input_no"),
            F.col("o_orderdate").alias("received_at"),
            F.col("o_orderstatus").alias("status"),
            F.col("first_line.supp_key").alias("supp_key"),
            F.col("first_line.p_type").alias("product_type"),
            "line_sum",
            "priced_sum",
            F.coalesce("line_count", F.lit(0)).cast("bigint").alias("line_count"),
            F.coalesce("has_install", F.lit(False)).alias("has_install"),
            supply.alias("total_supply_price"),
            weeks.alias("delivery_weeks"),
            lookup(k % 5, WARRANTY).cast("int").alias("warranty_months"),
            lookup(k % 8, NOTES).alias("notes_raw"),
            F.when(k % 13 != 0, (7 * k + 3) % n).alias("vec_id"),
        )
    )
    w = F.col("delivery_weeks").cast("string")
    tax = F.when(
        F.col("quote_id") % 7 != 0,
        F.expr("(total_supply_price + 5) div 10")
        + F.when(F.col("quote_id") % 7 == 1, 30000).otherwise(0),
    )
    basis = (
        F.when(F.col("quote_id") % 6 == 0, F.lit("별도협의"))
        .when(F.col("quote_id") % 6 == 3, F.lit("재고 확인 후 안내"))
        .when(F.col("delivery_weeks").isNull(), F.lit(None))
        .when(F.col("quote_id") % 6 == 1, F.concat(F.lit("발주 후 "), w, F.lit("주 이내")))
        .when(F.col("quote_id") % 6 == 2, F.concat((F.col("delivery_weeks") * 7 - 2).cast("string"), F.lit("일")))
        .when(F.col("quote_id") % 6 == 5, F.concat((F.col("delivery_weeks") + 1).cast("string"), F.lit("주")))
        .otherwise(F.concat(w, F.lit("주")))
    )
    shift = F.when(F.col("quote_id") % 11 == 1, 20000).when(F.col("quote_id") % 11 == 2, 500000).otherwise(0)
    prefix = F.when(F.col("quote_id") % 3 == 0, F.lit("(주) ")).otherwise(F.lit(""))
    suffix = F.when(F.col("quote_id") % 3 == 1, F.lit(" 주식회사")).otherwise(F.lit(""))
    return (
        base.withColumn("tax_amount", tax)
        .withColumn("total_with_vat", F.col("total_supply_price") + F.col("tax_amount") + shift)
        .withColumn("delivery_basis_raw", basis)
        .join(s, base.supp_key == s.s_suppkey, "left")
        .withColumn("vendor_name", F.concat(prefix, F.col("s_name"), suffix))
        .drop("s_suppkey", "s_name")
    )


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = vector_count(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    schedule = (
        F.when(k % 11 == 0, F.lit(None))
        .when(k % 11 == 1, F.lit("일정 협의"))
        .when(k % 11 == 2, F.concat((1 + k % 4).cast("string"), F.lit("개월 이내")))
        .otherwise(F.concat((4 + k % 9).cast("string"), F.lit("주 이내")))
    )
    raw = (
        F.when(k % 7 == 0, F.lit("보증 2년 이상 요청"))
        .when(k % 7 == 1, F.lit("36개월 이상 보증"))
        .when(k % 7 == 2, F.lit("무상보증 12개월"))
        .otherwise(F.lit("일반 견적 요청"))
    )
    return c.join(na, c.c_nationkey == na.n_nationkey, "left").select(
        k.alias("project_id"),
        F.col("c_name").alias("customer_name"),
        F.col("n_name").alias("region"),
        lookup(F.col("c_mktsegment"), SEGMENT_SOLUTION).alias("category"),
        F.when(k % 4 == 0, F.lit("비디오월 포함 요청")).otherwise(F.lit("일반 요청")).alias("request_summary"),
        raw.alias("raw_text"),
        schedule.alias("install_schedule_text"),
        F.when(k % 5 != 0, (k % 50 + 1) * 1000000).alias("budget_max"),
        F.when(k % 6 == 0, F.array(F.lit("투명 OLED"), F.lit("현장설치")))
        .when(k % 6 == 1, F.array(F.lit("보증"), F.lit("키오스크")))
        .otherwise(F.array().cast("array<string>"))
        .alias("required_keywords"),
        (k % n).alias("vec_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def build_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = vector_count(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    history = (
        lines(spark, sf_dir)
        .groupBy("supp_key", "p_type")
        .agg(F.count("*").cast("int").alias("n"))
        .withColumn("solution", lookup(F.col("p_type"), TYPE_NAMES))
        .withColumn("kept", (lookup(F.col("p_type"), TYPE_INDEX) + F.col("supp_key")) % 3 == 0)
        .groupBy("supp_key")
        .agg(
            F.sum("n").cast("int").alias("installation_count"),
            F.array_compact(
                F.collect_list(F.when(F.col("kept"), F.struct((-F.col("n")).alias("neg"), "solution")))
            ).alias("entries"),
        )
    )
    ordered = F.array_sort(F.col("entries"))
    return (
        s.join(history, s.s_suppkey == history.supp_key, "left")
        .select(
            F.col("s_name").alias("name"),
            k.alias("supp_key"),
            (k % 9 == 0).alias("is_premium"),
            ((k % 20) / F.lit(100.0)).alias("success_rate"),
            F.when(k % 17 != 0, lookup(k % 3, SPEED)).alias("response_speed"),
            lookup(k % 4, FINANCE).alias("financial_status"),
            (F.col("s_acctbal") < 0).alias("is_excluded"),
            F.col("installation_count"),
            F.transform(F.slice(ordered, 1, 2), lambda e: e["solution"]).alias("specialty_tags"),
            F.map_from_entries(
                F.transform(ordered, lambda e: F.struct(e["solution"], (-e["neg"]).cast("int")))
            ).alias("solution_breakdown"),
            F.when(k % 23 != 0, (11 * k + 5) % n).alias("vec_id"),
            F.concat(F.lit("본사 "), F.col("s_nationkey").cast("string")).alias("company_location"),
        )
        .withColumn("specialty_tags", F.coalesce("specialty_tags", F.array().cast("array<string>")))
    )


def product_group_of(product_type: Column) -> Column:
    """Product group of a quote whose leading product type is known."""
    groups = {
        "STANDARD": "LED전광판", "SMALL": "비디오월", "ECONOMY": "사이니지",
        "MEDIUM": "투명디스플레이", "PROMO": "키오스크", "LARGE": "디스플레이",
    }
    return F.coalesce(lookup(product_type, groups), F.lit("미분류"))


def project_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("project_id"),
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("status"),
        "value",
        "props",
    )
