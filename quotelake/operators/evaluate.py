"""Extraction accuracy, ranking quality and soundness of generated reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions.expr import contains_any, messages

# Phrases that may not appear in reasons, and words of critical checks.
BANNED_PHRASES = ["과도히", "과도하게", "과도", "완전히", "완전", "최고 수준", "최고의", "만점", "정도도"]
CRITICAL_WORDS = ["비정상", "미기재", "범위 밖", "미매칭", "산정 불일치", "순위 산정", "rank 불일치"]
UNKNOWN_VENDOR = ["", "미상", "불명", "업체 미확인", "확인 필요"]
RANK_MENTIONS = [
    ["순위", "점수", "불일치"], ["순위", "점수", "낮"], ["순위", "점수", "높"], ["rank", "score", "mismatch"],
    ["산정 기준 확인"], ["순위와 점수"],
]
LUMPING_PHRASES = ["모두 우수", "둘 다 우수", "함께 우수", "공통적으로 우수", "모두 양호", "둘 다 양호", "상위 두 후보 모두"]
GAP_PHRASES = [
    "가장 우수", "최상위", "상위", "낮은 편", "열세", "다소 낮", "상대적으로 낮", "큰 차이", "두드러진", "상당한", "격차",
]
SCORE_GAP = 50
MAX_WEAKNESSES = 2


# ------------------------------------------------------------------------- accuracy


def compare_fields(expected: DataFrame, actual: DataFrame, key: str = "case_id") -> DataFrame:
    """Null-safe comparison of long (case, field, value) tables; undefined fields are not compared."""
    a = actual.select(key, "field", F.col("value").alias("actual_value"))
    return expected.withColumnRenamed("value", "expected_value").join(a, [key, "field"], "left").withColumn(
        "ok", F.col("expected_value").eqNullSafe(F.col("actual_value"))
    )


def to_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Wide columns as (key, field, value) rows."""
    entries = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(key, F.explode(entries).alias("e")).select(key, "e.field", "e.value")


def field_accuracy(compared: DataFrame) -> DataFrame:
    """Passed, total and pass rate per field, and over all fields (field NULL)."""
    return compared.rollup("field").agg(
        F.count_if("ok").alias("passed"), F.count("*").alias("total"),
        F.round(F.count_if("ok") / F.count("*") * 100, 1).alias("pass_rate"),
    )


def same_categories(expected: Column, actual: Column) -> Column:
    """Ordered list equality."""
    return expected.eqNullSafe(actual)


# ------------------------------------------------------------------ ranking quality


def ranking_quality(ranked: DataFrame, key: str, k: int = 3) -> DataFrame:
    """Recall@k, MRR and Precision@k over queries; ``ranked`` has rank and relevant.

    Two map-side-combined aggregates; no query is gathered in one place.
    """
    rel = F.col("relevant")
    top = (F.col("rank") <= k) & rel
    per = ranked.groupBy(key).agg(
        F.bool_or(rel).alias("has_relevant"),
        F.coalesce(F.bool_or(top), F.lit(False)).cast("double").alias("hit"),
        F.coalesce(1.0 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("rr"),
        (F.count_if(top) / F.lit(float(k))).alias("precision"),
    )
    judged = per.where("has_relevant")
    return judged.agg(
        F.count("*").alias("query_count"),
        F.round(F.avg("hit"), 6).alias("recall_at_k"),
        F.round(F.avg("rr"), 6).alias("mrr"),
        F.round(F.avg("precision"), 6).alias("precision_at_k"),
    )


# ----------------------------------------------------------------------- violations


def card_text() -> Column:
    return F.concat_ws(" ", "card_summary", F.array_join("strengths", " "), F.array_join("weaknesses", " "))


def card_violations(cards: DataFrame, items: DataFrame, check_words: int | None = None) -> DataFrame:
    """Violation categories of every generated card against its source record.

    ``check_words`` looks for the first words of a check only.

    ``cards``: record_id, quote_id, vendor_name, card_summary, strengths, weaknesses.
    ``items``: record_id, quote_id, vendor_name, check_required, warranty_months,
    total_supply_price, total_with_vat, delivery_weeks.
    """
    src = items.select(
        "record_id", "quote_id", F.col("vendor_name").alias("source_vendor"), "check_required", "warranty_months",
        "total_supply_price", "total_with_vat", "delivery_weeks", F.lit(True).alias("known"),
    )
    joined = cards.join(src, ["record_id", "quote_id"], "left").withColumn("_text", card_text())
    text = F.col("_text")
    known = F.coalesce("known", F.lit(False))
    weak = F.array_join("weaknesses", "\n")
    said = contains_any(weak, CRITICAL_WORDS)
    every = lambda s: F.filter(F.regexp_extract_all(s, F.lit("([가-힣A-Za-z0-9]+)"), F.lit(1)), lambda w: F.length(w) >= 2)
    words = lambda s: F.slice(every(s), 1, check_words) if check_words else every(s)
    unreported = F.exists(
        "check_required",
        lambda s: contains_any(s, CRITICAL_WORDS) & (F.size(words(s)) > 0)
        & ~(said & F.exists(words(s), lambda w: weak.contains(w))),
    )
    stated = lambda unit: F.transform(
        F.regexp_extract_all(text, F.lit(rf"(\d[\d,]*)\s*{unit}"), F.lit(1)),
        lambda p: F.replace(p, F.lit(","), F.lit("")).try_cast("bigint"),
    )
    supply = F.coalesce("total_supply_price", F.lit(0))
    # an amount in 원 is the supply price itself, one in 만원 its whole ten thousands
    other = lambda unit, want: F.exists(stated(unit), lambda p: (supply == 0) | (p != want))
    invented = other("원", supply) | other("만원", F.expr("coalesce(total_supply_price, 0) div 10000"))
    found = messages(
        *[(text.contains(w), "banned_phrase") for w in BANNED_PHRASES],
        (known & F.coalesce(unreported, F.lit(False)), "check_required_missing"),
        (
            known & (F.coalesce("source_vendor", F.lit("")) == "") & ~F.coalesce("vendor_name", F.lit("")).isin(UNKNOWN_VENDOR),
            "vendor_guess",
        ),
        (known & F.col("warranty_months").isNull() & text.rlike(r"보증.{0,5}(\d+)\s*(개월|년)"), "warranty_guess"),
        (known & F.col("total_with_vat").isNull() & F.coalesce(invented, F.lit(False)), "price_guess"),
        (known & F.col("delivery_weeks").isNull() & text.rlike(r"납기.{0,5}(\d+)\s*(주|일)"), "delivery_guess"),
        (F.size("weaknesses") > MAX_WEAKNESSES, "weakness_too_many"),
    )
    return joined.withColumn("categories", found).drop("_text", "known")


def vendor_context_guess(cards: DataFrame, items: DataFrame) -> DataFrame:
    """Cards of a nameless source that mention another vendor of the same record (at most three per record)."""
    nameless = items.where(F.coalesce("vendor_name", F.lit("")) == "").select("record_id", "quote_id")
    names = items.where(F.length("vendor_name") >= 2).groupBy("record_id").agg(F.collect_set("vendor_name").alias("names"))
    open_cards = cards.join(nameless, ["record_id", "quote_id"], "left_semi").join(names, "record_id")
    hit = F.exists("names", lambda n: card_text().contains(n))
    return open_cards.where(F.coalesce("vendor_name", F.lit("")).isin(UNKNOWN_VENDOR) & hit).select(
        "record_id", "quote_id", F.array(F.lit("vendor_guess_from_context")).alias("categories")
    )


def record_violations(cards: DataFrame, items: DataFrame) -> DataFrame:
    """Record-level categories: silence about a rank/score conflict and blurring of a large score gap.

    A record holds its top three cards, so gathering their text per record is bounded.
    """
    texts = cards.groupBy("record_id").agg(
        F.array_join(F.array_sort(F.collect_list(card_text())), " ").alias("all_text")
    )
    scores = items.groupBy("record_id").agg(
        F.max("final_score").alias("hi"), F.min("final_score").alias("lo"), F.count("final_score").alias("n"),
        F.min_by("final_score", "rank").alias("first"),
    )
    both = scores.join(texts, "record_id")
    t = F.col("all_text")
    told = F.lit(False)
    for group in RANK_MENTIONS:
        cond = F.lit(True)
        for word in group:
            cond = cond & t.contains(word)
        told = told | cond
    gap = (F.col("n") >= 2) & (F.col("hi") - F.col("lo") > SCORE_GAP)
    blurred = contains_any(t, LUMPING_PHRASES) | (~contains_any(t, GAP_PHRASES) & t.contains("우수"))
    return both.select(
        "record_id",
        messages(
            ((F.col("n") >= 2) & (F.col("first") < F.col("hi")) & ~told, "rank_score_mismatch"),
            (gap & blurred, "score_gap_ignored"),
        ).alias("categories"),
    )


def violation_rates(records: DataFrame, group: str) -> DataFrame:
    """Rate of records with any violation per group, over records that have an output.

    ``records``: group, categories (NULL when the output is missing), provider.
    """
    has = F.col("categories").isNotNull()
    bad = F.coalesce(F.size("categories") > 0, F.lit(False))
    return records.groupBy(group).agg(
        F.count_if(has).alias("total_llm"),
        F.count_if(bad).alias("violations_raw"),
        F.round(F.try_divide(F.count_if(bad), F.count_if(has)), 6).alias("violation_rate_primary"),
        F.round(F.count_if(~has) / F.count("*"), 6).alias("fallback_rate"),
        F.count("*").alias("total_records"),
    )


def category_counts(records: DataFrame, group: str) -> DataFrame:
    return records.select(group, F.explode("categories").alias("category")).groupBy(group, "category").count()
