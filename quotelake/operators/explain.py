"""Short reasons for the top quotes: templates, clean-up of generated texts, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions.expr import contains_any, messages, once, one_space
from quotelake.operators.scale import best_per_group

# Message classes and the short forms of risk texts.
PARSER_NOTE_WORDS = [
    "프로젝트명", "파일명 기준", "문서에서 명확히 추출", "parser", "Parser", "OCR", "item_name", "spec_raw", "파싱", "fallback",
    "보정됨", "파일명",
]
DECISION_WORDS = [
    "납기", "별도협의", "가격 차이", "5% 초과", "공급가+VAT", "총액", "금액", "설치 범위", "설치 포함", "공사 별도", "보증",
    "확인 필요", "차이",
]
COMPARISON_WORDS = ["가격 차이 5% 초과", "최저가 대비", "Top3 평균 대비", "다른 업체 대비", "사양 점수 낮음", "최종 점수 낮음"]
RISK_SHORT = [
    (r"납기\s*정보가?\s*미기재.*", "납기 정보 미기재"), (r"납기\s*미기재.*", "납기 정보 미기재"),
    (r".*납기\s*별도협의.*", "납기 별도협의"), (r".*가격\s*차이\s*5%\s*초과.*", "가격 차이 5% 초과"),
    (r".*가격.*5%\s*이상.*", "가격 차이 5% 초과"), (r".*비용\s*검토.*", "가격 차이 5% 초과"),
    (r".*공급가\+VAT.*총액.*차이.*", "총액 차이 확인 필요"), (r".*견적서\s*총액.*차이.*", "총액 차이 확인 필요"),
    (r".*총액.*확인.*", "총액 차이 확인 필요"), (r".*설치.*범위.*확인.*", "설치 범위 확인 필요"),
    (r".*일부.*공사.*별도.*", "일부 공사 별도"), (r".*보증.*확인.*", "보증기간 확인 필요"),
]
NO_RISK = "특이 리스크 없음"
NO_STRENGTH = "비교 검토 가능"
ADVANTAGE_WORDS = ["우수", "최고", "명확", "경쟁력", "강점"]
EMPTY_SUMMARY = "추천 가능한 공급사 정보가 없습니다. 견적 데이터와 필터 조건 확인이 필요합니다."


def is_parser_note(text: Column) -> Column:
    return contains_any(text, PARSER_NOTE_WORDS)


def is_comparison(text: Column) -> Column:
    return contains_any(text, COMPARISON_WORDS)


def short_risk(text: Column, chars: int | None = None) -> Column:
    """Canonical short form of a risk message; ``chars`` cuts messages that have none."""
    clean = one_space(text)
    out = F.when(clean.rlike(RISK_SHORT[0][0]), RISK_SHORT[0][1])
    for pattern, short in RISK_SHORT[1:]:
        out = out.when(clean.rlike(pattern), short)
    rest = F.replace(F.replace(clean, F.lit("되어 추가 확인 필요"), F.lit("")), F.lit("추가 확인 필요"), F.lit(""))
    return out.otherwise(F.substring(rest, 1, chars) if chars else rest)


def risk_key(text: Column, chars: int | None = None) -> Column:
    """Key under which two risk messages count as the same."""
    t = short_risk(text, chars)
    for word in ["확인 필요", "추가", "되어"]:
        t = F.replace(t, F.lit(word), F.lit(""))
    return F.regexp_replace(t, r"[\s.,·/()]+", "")


def decision_risks(checks: Column) -> Column:
    """Messages that matter for the decision; parser and comparison notes left out."""
    clean = F.transform(checks, lambda s: one_space(s))
    return F.filter(clean, lambda s: (s != "") & ~is_parser_note(s) & ~is_comparison(s) & contains_any(s, DECISION_WORDS))


def parser_notes(checks: Column) -> Column:
    return F.filter(F.transform(checks, lambda s: one_space(s)), lambda s: (s != "") & is_parser_note(s))


def split_comparison(df: DataFrame) -> DataFrame:
    """operational_checks and relative_risks (one per risk key) from checks, risks and rule warnings."""
    clean = lambda c: F.transform(F.col(c), lambda s: one_space(s))
    checks = clean("check_required")
    relative = F.filter(F.concat(checks, clean("comparison_risks"), clean("rule_warnings")), lambda s: is_comparison(s))
    staged = once(df, "_rel", relative)
    staged = once(staged, "_keys", F.transform("_rel", lambda s: risk_key(s)))
    first = F.filter("_rel", lambda s, i: F.array_position("_keys", F.get("_keys", i)) == i + 1)
    return (
        staged.withColumn("relative_risks", first)
        .withColumn("operational_checks", F.array_distinct(F.filter(checks, lambda s: (s != "") & ~is_comparison(s))))
        .drop("_rel", "_keys")
    )


def first_of(values: Column, n: int | None) -> Column:
    """The first ``n`` of an array; all where no number is named."""
    return F.slice(values, 1, n) if n else values


def short_list(df: DataFrame, out: str, values: Column, limit: int | None = None, default: str = NO_RISK) -> DataFrame:
    """Short risks with different keys (the first ``limit``, where named), ``default`` when there is none."""
    staged = once(df, "_short", F.filter(F.transform(values, lambda s: short_risk(s)), lambda s: s != ""))
    staged = once(staged, "_keys", F.transform("_short", lambda s: risk_key(s)))
    kept = first_of(F.filter("_short", lambda s, i: F.array_position("_keys", F.get("_keys", i)) == i + 1), limit)
    return staged.withColumn(out, F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default)))).drop("_short", "_keys")


def _delivery_open() -> Column:
    return F.exists("check_required", lambda s: s.contains("납기 정보 미기재") | s.contains("납기 별도협의"))


def _install_open() -> Column:
    return F.exists("check_required", lambda s: s.contains("설치") & s.contains("확인"))


def _two(score: Column) -> Column:
    return F.format_string("%.2f", score)


def template_reasons(top3: DataFrame, keep: int | None = None, chars: int | None = None) -> DataFrame:
    """strengths, weaknesses and card_summary of every top quote.

    Expects the flags of ``relative_position`` next to the scores. ``keep`` limits strengths and weaknesses, ``chars``
    the length of a summary, where they are named.
    """
    risks = F.concat(decision_risks(F.col("check_required")), F.col("comparison_risks"))
    base = short_list(top3, "_decided", risks, keep)
    clear_delivery = (F.coalesce("delivery_weeks", F.lit(0)) != 0) & ~_delivery_open()
    by_score = messages(
        ((F.col("delivery_score") < 70) & ~_delivery_open(), "납기 조건 확인 필요"),
        (F.col("warranty_score") < 70, "보증기간 확인 필요"),
        (F.col("installation_score") < 70, "설치 범위 확인 필요"),
        (~F.col("partner_found"), "파트너 매칭 확인 필요"),
    )
    weak = F.when(F.get("_decided", F.lit(0)) != NO_RISK, F.col("_decided")).when(
        F.size(by_score) > 0, first_of(by_score, keep)
    ).otherwise(F.array(F.lit(NO_RISK)))
    strong = messages(
        (F.col("is_highest_final_score"), F.concat(F.lit("최종 점수 "), _two(F.col("final_score")), F.lit("로 1위"))),
        (
            F.col("is_best_price_score"),
            F.concat(F.lit("가격 점수 "), F.rint("price_score").cast("bigint").cast("string"), F.lit("점으로 경쟁력 우수")),
        ),
        (F.col("is_highest_spec_score") & (F.col("spec_score") >= 75), "사양 점수가 Top3 중 우수"),
        (
            clear_delivery & (F.col("delivery_score") >= 80),
            F.concat(F.lit("납기 "), F.col("delivery_weeks").cast("string"), F.lit("주로 조건 명확")),
        ),
        (
            (F.coalesce("warranty_months", F.lit(0)) != 0) & (F.col("warranty_score") >= 80),
            F.concat(F.lit("보증 "), F.col("warranty_months").cast("string"), F.lit("개월")),
        ),
        ((F.col("installation_score") >= 80) & ~_install_open(), "설치 조건 반영"),
    )
    top = first_of(F.array_distinct(strong), keep)
    first_risk = F.replace(F.get("weaknesses", F.lit(0)), F.lit(" 확인 필요"), F.lit(""))
    leader = (F.col("rank") == 1) & F.col("is_highest_final_score")
    return (
        base.withColumn("weaknesses", weak)
        .withColumn("strengths", F.when(F.size(top) > 0, top).otherwise(F.array(F.lit(NO_STRENGTH))))
        .withColumn(
            "card_summary",
            F.when(leader & F.col("is_best_price_score"), "최저가와 종합 점수에서 가장 우수한 견적입니다.")
            .when(leader, "종합 점수가 가장 높은 추천 견적입니다.")
            .when(clear_delivery, "납기는 명확하지만 가격과 조건 확인이 필요합니다.")
            .when(F.get("weaknesses", F.lit(0)) != NO_RISK, trim_sentence(F.concat(first_risk, F.lit(" 확인이 필요한 견적입니다.")), chars))
            .otherwise("주요 점수가 균형적인 비교 후보입니다."),
        )
        .withColumn("_clear", clear_delivery)
        .drop("_decided")
    )


def trim_sentence(text: Column, limit: int | None = None) -> Column:
    clean = one_space(text)
    if not limit:
        return clean
    return F.when(F.length(clean) <= limit, clean).otherwise(
        F.concat(F.rtrim(F.substring(clean, 1, limit - 1)), F.lit("…"))
    )


def overall_summaries(reasons: DataFrame, keys: list[str]) -> DataFrame:
    """One summary sentence chain per project from its top three rows."""
    row = F.struct("vendor_name", "final_score", "is_best_price_score", "_clear", "weaknesses")
    per = reasons.groupBy(*keys).agg(*[F.max(F.when(F.col("rank") == i, row)).alias(f"r{i}") for i in (1, 2, 3)])
    first = F.concat(
        F.lit("1순위 "), F.col("r1.vendor_name"), F.lit("는 최종 점수 "), _two(F.col("r1.final_score")),
        F.when(F.col("r1.is_best_price_score"), "로 가장 우수하며 가격 경쟁력도 가장 높습니다.").otherwise("로 가장 우수하며 가격과 사양을 함께 고려한 결과입니다."),
    )
    second = F.concat(
        F.col("r2.vendor_name"),
        F.when(F.col("r2._clear"), "은 납기 조건이 명확하지만 가격 리스크 확인이 필요합니다.").otherwise("은 사양과 가격 조건을 추가 비교할 후보입니다."),
    )
    risks = F.array_join(F.transform("r3.weaknesses", lambda s: F.replace(s, F.lit(" 확인 필요"), F.lit(""))), ", ")
    third = F.when(
        F.get("r3.weaknesses", F.lit(0)) != NO_RISK, F.concat(F.col("r3.vendor_name"), F.lit("은 "), risks, F.lit(" 확인이 필요합니다."))
    )
    return per.withColumn("overall_summary", F.concat_ws(" ", first, second, third)).drop("r1", "r2", "r3")


def explanation_input(top3: DataFrame, fields: list[str]) -> DataFrame:
    """Allowed fields only, with the checks reduced to decision risks."""
    return top3.where(F.col("rank") <= 3).select(*fields, decision_risks(F.col("check_required")).alias("check_required"))


def clean_generated(df: DataFrame, chars: int | None = None, keep: int | None = None) -> DataFrame:
    """Sanitize generated strengths: parser talk and unsupported advantage claims go.

    ``chars`` cuts each strength and ``keep`` the list, where they are named.
    """
    claims = lambda s, word: s.contains(word) & contains_any(s, ADVANTAGE_WORDS)
    short = lambda s: F.substring(one_space(s), 1, chars) if chars else one_space(s)
    limited = first_of(F.transform(F.filter("strengths", lambda s: F.trim(s) != ""), short), keep)
    staged = df.withColumn("_d", _delivery_open()).withColumn("_i", _install_open())
    kept = first_of(F.array_distinct(F.filter(
        limited, lambda s: ~is_parser_note(s) & ~(F.col("_d") & claims(s, "납기")) & ~(F.col("_i") & claims(s, "설치")),
    )), keep)
    return staged.withColumn("strengths", F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(NO_STRENGTH)))).drop("_d", "_i")


def reconcile(expected: DataFrame, generated: DataFrame, template: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match generated cards to the expected quotes.

    First card per quote wins; unknown and repeated cards are reported; missing quotes take
    the template card. ``generated`` has record_id, quote_id, position and card_summary.
    Returns (cards, warnings).
    """
    keys = ["record_id", "quote_id"]
    given = generated.where(F.coalesce("quote_id", F.lit("")) != "")
    known = given.join(expected.select(*keys), keys, "left_semi")
    first = best_per_group(known, keys, [F.col("position")])
    cards = (
        expected.join(first.select(*keys, F.col("card_summary").alias("_g")), keys, "left")
        .join(template.select(*keys, F.col("card_summary").alias("_t")), keys, "left")
        .withColumn("fallback_used", F.col("_g").isNull())
        .withColumn("card_summary", F.coalesce("_g", "_t"))
        .drop("_g", "_t")
    )
    unknown = given.join(expected.select(*keys), keys, "left_anti").select(*keys, F.lit("unknown").alias("issue")).distinct()
    repeated = known.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("duplicate").alias("issue"))
    missing = expected.select(*keys).join(known.select(*keys), keys, "left_anti").select(*keys, F.lit("missing").alias("issue"))
    return cards, unknown.unionByName(repeated).unionByName(missing)


def attach_cards(suppliers: DataFrame, cards: DataFrame, n: int = 3) -> DataFrame:
    """Card of each of the first ``n`` suppliers by quote id (last card wins), else by vendor name (first card wins)."""
    by_quote = cards.where(F.col("quote_id").isNotNull()).groupBy("record_id", "quote_id").agg(
        F.max_by("card_summary", "position").alias("_by_quote")
    )
    by_vendor = cards.where(F.coalesce("vendor_name", F.lit("")) != "").groupBy("record_id", "vendor_name").agg(
        F.min_by("card_summary", "position").alias("_by_vendor")
    )
    return (
        suppliers.where(F.coalesce("rank", F.lit(999)) <= n)
        .join(by_quote, ["record_id", "quote_id"], "left")
        .join(by_vendor, ["record_id", "vendor_name"], "left")
        .withColumn("card_summary", F.coalesce("_by_quote", "_by_vendor", F.lit("")))
        .drop("_by_quote", "_by_vendor")
    )
