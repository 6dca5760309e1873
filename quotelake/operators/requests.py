"""Customer requests: label/value forms and free texts to structured requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions.expr import first_match, group1, lit_array, once, one_space, strip
from quotelake.functions.money import budget_amount, request_money
from quotelake.operators.extract import clean_text, lines_of
from quotelake.sources.intake import normalize_empty

# Form labels, keyword candidates, text labels, deadline phrases.
FORM_LABELS = {
    "프로젝트명": "project_name", "활용 용도": "usage", "디스플레이 크기": "display_size", "수량": "quantity_text",
    "운영 시간": "operation_time", "카테고리": "category", "예산 상한": "budget_text", "현재 단계": "project_stage",
    "우선 검토 기준": "review_preset", "추가 요청사항": "other_conditions", "첨부 메모": "attachment_memo",
}
ALWAYS_KEYWORDS = ["디스플레이", "설치"]
NO_SUMMARY = "프로젝트 요구사항 미상"
TEXT_KEYWORDS = [
    "LED 전광판", "비디오월", "회의실", "컨퍼런스 룸", "디스플레이", "커브드", "평면", "플랫", "설치", "태양광 발전 현황",
    "프로세서", "잡자재",
]
EXCLUDED_KEYWORDS = ["별도 제외", "불가", "제외"]
DISPLAY_TYPES = ["커브드", "평면", "플랫", "실내용"]
DEADLINE_PATTERNS = [r"월요일\s*오전까지", r"내일까지", r"금요일까지", r"이번\s*주까지", r"빠르게\s*검토"]
SECTION_LABELS = "수수료\\s*모델|고객사|기업명|견적 요청 내용|문의 내용|일정|설치 일정|설치일정|지역|단계|기타 사항|예산|솔루션"
PRODUCT_HINT = r"(?i)LED|전광판|비디오월|스크린|디스플레이|Pitch|피치|P\d"
MONEY = r"\d[\d,]*(?:\.\d+)?\s*(?:천\s*만\s*원|천만원|만\s*원|만원|억\s*원|억원|억|원)"
BUDGET_RANGE = rf"({MONEY}?)\s*이상\s*(?:~|-|부터)?\s*({MONEY}?)\s*(?:미만|이하|까지)?"
WARN_CUSTOMER = "고객사를 추출하지 못했습니다."
WARN_PRODUCTS = "견적 요청 제품을 추출하지 못했습니다."
WARN_REGION = "지역 정보를 추출하지 못했습니다."


# --------------------------------------------------------------------- form texts


def form_fields(forms: DataFrame, normalize: bool = True) -> DataFrame:
    """One column per known label; the last line with a value wins."""
    entries = F.transform(
        F.filter(F.transform(lines_of(F.col("request_text")), lambda s: strip(s)), lambda s: s.contains(":")),
        lambda s: F.struct(
            strip(F.substring_index(s, ":", 1)).alias("label"),
            strip(F.substring(s, F.instr(s, F.lit(":")) + 1, F.length(s))).alias("value"),
        ),
    )
    staged = once(forms, "_fields", entries)
    for label, column in FORM_LABELS.items():
        value = _last_value(F.col("_fields"), label, normalize)
        staged = staged.withColumn(column, value)
    return staged.drop("_fields")


def _last_value(fields: Column, label: str, normalize: bool) -> Column:
    mine = F.transform(
        F.filter(fields, lambda e: e["label"] == label),
        lambda e: normalize_empty(e["value"]) if normalize else e["value"],
    )
    kept = F.filter(mine, lambda x: x.isNotNull())
    return F.get(kept, F.size(kept) - 1)


def keyword_tokens(value: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"(?U)[\s,/()]+"), lambda s: strip(s))
    return F.filter(parts, lambda s: F.length(s) >= 2)


def distinct_ignore_case(df: DataFrame, out: str, values: Column) -> DataFrame:
    """First spelling of every keyword; lower-cased comparison."""
    staged = once(once(df, "_words", values), "_low", F.transform("_words", lambda s: F.lower(s)))
    return staged.withColumn(
        out, F.filter("_words", lambda s, i: F.array_position("_low", F.lower(s)) == i + 1)
    ).drop("_words", "_low")


def form_requirements(forms: DataFrame) -> DataFrame:
    """Requirement columns from a form plus company_name, location and deadline."""
    f = form_fields(forms)
    size = F.regexp_replace("display_size", ",", "")
    dims = r"(\d{3,5})\s*[xX×]\s*(\d{3,5})"
    parts = F.array_compact(F.array("usage", "category", "display_size", "other_conditions"))
    product_text = F.concat_ws(" / ", "category", "display_size", "quantity_text")
    keywords = F.filter(
        F.concat(
            keyword_tokens(F.col("category")), keyword_tokens(F.col("usage")), keyword_tokens(F.col("display_size")),
            keyword_tokens(F.col("other_conditions")), keyword_tokens(F.col("category")),
            keyword_tokens(F.coalesce("category", "display_size")), keyword_tokens(product_text), lit_array(ALWAYS_KEYWORDS),
        ),
        lambda s: normalize_empty(s).isNotNull(),
    )
    f = distinct_ignore_case(f, "required_keywords", keywords)
    return (
        f.withColumn("customer_name", normalize_empty(F.col("company_name")))
        .withColumn("region", normalize_empty(F.col("location")))
        .withColumn("install_schedule_text", normalize_empty(F.col("deadline")))
        .withColumn("budget_max", budget_amount(F.col("budget_text")))
        .withColumn("quantity", group1(F.col("quantity_text"), r"(\d+(?:\.\d+)?)").cast("double"))
        .withColumn("quantity_unit", group1(F.col("quantity_text"), r"\d+(?:\.\d+)?\s*([^\d\s]+)"))
        .withColumn("width_mm", group1(size, dims, 1).cast("int"))
        .withColumn("height_mm", group1(size, dims, 2).cast("int"))
        .withColumn(
            "request_summary",
            F.when(F.size(parts) > 0, F.array_join(parts, " / "))
            .when(F.concat_ws(" / ", "customer_name", "region", "install_schedule_text") != "",
                  F.concat_ws(" / ", "customer_name", "region", "install_schedule_text"))
            .otherwise(NO_SUMMARY),
        )
        .withColumn("notes", F.array_compact(F.array("operation_time", "review_preset", "other_conditions", "attachment_memo")))
    )


# --------------------------------------------------------------------- free texts


def labelled_value(text: Column, labels: list[str]) -> Column:
    return one_space(group1(text, rf"(?m)^\s*(?:\d+\.\s*)?(?:{'|'.join(labels)})\s*[:：]\s*(.+)$"))


def budget_range(text: Column) -> tuple[Column, Column]:
    """(minimum, maximum) budget; a closed range wins over an upper, then a lower bound."""
    low, high = request_money(group1(text, BUDGET_RANGE, 1)), request_money(group1(text, BUDGET_RANGE, 2))
    closed = low.isNotNull() & high.isNotNull()
    upper = request_money(
        F.coalesce(
            group1(text, rf"(?:예산\s*)?(?:최대\s*)?({MONEY})\s*(?:이하|미만|까지)"), group1(text, rf"최대\s*({MONEY})")
        )
    )
    lower = request_money(group1(text, rf"({MONEY})\s*이상"))
    return (
        F.when(closed, low).when(upper.isNull(), lower),
        F.when(closed, high).otherwise(upper),
    )


def product_blocks(text: Column) -> Column:
    """Texts of the ``(n) ...`` blocks, each up to the next block or numbered section."""
    return F.regexp_extract_all(text, F.lit(r"(?ms)^\s*(\(\d+\).*?)(?=^\s*\(\d+\)|^\s*\d+\.\s+|\z)"), F.lit(1))


def parse_product(block: Column) -> Column:
    """Product struct of one block."""
    first = F.get(F.split(strip(block), "\n"), F.lit(0))
    name = strip(F.regexp_replace(first, r"^\(\d+\)\s*", ""))
    size = r"(?i)(\d{1,3}(?:,\d{3})+|\d{4,5})\s*[xX×]\s*(\d{1,3}(?:,\d{3})+|\d{4,5})(?:\s*mm)?"
    layout = r"(?<![\d,])(\d{1,2})\s*[xX×]\s*(\d{1,2})(?![\d,])"
    pitch = group1(block, r"(?i)\bP\s*(\d+(?:\.\d+)?)").cast("double")
    trimmed = F.when(
        pitch.isNotNull(), strip(F.regexp_replace(name, r"(?i)\s+\d{1,3}(?:,\d{3})+\s*[xX×]\s*\d{1,3}(?:,\d{3})+.*$", ""))
    ).otherwise(name)
    number = lambda p, i: F.replace(group1(block, p, i), F.lit(","), F.lit("")).cast("int")
    return F.struct(
        first_match([
            (block.rlike(r"(?i)비디오\s*월"), "비디오월"), (block.rlike("(?i)LED|전광판|스크린"), "LED 전광판"),
        ]).alias("product_type"),
        first_match([(block.contains(t), t) for t in DISPLAY_TYPES]).alias("display_type"),
        strip(F.regexp_replace(trimmed, r"\s+\d{1,2}\s*[xX×]\s*\d{1,2}\s*$", "")).alias("name"),
        group1(block, r"(\d+(?:\.\d+)?)\s*(?:\"|인치)").cast("double").alias("diagonal_inch"),
        number(layout, 1).alias("layout_rows"),
        number(layout, 2).alias("layout_cols"),
        number(size, 1).alias("width_mm"),
        number(size, 2).alias("height_mm"),
        pitch.alias("pitch_mm"),
        group1(block, r"(?i)(?:Pitch|피치)\s*[:：]?\s*(\d+(?:\.\d+)?)\s*이하").cast("double").alias("pitch_max_mm"),
        block.alias("raw_text"),
    )


def text_requirements(docs: DataFrame) -> DataFrame:
    """Requirement columns from a free text request."""
    base = once(docs, "_t", clean_text(F.col("text")))
    t = F.col("_t")
    blocks = F.filter(F.transform(product_blocks(t), lambda b: strip(b)), lambda b: b.rlike(PRODUCT_HINT))
    solution = labelled_value(t, ["솔루션"])
    summary = group1(
        t,
        rf"(?ms)^\s*(?:\d+\.\s*)?(?:견적 요청 내용|문의 내용)\s*[:：]\s*(.*?)(?=\n\s*(?:\d+\.\s|\(\d+\)|(?:{SECTION_LABELS})\s*[:：]?)|\z)",
    )
    notes = F.get(F.regexp_extract_all(t, F.lit(r"(?ms)^\s*\d+\.\s*기타\s*사항[^\n]*\n(.*?)(?=^\s*\d+\.\s+|\z)"), F.lit(1)), F.lit(0))
    bullets = F.transform(
        F.filter(F.transform(lines_of(notes), lambda s: strip(s)), lambda s: s.startswith("-")),
        lambda s: one_space(F.regexp_replace(s, r"^-+", "")),
    )
    current = F.transform(
        F.filter(F.transform(lines_of(t), lambda s: strip(s)), lambda s: s.startswith("현재 ")), lambda s: one_space(s)
    )
    low, high = budget_range(t)
    commission = r"수수료[ \t]*모델[ \t]*[:：]?[ \t]*([A-Za-z가-힣]?[ \t]*\(?[ \t]*\d+(?:\.\d+)?[ \t]*%[ \t]*\)?)"
    staged = once(base, "_blocks", blocks)
    products = F.transform("_blocks", parse_product)
    fallback = F.when(solution.isNotNull(), F.array(parse_product(solution))).otherwise(F.array())
    out = (
        staged.withColumn("products", F.when(F.size("_blocks") > 0, products).otherwise(fallback))
        .withColumn("customer_name", labelled_value(t, ["고객사", "기업명"]))
        .withColumn("commission_model", F.regexp_replace(group1(t, commission), r"\s+", ""))
        .withColumn("commission_rate", group1(F.col("commission_model"), r"(\d+(?:\.\d+)?)").cast("double"))
        .withColumn("request_summary", F.nullif(one_space(summary), F.lit("")))
        .withColumn("region", labelled_value(t, ["지역"]))
        .withColumn("install_schedule_text", labelled_value(t, ["설치 일정", "설치일정", "일정"]))
        .withColumn("review_deadline_text", F.coalesce(*[group1(t, f"({p})") for p in DEADLINE_PATTERNS]))
        .withColumn("project_stage", F.coalesce(labelled_value(t, ["단계"]), F.get(current, F.lit(0))))
        .withColumn("budget_min", low)
        .withColumn("budget_max", high)
        .withColumn("notes", F.array_distinct(F.concat(F.coalesce(bullets, F.array().cast("array<string>")), current)))
    )
    kinds = F.array_compact(F.flatten(F.transform("products", lambda p: F.array(p["product_type"], p["display_type"]))))
    words = F.filter(lit_array(TEXT_KEYWORDS), lambda w: t.contains(w))
    excluded = F.filter(lit_array(EXCLUDED_KEYWORDS), lambda w: t.contains(w))
    return (
        out.withColumn("required_keywords", F.array_distinct(F.concat(kinds, words)))
        .withColumn("excluded_keywords", excluded)
        .withColumn(
            "warnings",
            F.array_compact(F.array(
                F.when(F.col("customer_name").isNull(), WARN_CUSTOMER), F.when(F.size("products") == 0, WARN_PRODUCTS),
                F.when(F.col("region").isNull(), WARN_REGION),
            )),
        )
        .drop("_t", "_blocks")
    )


# --------------------------------------------------------------------- readiness

# Weight of each filled field in the readiness score.
FIELD_WEIGHTS = {
    "company": 14, "location": 14, "usage": 14, "project_name": 10, "project_date": 10, "display": 16, "quantity": 10,
    "budget": 14, "solutions": 6, "review_preset": 8, "review_preset_again": 8,
}
REQUIRED_FIELDS = ["company", "location", "usage", "project_name", "project_date", "solutions"]
MSG_READY = "입력과 사전 검증이 충분해요. 지금 상태로 파트너 매칭을 진행해도 좋아요."
MSG_ALMOST = "기본 조건은 갖춰졌어요. 남은 항목을 보완하면 추천 정확도가 더 높아져요."
MSG_FILL = "항목들을 채우면 매칭 준비도가 높아져요."
MSG_SCHEDULE_NONE = "일정이 없으면 납기 기준 매칭 정확도가 낮아져요."
MSG_SCHEDULE_FORMAT = "일정 형식을 확인해 주세요."
MSG_SCHEDULE_LATE = "일정이 6개월을 초과해 우선 매칭 보류 대상으로 표시돼요."
MSG_SCHEDULE_OK = "프로젝트 기간이 가능한 범위예요."


def readiness(reqs: DataFrame, today: Column) -> DataFrame:
    """0-100 readiness of a request: 55 % filled fields, 45 % required-field check, plus schedule advice."""
    given = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) != ""
    filled = {
        "company": given("customer_name"), "location": given("region"), "usage": given("usage"),
        "project_name": given("project_name"), "project_date": given("install_schedule_text"),
        "display": given("display_size"), "quantity": given("quantity_text"), "budget": given("budget_text"),
        "solutions": given("category"), "review_preset": given("review_preset"), "review_preset_again": given("review_preset"),
    }
    half_up = lambda x: F.floor(x + 0.5).cast("int")
    total = sum(FIELD_WEIGHTS.values())
    earned = sum((F.when(filled[k], w).otherwise(0) for k, w in FIELD_WEIGHTS.items()), F.lit(0))
    required = sum((filled[k].cast("int") for k in REQUIRED_FIELDS), F.lit(0))
    complete = required == len(REQUIRED_FIELDS)
    target = F.try_to_date(F.col("install_schedule_text"), "yyyy-MM-dd")
    return (
        reqs.withColumn("field_score", half_up(earned / total * 100))
        .withColumn("required_filled", required)
        .withColumn("check_score", F.when(complete, 100).otherwise(0))
        .withColumn("readiness", half_up(F.col("field_score") * 0.55 + F.col("check_score") * 0.45))
        .withColumn(
            "readiness_message",
            F.when((F.col("readiness") >= 85) & complete, MSG_READY).when(F.col("readiness") >= 60, MSG_ALMOST).otherwise(MSG_FILL),
        )
        .withColumn(
            "schedule_message",
            F.when(~filled["project_date"], MSG_SCHEDULE_NONE).when(target.isNull(), MSG_SCHEDULE_FORMAT)
            .when(target > F.add_months(today, 6), MSG_SCHEDULE_LATE).otherwise(MSG_SCHEDULE_OK),
        )
    )


def intake_requests(forms: DataFrame) -> DataFrame:
    """Add ``failure_reason`` to requests with no usable text at all."""
    return forms.withColumn(
        "failure_reason", F.when(normalize_empty(F.col("request_text")).isNull(), "empty_request_text")
    )
