"""Field extraction from whole quote texts.

One document is one row and stays one row: lines are handled as an array inside the
row, so extraction is a narrow job with no shuffle and no cap on the text length.
Every function takes a DataFrame with ``text`` and adds columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions.expr import SPACE_IN_LINE, contains_any, first_match, group1, once, one_space, strip
from quotelake.functions.money import (
    amounts_in, comma_amounts, dates_in, duration_days, duration_months, korean_months, last_of, normalize_date,
    parse_amount, unit_amounts,
)

NEWLINE = r"\r\n|\r|\n"
EDGE_MARKS = r"^[ \-*•\t]+|[ \-*•\t]+$"

# Label patterns of quote documents.
TOTAL_LABELS = [
    r"(?:전체\s*합\s*계|합\s*계\s*금\s*액|합계금액|총\s*견적\s*금액|총\s*금액|견적\s*금액|총액|공급대가)\s*(?:\(.*?\))?\s*[:：]?\s*([₩￦Ww\(\)\d,.\s]+(?:원|만원|천만원|백만원|억원|억)?)",
    r"(?:Total|Amount)\s*[:：]?\s*([₩￦Ww\(\)\d,.\s]+(?:KRW|원)?)",
]
SUPPLY_LABELS = [r"(?:공급\s*가\s*액|공급가액|공급\s*금액|공급액)\s*[:：]?\s*([₩￦Ww\(\)\d,.\s]+(?:원)?)"]
TAX_LABELS = [r"(?:세\s*액|세액|부가\s*가치\s*세|부가\s*세|부가세)\s*[:：]?\s*([₩￦Ww\(\)\d,.\s]+(?:원)?)"]
TOTAL_TOKENS = ["부가세포함가", "전체합계", "전체합계(vat포함)", "vat합계", "총금액", "vat포함"]
TAX_TOKENS = ["부가가치세", "부가세", "세액"]
SUPPLY_TOKENS = ["공급가액", "공급금액", "공급가", "vat별도", "소계", "합계"]
#: The shortest of all these; a text that holds none of them holds none of the others.
SUMMARY_TOKENS = [t for t in TOTAL_TOKENS + TAX_TOKENS + SUPPLY_TOKENS if not any(
    o != t and o in t for o in TOTAL_TOKENS + TAX_TOKENS + SUPPLY_TOKENS)]
DATE_LABEL = r"(?:견적일|견적일자|작성일|발행일|견적일시)\s*[:：]?\s*(\d{4}[.\-/년\s]+\d{1,2}[.\-/월\s]+\d{1,2})"
DELIVERY_RANGE = r"(?i)(?:납기|delivery)\s*[:：]?\s*(?:계약\s*후|발주\s*후)?\s*(\d+)\s*[~～\-]\s*(\d+)\s*주"
DELIVERY_PATTERNS = [
    r"(?:납기|납품\s*기간|배송\s*기간|리드타임|소요\s*기간)\s*[:：]?\s*(?:계약\s*후|발주\s*후)?\s*(\d+)\s*(영업일|일|주|개월|달)",
    r"(?:계약\s*후|발주\s*후)\s*(\d+)\s*(영업일|일|주|개월|달)",
]
DELIVERY_BASIS = r"(?i)(?:납\s*기|delivery)\s*[:：]?\s*((?:계약|발주)\s*후\s*\d+\s*(?:[~～\-]\s*\d+\s*)?(?:일|주|개월)(?:\s*이내)?)"
DELIVERY_BASIS_ANY = r"((?:계약\s*후|발주\s*후)\s*\d+\s*(?:[~～\-]\s*\d+\s*)?(?:일|주|개월)(?:\s*이내)?)"
START_LABEL = r"도\s*입\s*가\s*능\s*일\s*[:：]?\s*(.+)$"
VALIDITY_PATTERNS = [
    r"(?:견적\s*유효\s*기간|유효\s*기간)\s*[:：]?\s*(?:견적일로부터)?\s*(\d+)\s*(일|주|개월|달)",
    r"견적일로부터\s*(\d+)\s*(일|주|개월|달)",
]
WARRANTY_CONTEXT = [
    "유지보수", "무상보수", "무상보수기간", "무상보증", "보증기간", "제품무상보증기간", "A/S", "AS", "시공후",
    "설치완료일로부터", "설치완료후", "납품일로부터", "납품완료후", "준공일로부터",
]
WARRANTY_LABELS = ["무상보증", "보증기간", "제품무상보증기간", "무상보수기간"]
WARRANTY_PATTERNS = [
    r"(?i)(?:제품\s*)?(?:무상\s*)?(?:보증\s*기간|보증기간|하자\s*보증|Warranty)\s*[:：]?\s*(?:준공일로부터|납품일로부터|설치일로부터)?\s*(\d+)\s*(년|개월|달)",
    r"(?i)(?:제품\s*)?무상\s*보증\s*기간\s*[:：]?\s*(?:준공일로부터|납품일로부터|설치일로부터)?\s*(\d+)\s*(년|개월|달)",
    r"(?i)(?:준공일로부터|납품일로부터|설치일로부터)\s*(\d+)\s*(년|개월|달)",
    r"(?i)(\d+)\s*(년|개월|달)\s*(?:무상\s*)?(?:보증|하자보증)",
]
PAYMENT_PATTERNS = [
    r"(?i)(?:결제\s*조건은|결제\s*조건|결재\s*조건|지급\s*조건|대금\s*지급|대금\s*결제\s*조건|대금\s*결재\s*조건|Payment Terms)\s*[:：]?\s*([^\n]+)",
    r"(?i)\d+\.\s*(?:결제|결재|대금결제|대금결재)\s*조건\s*[:：은]?\s*([^\n]+)",
]
PAYMENT_LABEL_TOKENS = [
    "결제조건은", "결제 조건은", "결제조건", "결제 조건", "결재조건은", "결재 조건은", "결재조건", "결재 조건",
    "대금결제조건", "대금 결제 조건", "대금결재조건", "대금 결재 조건",
]
SPECIAL_TERM_TOKENS = [
    "별도", "포함", "무상", "유상", "추가 비용", "계약 전 확인", "VAT", "부가세", "부가가치세", "운송비", "배송비", "납품비",
    "설치비", "시공비", "유지보수", "A/S", "AS", "견적유효기간", "유효기간", "결제조건", "결재조건", "대금결재조건",
    "대금결제조건", "제품무상보증기간", "보증기간",
]
OPTION_MIN_AMOUNT, OPTION_MIN_TAX = 100000, 10000
PROJECT_LABEL = r"(?i)(?:건\s*명|견\s*적\s*명|프로젝트\s*명|project\s*name|project)\s*[:：]\s*(.+)"
INVALID_PROJECT_NAMES = [
    "", "견적서", "quotation", "quote", "estimate", "견적명", "건명", "프로젝트명", "미기재", "확인필요",
]
PROJECT_STOP = r"(?i)(?:견적일|작성자|연락처|대표이사|주소|Quote Date|Contact)"
MSG_PROJECT_FROM_FILE = "프로젝트명이 문서에서 명확히 추출되지 않아 파일명 기준으로 보정됨"
MSG_PROJECT_MISSING = "프로젝트명 확인 필요"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), NEWLINE)


def spaced_lines(text: Column) -> Column:
    """Lines with each run of whitespace as one blank, made in one pass over the text."""
    return lines_of(F.regexp_replace(text, SPACE_IN_LINE + "+", " "))


def clean_text(text: Column) -> Column:
    """Recognition marks removed, blanks and empty lines squeezed."""
    t = F.replace(text, F.lit(":unselected:"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, r"\r\n|\r", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def _no_space(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _labelled(text: Column, labels: list[str]) -> Column:
    return parse_amount(F.coalesce(*(group1(text, f"(?i){label}") for label in labels)))


# ----------------------------------------------------------------------- amounts


def summary_amounts(docs: DataFrame) -> DataFrame:
    """supply_amount, tax_amount, total_amount from summary lines.

    The amount sits on the labelled line or on one of the next two; the largest per label wins.
    """
    lines = F.filter(F.transform(spaced_lines(F.col("text")), lambda s: F.trim(s)), lambda s: s != "")
    staged = once(docs, "_lines", lines)
    near = lambda i, n: F.array_join(F.slice(F.col("_lines"), i + 1, F.lit(n)), " ")
    labels = F.transform("_lines", lambda s, i: F.struct(F.lower(_no_space(s)).alias("label"), i.alias("i")))
    named = F.filter(labels, lambda r: contains_any(r["label"], SUMMARY_TOKENS) | (r["label"] == "vat"))
    kind = lambda label: first_match([
        (contains_any(label, TOTAL_TOKENS), "total"), (contains_any(label, TAX_TOKENS) | (label == "vat"), "tax")], "supply")
    # amounts are sought near the few lines that name one
    own = F.transform(named, lambda r: F.struct(
        kind(r["label"]).alias("kind"), r["label"].contains("vat별도").alias("paired"), r["i"].alias("i"),
        amounts_in(F.get("_lines", r["i"])).alias("own")))
    staged = once(staged, "_own", own)
    staged = once(
        staged,
        "_rows",
        F.transform(
            "_own",
            lambda r: F.struct(
                r["kind"].alias("kind"),
                last_of(F.when(F.size(r["own"]) > 0, r["own"]).otherwise(amounts_in(near(r["i"], 3)))).alias("amount"),
                F.when(
                    r["paired"], F.when(F.size(r["own"]) >= 2, r["own"]).otherwise(amounts_in(near(r["i"], 2))),
                ).alias("pair"),
            ),
        ),
    )
    best = lambda k: F.array_max(
        F.transform(F.filter("_rows", lambda r: (r["kind"] == k) & (r["amount"] > 0)), lambda r: r["amount"])
    )
    paired = F.filter("_rows", lambda r: F.size(r["pair"]) >= 2)
    pair = lambda n: F.array_max(F.transform(paired, lambda r: F.get(r["pair"], F.lit(n))))
    positive = lambda c: F.when(c > 0, c)
    return (
        staged.withColumn("total_amount", best("total"))
        .withColumn("tax_amount", F.greatest(best("tax"), positive(pair(1))))
        .withColumn("supply_amount", F.greatest(best("supply"), positive(pair(0))))
        .drop("_lines", "_own", "_rows")
    )


def labelled_amounts(docs: DataFrame) -> DataFrame:
    """Total, supply and tax by label with the line-based fallbacks; supply from total and tax if missing."""
    text = F.col("text")
    total = F.coalesce(
        _labelled(text, TOTAL_LABELS),
        F.array_max(F.concat(comma_amounts(text), unit_amounts(text))),
    )
    sums = F.filter(
        lines_of(text),
        lambda s: _no_space(s).contains("합계")
        & ~_no_space(s).contains("전체합계") & ~_no_space(s).contains("VAT포함") & (F.size(comma_amounts(s)) > 0),
    )
    taxes = F.filter(
        lines_of(text),
        lambda s: contains_any(_no_space(s), ["부가가치세", "부가세", "세액"]) & (F.size(comma_amounts(s)) > 0),
    )
    supply = F.coalesce(_labelled(text, SUPPLY_LABELS), last_of(comma_amounts(_first(sums))))
    tax = F.coalesce(_labelled(text, TAX_LABELS), last_of(comma_amounts(_first(taxes))))
    return (
        docs.withColumn("total_amount", total)
        .withColumn("tax_amount", tax)
        .withColumn("supply_amount", F.coalesce(supply, F.col("total_amount") - F.col("tax_amount")))
    )


def key_value_amounts(docs: DataFrame, column: str = "key_values") -> DataFrame:
    """Total, supply, tax and date from recognised key/value pairs (array of key, value structs)."""
    pairs = F.transform(column, lambda e: F.struct(_no_space(e["key"]).alias("k"), e["value"].alias("v")))
    staged = docs.withColumn("_kv", pairs)
    amount = lambda cond: _first(
        F.filter(F.transform(F.filter("_kv", cond), lambda e: parse_amount(e["v"])), lambda a: a.isNotNull())
    )
    named = lambda word: amount(lambda e: e["k"].contains(word))
    total = F.coalesce(*[named(w) for w in ["전체합계", "VAT포함", "총액", "총금액", "합계금액", "공급대가"]])
    supply = amount(lambda e: e["k"].isin("합계", "공급가액", "공급금액", "공급액"))
    tax = amount(lambda e: contains_any(e["k"], ["부가가치세", "부가세", "세액"]) | (e["k"] == "VAT"))
    date = _first(
        F.filter(
            F.transform(F.filter("_kv", lambda e: e["k"].isin("견적일자", "견적일", "견적일시")), lambda e: normalize_date(e["v"])),
            lambda x: x.isNotNull(),
        )
    )
    return (
        staged.withColumn("kv_total_amount", total).withColumn("kv_supply_amount", supply)
        .withColumn("kv_tax_amount", tax).withColumn("kv_quote_date", date).drop("_kv")
    )


def option_totals(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Consecutive (supply, tax, total) amounts that add up: the totals of each option in one document.

    All are kept unless a ``limit`` is named.
    """
    staged = once(docs, "_a", comma_amounts(F.col("text")))
    triple = lambda x, i: F.struct(
        x.alias("supply_price"), F.get("_a", i + 1).alias("tax_amount"), F.get("_a", i + 2).alias("total_with_vat")
    )
    ok = lambda t: (
        (t["supply_price"] >= OPTION_MIN_AMOUNT) & (t["tax_amount"] >= OPTION_MIN_TAX) & (t["total_with_vat"] >= OPTION_MIN_AMOUNT)
        & (F.abs(t["supply_price"] + t["tax_amount"] - t["total_with_vat"])
           <= F.greatest(F.lit(50000), (t["total_with_vat"] * 0.03).cast("bigint")))
    )
    found = F.array_distinct(F.filter(F.transform("_a", triple), ok))
    counted = staged.withColumn("option_candidates", found).drop("_a").withColumn("option_total_count", F.size("option_candidates"))
    return counted.withColumn("option_candidates", F.slice("option_candidates", 1, limit)) if limit else counted


# ------------------------------------------------------------- dates and durations


def quote_date(docs: DataFrame) -> DataFrame:
    """Labelled quote date, else the first valid date of the text."""
    labelled = normalize_date(group1(F.col("text"), DATE_LABEL))
    return docs.withColumn("quote_date", F.coalesce(labelled, _first(dates_in(F.col("text")))))


def delivery(docs: DataFrame) -> DataFrame:
    """delivery_days (upper bound of ranges) and the delivery phrase."""
    text = F.col("text")
    upper = (group1(text, DELIVERY_RANGE, 2).cast("int") * 7)
    days = [duration_days(group1(text, p), group1(text, p, 2)) for p in DELIVERY_PATTERNS]
    cleaned = F.transform(lines_of(text), lambda s: F.regexp_replace(one_space(s), r"^[ \-*•\t|]+|[ \-*•\t|]+$", ""))
    phrase = lambda s: F.coalesce(
        one_space(group1(s, DELIVERY_BASIS)),
        F.when(
            _no_space(s).contains("도입가능일"),
            F.when(_no_space(s).contains("별도협의"), F.lit("별도협의")).otherwise(
                F.nullif(F.regexp_replace(group1(s, START_LABEL), r"^[ :：|\-]+|[ :：|\-]+$", ""), F.lit(""))
            ),
        ),
    )
    by_line = _first(F.filter(F.transform(cleaned, phrase), lambda s: s.isNotNull()))
    return docs.withColumn("delivery_days", F.coalesce(upper, *days)).withColumn(
        "delivery_basis_raw", F.coalesce(by_line, one_space(group1(text, DELIVERY_BASIS_ANY)))
    ).withColumn("delivery_weeks", F.ceil(F.col("delivery_days") / 7.0).cast("int"))


def _free_warranty(line: Column) -> Column:
    """Months promised by one line, NULL when the line is not about free warranty."""
    tight = _no_space(line)
    free = tight.contains("무상")
    paid_only = tight.contains("유상") & ~free
    labelled = contains_any(tight, WARRANTY_LABELS) | F.upper(tight).contains("AS")
    return F.when(~paid_only & contains_any(tight, WARRANTY_CONTEXT) & (free | labelled), korean_months(line))


def warranty(docs: DataFrame) -> DataFrame:
    """warranty_months: free-warranty lines first, then labelled phrases, then a bare year count."""
    text = F.col("text")
    cleaned = F.transform(lines_of(text), lambda s: F.regexp_replace(one_space(s), EDGE_MARKS, ""))
    per_line = F.filter(
        F.transform(cleaned, lambda s: F.struct(s.alias("line"), _free_warranty(s).alias("months"))),
        lambda r: r["months"].isNotNull(),
    )
    first = _first(per_line)
    phrases = [duration_months(group1(text, p), group1(text, p, 2)) for p in WARRANTY_PATTERNS]
    bare = (
        F.when(contains_any(F.lower(text), ["1 year", "1년", "1 year factory warranty"]), 12)
        .when(contains_any(text, ["3년", "36개월"]), 36)
    )
    return (
        docs.withColumn("_w", first)
        .withColumn("warranty_months", F.coalesce(F.col("_w.months"), *phrases, bare))
        .withColumn(
            "warranty_check",
            F.when(F.col("_w.line").contains("출장실비") & F.col("_w.line").contains("별도"), "출장실비 별도 조건 확인 필요"),
        )
        .drop("_w")
    )


def terms(docs: DataFrame) -> DataFrame:
    """Quote validity, payment terms, special terms."""
    text = F.col("text")
    validity = [duration_days(group1(text, p), group1(text, p, 2)) for p in VALIDITY_PATTERNS]
    pay_lines = F.filter(F.transform(lines_of(text), lambda s: strip(s)), lambda s: contains_any(s, ["결제", "결재", "대금결제", "대금결재"]))
    raw = F.coalesce(*[group1(text, p) for p in PAYMENT_PATTERNS], F.regexp_replace(_first(pay_lines), r"^\d+\.\s*", ""))
    special = F.filter(F.transform(lines_of(text), lambda s: strip(s)), lambda s: contains_any(s, SPECIAL_TERM_TOKENS))
    tidy = F.transform(special, lambda s: one_space(s))
    staged = once(docs, "_terms", tidy)
    staged = once(staged, "_keys", F.transform("_terms", lambda s: _no_space(s)))
    return (
        staged.withColumn("quote_validity_days", F.coalesce(*validity))
        .withColumn("payment_terms", clean_payment(raw))
        .withColumn(
            "special_terms",  # first of the texts that differ by spaces only
            F.filter("_terms", lambda s, i: (s != "") & (F.array_position("_keys", _no_space(s)) == i + 1)),
        )
        .drop("_terms", "_keys")
    )


def clean_payment(raw: Column) -> Column:
    text = strip(raw)
    for token in PAYMENT_LABEL_TOKENS:
        text = F.replace(text, F.lit(token), F.lit(""))
    text = F.get(F.split(text, r"\s+\d+\.\s+"), F.lit(0))
    return F.regexp_replace(text, r"^[ :：,\-]+|[ :：,\-]+$", "")


def inclusion_flag(text: Column, include: list[str], exclude: list[str]) -> Column:
    """False when an exclusion phrase occurs, True for an inclusion phrase, else NULL."""
    hit = lambda ps: [(text.rlike("(?i)" + p), True) for p in ps]
    return first_match([(c, False) for c, _ in hit(exclude)] + hit(include))


# ------------------------------------------------------------------ project names


def clean_project(value: Column) -> Column:
    t = one_space(F.coalesce(value, F.lit("")))
    t = F.regexp_replace(t, r"(?i)\.(pdf|xlsx|xls|png|jpe?g)$", "")
    t = F.regexp_replace(t, r"(?i)\b(quotation|quote|estimate|no\.?)\b", " ")
    t = F.regexp_replace(t, r"견\s*적\s*서|견\s*적\s*명|건\s*명|프로젝트\s*명", " ")
    t = F.regexp_replace(t, r"[-|:：]+$", "")
    t = F.regexp_replace(t, rf"(?s)(?<=.){PROJECT_STOP}.*$", "")
    return one_space(t)


def valid_project(value: Column) -> Column:
    return ~F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", "")).isin(INVALID_PROJECT_NAMES)


def resolve_project_name(docs: DataFrame, vendor_tokens: list[str] = (), file_chars: int | None = None) -> DataFrame:
    """project_name from the parsed value, a labelled line, or the file name, with its source.

    Expects project_name, text, file_name and vendor_name. ``file_chars`` cuts a name taken from the file name.
    """
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    own = clean_project(F.col("project_name"))
    labelled = F.transform(
        lines_of(F.col("text")), lambda s: clean_project(group1(one_space(s), PROJECT_LABEL))
    )
    from_text = _first(F.filter(labelled, lambda s: valid_project(s)))
    base = one_space(F.replace(stem, F.lit("_"), F.lit(" ")))
    base = F.regexp_replace(base, r"\[[^\]]*\]|\([^)]*\)", " ")
    base = F.regexp_replace(base, r"\b[0-9a-fA-F]{8,}\b", " ")
    vendor = F.coalesce(F.col("vendor_name"), F.lit(""))
    base = F.when(vendor != "", F.replace(base, vendor, F.lit(" "))).otherwise(base)
    for token in vendor_tokens:
        base = F.replace(base, F.lit(token), F.lit(" "))
    from_file = strip(F.substring(clean_project(base), 1, file_chars) if file_chars else clean_project(base))
    return (
        docs.withColumn("_own", own).withColumn("_label", from_text).withColumn("_file", from_file)
        .withColumn(
            "project_name_source",
            F.when(valid_project(F.col("_own")), "parser").when(F.col("_label").isNotNull(), "ocr_label")
            .when(valid_project(F.col("_file")), "file_name_fallback").otherwise("missing"),
        )
        .withColumn(
            "resolved_project_name",
            first_match(
                [
                    (F.col("project_name_source") == "parser", F.col("_own")),
                    (F.col("project_name_source") == "ocr_label", F.col("_label")),
                    (F.col("project_name_source") == "file_name_fallback", F.col("_file")),
                ],
                "",
            ),
        )
        .withColumn(
            "project_name_check",
            F.when(F.col("project_name_source") == "file_name_fallback", MSG_PROJECT_FROM_FILE).when(
                F.col("project_name_source") == "missing", MSG_PROJECT_MISSING
            ),
        )
        .drop("_own", "_label", "_file")
    )
