"""Terms and remarks of a quote text: sections, label/value pairs, classification of every line.

Lines are exploded once and ordered windows run per document, so state (open section,
pending label) follows the reading order. A document is one record, which bounds a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelake.functions.expr import first_match, once, one_space
from quotelake.operators.extract import lines_of

# Patterns of note headers, labels and line classes.
HEADER = r"(?i)^\s*(?:\[\s*)?(?:remark|특기사항|비고(?:\s*부분)?|기타사항|유의사항|참고사항)(?:\s*\])?\s*[:：]?\s*$"
NUMBER_PREFIX = r"^\s*(?:\(?\d{1,2}\)?[.)]|[-*•])\s*"
LABEL = (
    r"(?i)^\s*(결제\s*조건|결재\s*조건|대금\s*(?:결제|결재)(?:\s*조건)?|payment(?:\s*terms)?|납\s*기|납기|delivery|도입가능일|"
    r"무상\s*a/?s|무상유지보수|무상보수기간|제품무상보증기간|보증기간|warranty(?:\s*term)?|견적유효기간|price\s*validity|validity|"
    r"설치일정|도착지|packing|견적담당자|기타사항)\s*[.:\-：]?\s*(.*)$"
)
SUMMARY = (
    r"(?i)(?:합\s*계|소\s*계|공급\s*가(?:액)?|부가\s*(?:세|가치세)|v\.?a\.?t|총\s*금액|전\s*체\s*합\s*계|grand\s*total|total\s*amount)"
)
HEADER_FOOTER = (
    r"(?i)(?:^|\s)(?:수\s*신|담\s*당\s*자|견\s*적\s*일\s*자|견\s*적\s*번\s*호|전\s*화\s*번\s*호|주소|이메일|fax|tel|홈페이지|사업자번호|"
    r"은행\s*계좌|bank\s*account|bank\s*name|swift|account\s*no\.?|beneficiary|대표이사|공급자|견적담당자|건\s*명|o/?s\s*no\.?|"
    r"품\s*명|품\s*목|상세\s*내역|수량|단가|금\s*액)(?:\s|[:：]|$)"
)
SPEC = (
    r"(?i)(?:해상도|밝기|pixel\s*pitch|cabinet\s*size|module\s*size|규격|재질|steel|분체도장|브라켓\s*설명|모델명|fhd|nit|bezel|"
    r"video\s*wall\s*구성|화면사이즈|최대소비전력)"
)
CONTRACT_RISK = (
    r"(?i)(?:전기|통신|인입공사|구조물|보강대|인테리어|마감|현장\s*실사|구조검토|기구물|매립설치|돌출설치|cms|컨트롤러|콘텐츠|"
    r"외부\s*유출|영업기회|비용.*변경|불가할\s*수|제외|별도|필수|반드시)"
)
PAYMENT = r"(?i)(?:결제|결재|대금|payment|선입금|현금\s*결제|발주\s*시\s*\d+\s*%|발주시\s*\d+\s*%)"
DELIVERY = r"(?i)(?:납\s*기|납기|delivery|도입가능일|발주\s*후|계약\s*후|납품.*이내)"
WARRANTY = r"(?i)(?:무상|보증|warranty|a/?s|유지보수|무상보수|factory\s*warranty)"
VALIDITY = r"(?i)(?:유효기간|validity|견적일로부터|발행\s*후)"
INSTALL_SCHEDULE = r"(?i)(?:설치일정|발주확정\s*후)"
SOFTWARE = r"(?i)(소\s*프\s*트\s*웨\s*어|운영\s*pc|cms|s/w|software)"
EXCLUDED = r"(?i)(미포함|별도\s*옵션|별도|제외|미지원|not included|excluded)"
ACTIONABLE = (
    r"(?i)(?:(?:전기|통신|인입|인테리어|마감)\s*공사|제외|별도|필수|반드시|현장\s*실사|현장답사|구조검토|비용.*변경|불가할\s*수|"
    r"외부\s*유출|영업기회|전원.*통신|수요처\s*제공|사전에\s*확인)"
)
POLITE_END = r"(?:견적서|관련\s*견적|드립니다|바랍니다|당부드립니다|있습니다|됩니다)[.)]?$"
BOUNDARY = r"(?i)^(?:품명|품목|규격|수량|단가|금액|quotation|estimate|견적서)$"
VALID_PAYMENT = r"(?i)(?:협의|선입금|현금|발주|설치|계약|\d+\s*%)"
MONEY = r"(?:₩|￦|\\)\s*[\d,]+|(?:₩|￦|\\)?\s*(?:\d{1,3},){1,4}\d{3}"
RESPELL = {
    r"(?i)견\s*적\s*유\s*효\s*기\s*간": "견적유효기간", r"(?i)무\s*상\s*보\s*수\s*기\s*간": "무상보수기간",
    r"(?i)유\s*상\s*보\s*수\s*정?\s*비\s*요\s*율": "유상보수정비요율", r"(?i)도\s*입\s*가\s*능\s*일": "도입가능일",
    r"(?i)도\s*착\s*지": "도착지", r"(?i)대\s*금\s*결\s*[제재]": "대금결재", r"(?i)결\s*제\s*조\s*건": "결제조건", r"(?i)납\s*기": "납기",
}
INLINE_SPLIT = r"(?i)\s+(?=(?:\(?\d{1,2}\)?[.)])\s+|[□▣]?\s*(?:payment|packing|validity)\b)"
TAIL_LABELS = r"(?i)\s+(?=□?\s*(?:packing|validity|전\s*화\s*번\s*호|전화번호|fax|tel|견적담당자|담당자))"
LOCATION = (
    r"(?:서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충북|충남|전북|전남|경북|경남|제주|시|군|구|읍|면|동|로|길|현장|도착지)"
)


def clean_line(text: Column) -> Column:
    """Recognition marks off, spaced labels respelled, number prefix removed."""
    t = F.regexp_replace(text, r"(?i):?(?:un)?selected:?", " ")
    t = F.regexp_replace(one_space(t), r"^[ \t|□▣]+|[ \t|□▣]+$", "")
    for pattern, word in RESPELL.items():
        t = F.regexp_replace(t, pattern, word)
    return F.trim(F.regexp_replace(t, NUMBER_PREFIX, ""))


def tight(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s:：.\-_*▣|]", "")


def note_lines(docs: DataFrame, key: str = "quote_id") -> DataFrame:
    """(key, pos, text, table_like, kind): cleaned fragments in reading order; kind is header, boundary or line."""
    bar = lambda s: F.size(F.split(s, r"\|")) >= 3
    pieces = F.flatten(
        F.transform(
            lines_of(F.col("text")),
            lambda s: F.transform(
                F.flatten(F.transform(
                    F.split(one_space(s), INLINE_SPLIT), lambda f: F.when(bar(f), F.split(f, r"\|")).otherwise(F.array(f))
                )),
                lambda f, i: F.struct(clean_line(f).alias("text"), bar(s).alias("table_like"), (bar(s) & (i == 0)).alias("opens")),
            ),
        )
    )
    rows = once(docs.select(key, "text"), "_p", pieces).select(key, F.posexplode("_p").alias("pos", "r"))
    return (
        rows.select(key, "pos", "r.text", "r.table_like", "r.opens").where((F.col("text") != "") | F.col("opens"))
        .withColumn("is_header", F.col("text").rlike(HEADER))
        .withColumn("is_boundary", tight(F.col("text")).rlike(BOUNDARY) & (F.col("text") != ""))
    )


def with_section(lines: DataFrame, key: str = "quote_id") -> DataFrame:
    """Section each line belongs to: a header opens it, a boundary word or a table row closes it."""
    event = F.when(F.col("is_header"), F.col("text")).when(F.col("is_boundary") | F.col("opens"), "")
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    out = lines.withColumn("section", F.coalesce(F.last(event, ignorenulls=True).over(upto), F.lit("")))
    return out.where(~F.col("is_header") & (F.col("text") != "")).drop("is_header", "is_boundary", "opens")


def with_label(lines: DataFrame, key: str = "quote_id") -> DataFrame:
    """label and value; a bare label waits for the next unlabelled line."""
    own = lines.withColumn("_l", F.trim(F.regexp_extract("text", LABEL, 1))).withColumn(
        "_v", F.trim(F.regexp_extract("text", LABEL, 2))
    )
    bare = (F.col("_l") != "") & (F.col("_v") == "")
    event = F.when(bare, F.col("_l")).when(F.col("_l") == "", "")
    before = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    pending = F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(""))
    return (
        own.withColumn("_pending", pending)
        .withColumn("label", F.when(F.col("_l") != "", F.col("_l")).otherwise(F.col("_pending")))
        .withColumn("value", F.when(F.col("_l") != "", F.col("_v")).when(F.col("_pending") != "", F.col("text")).otherwise(""))
        .withColumn("is_bare_label", bare)
        .drop("_l", "_v", "_pending")
    )


def label_value_zip(docs: DataFrame, key: str = "quote_id") -> DataFrame:
    """Columns read one below the other: a run of bare labels followed by as many values.

    (key, pos, label, value). The last ``m`` labels of a run pair with the next ``m``
    unlabelled lines, ``m`` as large as both allow and at least two. Works inside each
    document's own row: nothing is shuffled, joined or broadcast.
    """
    staged = once(docs.select(key, "text"), "_t", F.filter(F.transform(lines_of(F.col("text")), clean_line), lambda s: s != ""))
    part = lambda s, i: F.trim(F.regexp_extract(s, LABEL, i))
    staged = once(staged, "_p", F.transform("_t", lambda s: F.struct(s.alias("text"), part(s, 1).alias("l"), part(s, 2).alias("v"))))
    kind = lambda r: F.when(r["l"] == "", "V").when(r["v"] == "", "L").otherwise("X")
    staged = once(staged, "_k", F.transform("_p", kind))
    opens = lambda i: (i == 0) | (F.get("_k", i) != F.get("_k", i - 1))
    staged = once(staged, "_s", F.array_compact(F.transform("_k", lambda k, i: F.when(opens(i), i))))
    after = lambda j: F.coalesce(F.get("_s", j), F.size("_k"))
    cuts = F.transform("_s", lambda start, j: F.when(
        (F.get("_k", start) == "L") & (F.get("_k", after(j + 1)) == "V"),
        F.struct(after(j + 1).alias("at"), F.least(after(j + 1) - start, after(j + 2) - after(j + 1)).alias("m"))))
    cut = staged.select(key, "_p", F.explode(F.filter(cuts, lambda c: c["m"] >= 2)).alias("_c"))
    slots = F.transform(F.sequence(F.lit(0), F.col("_c.m") - 1), lambda o: F.struct(
        (F.col("_c.at") + o).cast("bigint").alias("pos"), F.get("_p", F.col("_c.at") - F.col("_c.m") + o)["l"].alias("label"),
        F.get("_p", F.col("_c.at") + o)["text"].alias("value")))
    return cut.select(key, F.explode(slots).alias("_z")).select(key, "_z.pos", "_z.label", "_z.value")


def term_value(text: Column) -> Column:
    """Value part of a term, cut before a following label."""
    t = clean_line(text)
    inner = F.trim(F.regexp_extract(t, LABEL, 2))
    t = F.when(inner != "", inner).otherwise(t)
    t = F.get(F.split(t, TAIL_LABELS), F.lit(0))
    return F.regexp_replace(t, r"^[ .:：,\-□▣]+|[ .:：,\-□▣]+$", "")


def excluded_reason(text: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(text, MONEY, ""), r"[\d,\s.+\-=/()]", "")
    return first_match([
        (text.rlike(SUMMARY), "summary_amount"),
        (text.rlike(HEADER_FOOTER), "header_footer"),
        (text.rlike(MONEY) & (F.length(rest) < 5), "money_dominant"),
        (text.rlike(SPEC) & ~text.rlike(CONTRACT_RISK), "line_item_spec"),
    ])


def classify_notes(docs: DataFrame, key: str = "quote_id") -> DataFrame:
    """Every remark line with its class, cleaned term, strength and whether it needs action."""
    base = with_label(with_section(note_lines(docs, key), key), key).where(~F.col("is_bare_label"))
    zipped = label_value_zip(docs, key).select(
        key, "pos", F.lit(1).alias("part"), F.concat_ws(": ", "label", "value").alias("text"),
        F.lit(True).alias("table_like"), F.lit("").alias("section"), "label", "value",
    )
    rows = base.drop("is_bare_label").withColumn("part", F.lit(0)).unionByName(zipped)
    t, label = F.col("text"), F.col("label")
    content = F.when(F.col("value") != "", F.col("value")).otherwise(t)
    staged = rows.withColumn("excluded_reason", excluded_reason(t)).withColumn("term", term_value(content)).withColumn(
        "actionable", t.rlike(ACTIONABLE)
    )
    software = t.rlike(SOFTWARE) & t.rlike(EXCLUDED) & ~t.contains("유효기간")
    installs = label.rlike(INSTALL_SCHEDULE) | (
        t.rlike(CONTRACT_RISK) & (F.length(tight(t)) >= 6) & ~tight(t).isin("별도협의", "별도", "제외")
    )
    special = F.when(F.col("table_like") & ~F.col("actionable"), False).when(
        F.col("section") == "", t.rlike(r"외부\s*유출|영업기회|관련\s*견적서|확인")
    ).otherwise(F.col("actionable") | ((F.length(tight(t)) >= 15) & t.rlike(POLITE_END)))
    return staged.withColumn(
        "kind",
        first_match([
            (F.col("excluded_reason").isNotNull(), "excluded"),
            (label.rlike("(?i)payment|결제|결재|대금") | t.rlike(PAYMENT),
             F.when(F.col("term").rlike(VALID_PAYMENT) & (F.length(tight(F.col("term"))) >= 2), "payment").otherwise("invalid_payment")),
            (label.rlike(r"(?i)납\s*기|delivery|도입가능일") | t.rlike(DELIVERY), "delivery"),
            (label.rlike("(?i)무상|보증|warranty|a/?s|유지보수") | t.rlike(WARRANTY), "warranty"),
            (label.rlike("(?i)validity|유효기간") | t.rlike(VALIDITY), "validity"),
            (label.contains("도착지"), F.when(F.col("term").rlike(LOCATION), "location").otherwise("none")),
            (installs, "install"),
            (software, "software"),
            (special, "special"),
        ], "none"),
    ).withColumn(
        "strength",
        F.when(label != "", 2).otherwise(0) + F.when(F.col("term").rlike(r"선입금|현금|발주\s*시|발주시"), 2).otherwise(0)
        + F.when(F.col("term").rlike(r"\d+\s*%"), 1).otherwise(0) + F.when(F.col("term").contains("협의"), 1).otherwise(0),
    )


def note_terms(docs: DataFrame, key: str = "quote_id") -> DataFrame:
    """Payment, validity, delivery, warranty, install and special remarks per document."""
    rows = classify_notes(docs, key)
    pick = lambda kind: F.col("kind") == kind
    special = pick("special") | pick("software") | (F.col("kind").isin("warranty", "install") & F.col("actionable") & (
        (F.col("section") != "") | pick("install")))
    listed = lambda cond, value: F.array_distinct(F.transform(
        F.array_sort(F.array_compact(F.collect_list(F.when(cond, F.struct("part", "pos", value.alias("v")))))), lambda r: r["v"]))
    return rows.groupBy(key).agg(
        F.max_by(F.when(pick("payment"), F.col("term")), F.when(pick("payment"), F.struct("strength", (-F.col("part")).alias("s"), (-F.col("pos")).alias("p")))).alias("payment_terms"),
        F.min_by(F.when(pick("validity"), F.col("term")), F.when(pick("validity"), F.struct("part", "pos"))).alias("validity_terms"),
        listed(pick("delivery"), F.col("term")).alias("delivery_terms"),
        listed(pick("warranty"), F.col("term")).alias("warranty_terms"),
        listed(pick("install"), F.col("term")).alias("install_terms"),
        listed(special & (F.length(tight(F.col("text"))) >= 4), F.col("text")).alias("special_notes"),
        F.count_if(F.col("excluded_reason").isNotNull()).alias("excluded_count"),
    )


def needs_check(notes: Column) -> Column:
    """Remarks that a person has to act on."""
    return F.filter(notes, lambda s: s.rlike(ACTIONABLE))


