"""Which company sent a document: candidates from five sources, best one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions.expr import contains_any, first_match, once, strip
from quotelake.functions.names import normalize_company
from quotelake.operators.contain import containment_join, few_enough
from quotelake.operators.extract import lines_of

# Labels, names that are no company, known aliases, source confidences.
INVALID_NAMES = ["", "사업자", "사업자등록번호", "공급자", "법인명", "대표자", "상호", "상호명", "업체명", "회사명", "문서번호", "등록번호"]
NAME_LABELS = ["법인명", "상호명", "회사명", "공급자명", "상호"]
SKIP_LABELS = ["사업자등록번호", "대표자", "주소", "사업장 주소", "사업장주소", "전화", "팩스", "업태", "종목"]
ALIASES = {
    "hyosungitx": "효성ITX", "hyosung itx": "효성ITX", "효성itx": "효성ITX", "유어존": "유어존", "youzone": "유어존",
    "가이드삼정": "가이드삼정", "oriondisplay": "오리온디스플레이", "oriondisplay co.,ltd.": "오리온디스플레이",
    "oriondisplay co.,ltd": "오리온디스플레이", "oriondisplay.net": "오리온디스플레이", "오리온디스플레이": "오리온디스플레이",
}
COMPANY_MARKS = ["주식회사", "(주)", "㈜", "ITX", "itx"]
FILE_IGNORED = ["견적서", "estimate", "quotation"]
FILE_PRODUCT_WORDS = ["led", "전광판", "비디오월", "옵션비교", "디스플레이"]
CONFIDENCE = {
    "original": 0.55, "ocr_label_next_line": 0.9, "partner_alias": 0.98, "partner_master_text": 0.95,
    "header_company_candidate": 0.75, "file_name_alias": 0.92, "file_name": 0.9, "file_name_fallback": 0.6,
}


def clean_candidate(value: Column) -> Column:
    text = F.get(F.split(strip(value), r"\s{2,}|\|"), F.lit(0))
    return F.regexp_replace(text, r"^[ :|\-]+|[ :|\-]+$", "")


def valid_candidate(value: Column) -> Column:
    key = normalize_company(value)
    return (
        value.isNotNull() & (value != "") & ~key.isin(INVALID_NAMES) & ~value.isin(SKIP_LABELS) & ~value.rlike(r"^\d+$")
        & ~value.rlike(r"\d{3}-\d{2}-\d{5}") & ~value.rlike(r"\d{2,4}-\d{3,4}-\d{4}") & (F.length(key) >= 2)
    )


def _rows(df: DataFrame, value: Column, source: str, order: int) -> DataFrame:
    return df.select(
        "doc_id", value.alias("value"), F.lit(source).alias("source"),
        F.lit(CONFIDENCE[source]).alias("confidence"), F.lit(order).alias("source_order"),
    )


def _name_hits(hits: DataFrame, alias: tuple[str, int], name: tuple[str, int]) -> DataFrame:
    """Candidates of names found, with (source, order) by their kind; the look-up is read once for both kinds."""
    kind = lambda x, y: F.when(F.col("is_alias"), F.lit(x)).otherwise(F.lit(y))
    return hits.select(
        "doc_id", F.col("canonical").alias("value"), kind(alias[0], name[0]).alias("source"),
        kind(CONFIDENCE[alias[0]], CONFIDENCE[name[0]]).alias("confidence"), kind(alias[1], name[1]).alias("source_order"))


def label_next_line(docs: DataFrame) -> DataFrame:
    """Company named within three lines below a label, other labels skipped."""
    lines = F.filter(F.transform(lines_of(F.col("text")), lambda s: strip(s)), lambda s: s != "")
    staged = once(docs.select("doc_id", "text"), "_lines", lines)
    after = lambda i: F.get(
        F.filter(
            F.transform(F.slice("_lines", i + 2, F.lit(3)), lambda s: clean_candidate(s)),
            lambda s: valid_candidate(s),
        ),
        F.lit(0),
    )
    found = F.filter(
        F.transform("_lines", lambda s, i: F.when(F.regexp_replace(s, r"^[ :|\-]+|[ :|\-]+$", "").isin(NAME_LABELS), after(i))),
        lambda s: s.isNotNull(),
    )
    return _rows(staged.withColumn("_v", F.explode(found)), F.col("_v"), "ocr_label_next_line", 1)


def _first_lines(n: int | None) -> Column:
    every = lines_of(F.col("text"))
    return F.slice(every, 1, n) if n else every


def header_companies(docs: DataFrame, header_lines: int | None = None) -> DataFrame:
    """Company-like lines, among the first ``header_lines`` where a number is named."""
    lines = F.transform(_first_lines(header_lines), lambda s: clean_candidate(s))
    found = F.filter(lines, lambda s: valid_candidate(s) & contains_any(s, COMPANY_MARKS))
    return _rows(docs.select("doc_id", F.explode(found).alias("_v")), F.col("_v"), "header_company_candidate", 4)


def generic_file_vendor(stem: Column) -> Column:
    """Last token of the file name that could be a company."""
    tokens = F.filter(F.split(stem, r"[_\-\s]+"), lambda s: s != "")
    usable = F.filter(
        F.reverse(tokens),
        lambda s: ~F.lower(s).isin(FILE_IGNORED) & ~s.rlike(r"(?i)^(?:[qmvs]-?\d+|q\d+)$")
        & ~contains_any(F.lower(s), FILE_PRODUCT_WORDS) & valid_candidate(s),
    )
    return F.get(usable, F.lit(0))


def _needles(partners: DataFrame) -> DataFrame:
    """Partner names and alias spellings with the name they stand for."""
    spark = partners.sparkSession
    known = partners.select(
        normalize_company(F.col("name")).alias("needle"), F.col("name").alias("canonical"), F.lit(False).alias("is_alias")
    )
    alias = spark.createDataFrame(list(ALIASES.items()), "a string, canonical string").select(
        normalize_company(F.col("a")).alias("needle"), "canonical", F.lit(True).alias("is_alias")
    )
    return known.unionByName(alias).where(F.col("needle") != "").distinct()


def vendor_candidates(
    docs: DataFrame, partners: DataFrame, top_lines: int | None = None, header_lines: int | None = None
) -> DataFrame:
    """All candidates: (doc_id, value, source, confidence, source_order).

    ``docs`` has doc_id, text, file_name and vendor_name (the parser's own guess, may be empty).
    """
    needles = _needles(partners)
    small = few_enough(needles, "needle")
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    top = F.array_join(_first_lines(top_lines), "\n")
    # the two searched parts keep a blank between them, so no name can match across
    space = docs.select("doc_id", F.concat(normalize_company(top), F.lit(" "), normalize_company(F.col("file_name"))).alias("space"))
    hits = containment_join(space, "space", needles, "needle", keep_text=False, small=small)
    name = docs.select("doc_id", normalize_company(stem).alias("space"))
    file_hits = containment_join(name, "space", needles, "needle", keep_text=False, small=small)
    own = clean_candidate(F.col("vendor_name"))
    parts = [
        _rows(docs.where(valid_candidate(own)), own, "original", 0),
        label_next_line(docs),
        _name_hits(hits, ("partner_alias", 2), ("partner_master_text", 3)),
        header_companies(docs, header_lines),
        _name_hits(file_hits, ("file_name_alias", 5), ("file_name", 6)),
        _rows(docs, generic_file_vendor(stem), "file_name_fallback", 7),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(valid_candidate(F.col("value")))


def resolve_vendor_names(
    docs: DataFrame, partners: DataFrame, top_lines: int | None = None, header_lines: int | None = None
) -> DataFrame:
    """Best candidate per document by confidence, then normalized length, then source order.

    Partner names are sought in the whole text, or in its first ``top_lines``; company-like lines in all lines, or in
    the first ``header_lines``. A map-side-combined maximum: candidates of one document are never gathered.
    """
    cand = vendor_candidates(docs, partners, top_lines, header_lines)
    best = cand.groupBy("doc_id").agg(
        F.max(
            F.struct(
                F.col("confidence"), F.length(normalize_company(F.col("value"))).alias("n"),
                (-F.col("source_order")).alias("o"), F.col("value"), F.col("source"),
            )
        ).alias("b"),
        F.count("*").alias("candidate_count"),
    )
    bare = F.regexp_replace(strip(F.col("b.value")), r"(?i)^\(?주\)?", "")
    bare = F.replace(F.replace(bare, F.lit("㈜"), F.lit("")), F.lit("주식회사"), F.lit(""))
    bare = F.regexp_replace(bare, r"^[ ()\[\]{}]+|[ ()\[\]{}]+$", "")
    master = partners.groupBy(normalize_company(F.col("name")).alias("k")).agg(F.min("name").alias("master_name"))
    alias = first_match([(F.col("k") == a.replace(" ", "").replace(".", "").replace(",", ""), c) for a, c in ALIASES.items()])
    return (
        docs.select("doc_id")
        .join(best, "doc_id", "left")
        .withColumn("k", normalize_company(F.col("b.value")))
        .join(master, "k", "left")
        .select(
            "doc_id",
            F.coalesce(alias, "master_name", bare).alias("vendor_name"),
            F.coalesce("b.source", F.lit("unresolved")).alias("vendor_name_source"),
            F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        )
    )
