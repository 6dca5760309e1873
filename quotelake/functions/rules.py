"""Line classification and cost buckets as single ordered CASE expressions (no join, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import vocab as v
from quotelake.functions.expr import any_of, contains_any, first_match, squeeze


# Words of an item's texts that tell its first category; the first group with a word wins.
CATEGORY_WORDS = [
    ("DISPLAY", ["비디오월", "video wall", "패널", "panel", "did"]),
    ("MOUNT", ["브라켓", "bracket", "마운트", "거치"]),
    ("CABLE", ["케이블", "잡자재", "cable"]),
    ("INSTALL", ["설치", "시운전", "install"]),
    ("DISPLAY", ["led", "전광판", "비디오월", "dled", "lcd", "display"]),
    ("MOUNT", ["브라켓", "마운트", "거치대", "구조물", "보강대"]),
    ("PLAYER", ["플레이어", "player", "colorlight", "processor", "프로세서", "controller"]),
    ("INSTALL", ["설치", "시공", "시운전", "교육"]),
    ("SOFTWARE", ["software", "소프트웨어", "라이선스"]),
]


def initial_category(*texts: Column) -> Column:
    """Category of an item as it leaves table or text reading, before any re-classification."""
    text = F.lower(F.concat_ws(" ", *texts))
    return first_match([(contains_any(text, words), category) for category, words in CATEGORY_WORDS], "ETC")


def _outcome(category: str, cost_type: str, reason: str) -> Column:
    return F.struct(
        F.lit(category).alias("category"), F.lit(cost_type).alias("cost_type"), F.lit(reason).alias("reason")
    )


def _staged_texts(df: DataFrame, name: str, spec: str) -> DataFrame:
    """Lower-cased and space-free texts as columns, so the rules do not recompute them per branch."""
    return (
        df.withColumn("_name", F.lower(F.coalesce(name, F.lit(""))))
        .withColumn("_text", F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(spec, F.lit("")))))
        .withColumn("_tight_name", squeeze(F.col("_name")))
        .withColumn("_tight_text", squeeze(F.col("_text")))
    )


def reclassify(df: DataFrame, before: str = "category", name: str = "name", spec: str = "spec_raw", out: str = "rule") -> DataFrame:
    """Add struct ``out`` (category, cost_type, reason) per line, NULL when no rule applies."""
    low_name, text = F.col("_name"), F.col("_text")
    tight_name, tight_text = F.col("_tight_name"), F.col("_tight_text")
    rules = [
        (tight_name.contains("수신카드"), ("PLAYER", "SYSTEM_EQUIPMENT", "item_name accessory/material keyword")),
        (contains_any(tight_name, v.ACCESSORY_TOKENS), ("CABLE", "MATERIALS", "item_name accessory/material keyword")),
        (tight_name.contains("모듈") & tight_text.contains("예비품"),
         ("CABLE", "MATERIALS", "item_name module spare material keyword")),
        (contains_any(tight_name, v.OVERHEAD_TOKENS) & contains_any(tight_text, v.INSTALL_EVIDENCE),
         ("INSTALL", "INSTALL", "generic expense item with install evidence")),
    ]
    rules += [(contains_any(tight_name, t), (c, k, r)) for t, c, k, r in v.COMPACT_NAME_RULES]
    rules += [(contains_any(low_name, t), (c, k, v.NAME_RULE_REASON)) for t, c, k in v.NAME_RULES]
    rules.append((F.col(before) == "DISPLAY", ("DISPLAY", "DISPLAY", v.KEEP_DISPLAY_REASON)))
    kit = text.contains("잡자재") & text.contains("설치 kit")
    first, *rest = v.TEXT_RULES
    rules.append((contains_any(text, first[0]), first[1:]))
    rules.append((kit, ("CABLE", "MATERIALS", "material keyword")))
    rules += [(contains_any(text, t), (c, k, r)) for t, c, k, r in rest]
    # the rule number is found once per line, its outcome is a constant lookup
    outcomes = [_outcome(*outcome) for _, outcome in rules]
    number = first_match([(cond, i + 1) for i, (cond, _) in enumerate(rules)])
    return (
        _staged_texts(df, name, spec)
        .withColumn("_rule_no", number)
        .withColumn(out, F.get(F.array(*outcomes), F.col("_rule_no") - 1))
        .drop("_name", "_text", "_tight_name", "_tight_text", "_rule_no")
    )


def with_cost_bucket(df: DataFrame, out: str = "bucket") -> DataFrame:
    """Which of the eight comparison buckets each line belongs to.

    Expects name, spec_raw, category and cost_type.
    """
    low_name, text, tight = F.col("_name"), F.col("_text"), F.col("_tight_name")
    kind, category = F.col("_kind"), F.col("category")
    rules = [(contains_any(low_name, t), b) for t, b in v.BUCKET_NAME_FIRST]
    rules += [(contains_any(tight, t), b) for t, b in v.BUCKET_COMPACT_NAME]
    rules.append(((kind == "DISPLAY") | (category == "DISPLAY"), "display_hw"))
    rules += [(kind == k, b) for k, b in v.COST_TYPE_BUCKET.items() if k != "DISPLAY"]
    rules.append((contains_any(text, v.BUCKET_SPARE), "materials"))
    rules.append((kind == "INSTALL", "installation"))
    for cats, tokens, bucket in v.BUCKET_TEXT:
        cond = contains_any(text, tokens)
        rules.append((any_of([category == c for c in cats]) | cond if cats else cond, bucket))
    return (
        _staged_texts(df, "name", "spec_raw")
        .withColumn("_kind", F.upper(F.coalesce("cost_type", F.lit(""))))
        .withColumn(out, first_match(rules, "etc"))
        .drop("_name", "_text", "_tight_name", "_tight_text", "_kind")
    )


def separate_marked(bucket: str, context: Column) -> Column:
    """Does the surrounding text say this bucket is charged separately or left out?"""
    tokens = v.SEPARATE_BUCKET_TOKENS.get(bucket)
    if not tokens:
        return F.lit(False)
    low = F.lower(context)
    return contains_any(low, [m.lower() for m in v.SEPARATE_MARKERS]) & contains_any(context, tokens)


def software_exclusion(context: Column) -> Column:
    """The phrase saying software is not included, NULL when there is none."""
    found = [F.nullif(F.regexp_extract(context, p, 1), F.lit("")) for p in v.SOFTWARE_EXCLUSION_PATTERNS]
    text = F.regexp_replace(F.coalesce(*found), r"(?U)\s+", " ")
    return F.regexp_replace(text, r"^[ :\-]+|[ :\-]+$", "")
