"""The comparison table: cost buckets, highlights, representative hardware, display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelake.functions import vocab as v
from quotelake.functions.expr import any_of, contains_any, first_match, messages
from quotelake.functions.rules import separate_marked, software_exclusion, with_cost_bucket
from quotelake.operators.scale import best_per_group, falling, position, rank_all

# ------------------------------------------------------------------ cost buckets


def line_amount() -> Column:
    return F.coalesce(F.col("total_price"), (F.col("quantity") * F.col("unit_price")).cast("bigint"))


def cost_items(lines: DataFrame) -> DataFrame:
    """Every line with its bucket and amount (the source items of the breakdown)."""
    return with_cost_bucket(lines).withColumn("amount", line_amount())


def cost_breakdown(quotes: DataFrame, items: DataFrame) -> DataFrame:
    """Amount and status of the eight buckets per quote.

    ``quotes`` needs quote_id and context (notes, checks and warnings joined by a space).
    A fixed list of conditional sums replaces a pivot, so lines are pre-aggregated map-side.
    """
    aggs = []
    for b in v.BUCKETS:
        mine = F.col("bucket") == b
        aggs += [
            F.sum(F.when(mine, F.col("amount"))).alias(f"{b}_sum"),
            F.count_if(mine).alias(f"{b}_items"),
        ]
    sums = items.groupBy("quote_id").agg(*aggs)
    out = quotes.join(sums, "quote_id", "left")
    note = software_exclusion(F.col("context"))
    for b in v.BUCKETS:
        used = F.coalesce(F.col(f"{b}_items"), F.lit(0)) > 0
        marked = F.coalesce(separate_marked(b, F.col("context")), F.lit(False))
        if b == "software":
            marked = marked | note.isNotNull()
        start = "to_be_discussed" if b == "travel_expense" else "missing"
        base = F.lit(0).cast("bigint") if b in ("etc", "software", "content") else F.lit(None).cast("bigint")
        out = out.withColumn(f"{b}_amount", F.coalesce(F.col(f"{b}_sum"), base)).withColumn(
            f"{b}_status", F.when(used, "included").when(marked, "separate").otherwise(start)
        )
    return out.drop(*[f"{b}_{s}" for b in v.BUCKETS for s in ("sum", "items")])


# -------------------------------------------------------------------- highlights


def total_section(check_required: Column) -> tuple[Column, Column]:
    """(is_confirmed, display_text) of the total amount."""
    doubtful = F.exists(check_required, lambda m: m.contains("금액") | m.contains("가격"))
    shown = F.coalesce(
        F.nullif(F.col("total_supply_price"), F.lit(0)), F.nullif(F.col("total_with_vat"), F.lit(0))
    )
    confirmed = (F.coalesce("total_with_vat", F.lit(0)) != 0) & ~doubtful & shown.isNotNull()
    text = F.coalesce(F.concat(F.format_number(shown, 0), F.lit("원")), F.lit("미확정"))
    return confirmed, text


def highlight_bests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Best figure per competing set, one small row each."""
    return rows.groupBy(*keys).agg(
        F.min(F.when(F.col("is_confirmed"), F.col("total_with_vat"))).alias("_lowest"),
        F.min("delivery_weeks").alias("_fastest"),
        F.max("warranty_months").alias("_longest"),
        F.max("final_score").alias("_highest"),
    )


def highlights(rows: DataFrame, keys: list[str], suffix: str = "") -> DataFrame:
    """Flag every row that reaches the best figure of its set; ties are all flagged."""
    eq = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return (
        rows.join(highlight_bests(rows, keys), keys, "left")
        .withColumn(f"is_lowest_total_price{suffix}", F.col("is_confirmed") & eq("total_with_vat", "_lowest"))
        .withColumn(f"is_fastest_delivery{suffix}", eq("delivery_weeks", "_fastest"))
        .withColumn(f"is_longest_warranty{suffix}", eq("warranty_months", "_longest"))
        .withColumn(f"is_highest_score{suffix}", eq("final_score", "_highest"))
        .drop("_lowest", "_fastest", "_longest", "_highest")
    )


POSITION_FLAGS = {
    "is_highest_final_score": ("final_score", F.max),
    "is_best_price_score": ("price_score", F.max),
    "is_lowest_total": ("total_with_vat", F.min),
    "is_highest_spec_score": ("spec_score", F.max),
    "is_lowest_spec_score": ("spec_score", F.min),
    "is_best_delivery_score": ("delivery_score", F.max),
    "is_best_warranty_score": ("warranty_score", F.max),
    "is_best_installation_score": ("installation_score", F.max),
}


def relative_position(top3: DataFrame, keys: list[str]) -> DataFrame:
    """Standing of each of the top rows among themselves.

    The input holds at most three rows per set, so a window over a set is small and the rows are made once.
    """
    together = W.partitionBy(*keys)
    return top3.withColumns({
        flag: F.coalesce(F.col(col) == agg(col).over(together), F.lit(False)) for flag, (col, agg) in POSITION_FLAGS.items()})


# ------------------------------------------------------------- hardware and installs

# Words that mark a line as hardware, or rule it out, and group hints.
HARDWARE_TOKENS = ["led", "비디오월", "lcd", "display", "did", "모니터", "패널", "전광판"]
NOT_HARDWARE_TOKENS = [
    "예비품", "유지보수", "세팅", "설치", "pc", "controller", "컨트롤러", "프로세서", "브라켓", "잡자재", "잔액", "미파싱",
]
WALL_HINTS = ["비디오월", "video wall", "did", "멀티비전", "베젤", "bezel", "46", "49", "55", "fhd"]
LED_HINTS = ["led", "전광판", "pixel pitch", "pitch", "p1.", "p2.", "p3.", "cob", "smd"]
SPEC_WORDS = [
    "해상도", "제안해상도", "화면사이즈", "스크린", "screen", "display size", "전체 크기", "전체화면", "pixel pitch",
    "led pitch", "pitch", "밝기", "nit", "cd", "bezel", "베젤", "refresh", "hz", "전기용량", "최대전력", "최대소비전력",
    "소비전력", "kw", "cabinet", "module", "smd", "cob", "flexible", "die-casting", "fhd", "uhd", "4k",
]
EXTRA_SPEC_KEYS = ["power_consumption_kw", "refresh_rate_hz"]
SPEC_KEYS = [
    "screen_size_mm", "full_screen_size_mm", "resolution", "pixel_pitch_mm", "brightness_cd_m2", "brightness_nit",
]


def representative_line(lines: DataFrame, group: Column | None = None) -> DataFrame:
    """The line that stands for a quote's hardware.

    Display lines first, else lines named like hardware; accessories and services never;
    lines naming the quote's product group preferred (by name, then by specification);
    then most specification fields, highest amount, longest specification, first line.
    """
    name = F.lower(F.coalesce("name", F.lit("")))
    text = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("spec_raw", F.lit(""))))
    residual = F.coalesce(F.col("spec_parsed")["reconciliation_residual"] == "true", F.lit(False))
    display = F.col("category") == "DISPLAY"
    hint = F.lower(group) if group is not None else F.lit("")
    wall, led = hint.contains("비디오월"), hint.contains("led") | hint.contains("전광판")
    hits = lambda t: first_match([(wall, contains_any(t, WALL_HINTS)), (led, contains_any(t, LED_HINTS))], False)
    spec_count = sum((F.when(F.col("spec_parsed")[k].isNotNull(), 1).otherwise(0) for k in SPEC_KEYS), F.lit(0))
    tier = F.when(display, 0).when(contains_any(name, HARDWARE_TOKENS), 1)
    spec = F.lower(F.coalesce("spec_raw", F.lit("")))
    described = contains_any(spec, SPEC_WORDS) | spec.rlike(r"\bp\s*\d+(?:\.\d+)?\b") | any_of(
        [F.col("spec_parsed")[k].isNotNull() for k in SPEC_KEYS + EXTRA_SPEC_KEYS]
    )
    usable = ~residual | (display & described)
    marked = (
        lines.withColumn("_usable", usable).where(F.col("_usable")).drop("_usable").withColumn("_tier", tier)
        .withColumn("_bad", contains_any(name, NOT_HARDWARE_TOKENS))
        .withColumn("_residual", residual)
    )
    # a quote that has display lines never falls back to other hardware, even when all are ruled out
    order = [
        F.col("_residual"), F.col("_tier").asc_nulls_last(), F.col("_bad"),
        F.when(hits(name), 0).when(hits(text), 1).otherwise(2),
        spec_count.desc(), F.coalesce("total_price", F.lit(0)).desc(),
        F.length(F.coalesce("spec_raw", F.lit(""))).desc(), F.col("line_order"),
    ]
    best = best_per_group(marked, ["quote_id"], order)
    return best.where(F.col("_tier").isNotNull() & ~F.col("_bad")).drop(
        "_tier", "_bad", "_residual"
    )


def installation_included(lines: DataFrame, scores: DataFrame) -> DataFrame:
    """Installation is included when a line with a positive (or unknown) amount says so, else by score."""
    text = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("spec_raw", F.lit(""))))
    says = any_of([
        F.col("category") == "INSTALL",
        F.coalesce(F.upper("cost_type") == "INSTALL", F.lit(False)),
        contains_any(text, v.INSTALL_KEYWORDS),
    ])
    counted = ~F.coalesce(line_amount() <= 0, F.lit(False))
    by_line = lines.groupBy("quote_id").agg(F.bool_or(says & counted).alias("_by_line"))
    return (
        scores.join(by_line, "quote_id", "left")
        .withColumn(
            "installation_included",
            F.coalesce("_by_line", F.lit(False)) | (F.coalesce("installation_score", F.lit(0.0)) >= 80),
        )
        .drop("_by_line")
    )


def install_from_notes(notes: Column, by_line: Column) -> Column:
    """Tri-state variant: a line decides, else the notes, else unknown."""
    low = F.lower(F.coalesce(notes, F.lit("")))
    return (
        F.when(by_line, True)
        .when(low.contains("installation included"), True)
        .when(low.contains("installation separate"), False)
    )


# ------------------------------------------------------------------ display columns


def split_notes(values: Column) -> tuple[Column, Column]:
    """(visible, internal) distinct notes."""
    internal = lambda s: contains_any(F.lower(s), [p.lower() for p in v.INTERNAL_NOTE_PATTERNS])
    cleaned = F.array_distinct(F.filter(F.transform(values, lambda s: F.trim(s)), lambda s: s != ""))
    return F.filter(cleaned, lambda s: ~internal(s)), F.filter(cleaned, internal)


def conditions(quotes: DataFrame) -> DataFrame:
    """Delivery, warranty and after-service texts of the comparison."""
    notes = F.coalesce("notes_raw", F.lit(""))
    months = F.nullif(F.col("warranty_months"), F.lit(0))
    shown = F.coalesce(F.concat(months.cast("string"), F.lit("개월")), F.lit("미기재"))
    travel = contains_any(F.concat_ws(" ", F.array_join("check_required", " "), notes), ["출장실비"])
    return (
        quotes.withColumn(
            "delivery_text",
            F.coalesce(
                F.nullif(F.col("delivery_basis_raw"), F.lit("")),
                F.concat(F.nullif(F.col("delivery_weeks"), F.lit(0)).cast("string"), F.lit("주")),
                F.lit("미기재"),
            ),
        )
        .withColumn(
            "warranty_display",
            F.when(months.isNotNull() & travel, F.concat(shown, F.lit(", 출장실비 별도"))).otherwise(shown),
        )
        .withColumn(
            "as_method",
            F.when(contains_any(notes, ["현장 방문", "방문 A/S", "출장"]), "현장 방문")
            .when(contains_any(notes, ["택배", "입고", "센터"]), "택배/입고 수리")
            .otherwise("미기재"),
        )
    )


def badges(rows: DataFrame) -> DataFrame:
    """Supplier badges, strengths and weaknesses."""
    premium = F.coalesce("is_premium", F.lit(False))
    tags = messages(
        (F.col("is_lowest_total_price"), "최저가"),
        (F.col("is_fastest_delivery"), "납기 우위"),
        (premium, "프리미엄 파트너"),
        (~F.col("is_confirmed"), "총액 미확정"),
    )
    good = messages(
        (F.col("is_lowest_total_price"), "가격 경쟁력"),
        (F.col("is_fastest_delivery"), "납기 우위"),
        (F.col("is_longest_warranty"), "보증 조건 우수"),
        (premium, "프리미엄 파트너"),
    )
    issues = F.concat("check_required", "rule_warnings")
    return (
        rows.withColumn("badges", F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("검토 대상"))))
        .withColumn("strength_text", F.when(F.size(good) > 0, F.array_join(good, ", ")).otherwise("조건 확인 후 판단 가능"))
        .withColumn("weakness_text", F.when(F.size(issues) > 0, F.array_join(issues, ", ")).otherwise("특이 단점 없음"))
    )


def first_per_quote(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First row per quote id in input order; rows without an id all pass."""
    loose = F.when(F.col("quote_id").isNull(), F.monotonically_increasing_id())
    return best_per_group(rows.withColumn("_loose", loose), [*keys, "quote_id", "_loose"], [F.col("input_no")]).drop("_loose")


def select_rows(rows: DataFrame, wanted: DataFrame | None, n: int | None) -> DataFrame:
    """Rows named in ``wanted`` (project_id, quote_id), all of them; projects naming none use the top ``n``, else all.

    ``chosen`` tells which.
    """
    unnamed = F.col("rank") <= n if n else F.lit(True)
    if wanted is None:
        return rows.where(unnamed).withColumn("chosen", F.lit(False))
    named = wanted.select("project_id").distinct().withColumn("chosen", F.lit(True))
    picked = wanted.select("project_id", "quote_id").distinct().withColumn("_picked", F.lit(True))
    marked = rows.join(named, "project_id", "left").join(picked, ["project_id", "quote_id"], "left")
    return marked.withColumn("chosen", F.coalesce("chosen", F.lit(False))).where(
        F.when(F.col("chosen"), F.col("_picked").isNotNull()).otherwise(unnamed)).drop("_picked")


def display_order(
    rows: DataFrame, keys: list[str], hot: DataFrame, n: int | None = None, always: Column | None = None, out: str = "position"
) -> DataFrame:
    """Rows by score, highest first, missing last, input order on ties.

    ``n`` keeps the first positions and the rows where ``always`` holds. ``hot`` lists keys too large for one task.
    """
    place = position(*falling(F.col("final_score")), F.col("input_no"))
    placed = rank_all(rows, keys, place, [F.col("final_score").desc_nulls_last(), F.col("input_no")], hot, out)
    if n is None:
        return placed
    return placed.where((F.col(out) <= n) | (F.lit(False) if always is None else F.coalesce(always, F.lit(False))))


def vendor_options(rows: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Running option number of each vendor's quotes in score order and the display name.

    ``hot`` lists (keys, vendor_name) sets too large for one task.
    """
    group = [*keys, "vendor_name"]
    place = position(*falling(F.col("final_score")), F.col("input_no"))
    numbered = rank_all(rows, group, place, [F.col("final_score").desc_nulls_last(), F.col("input_no")], hot, "option_no")
    counts = rows.groupBy(*group).agg(F.count("*").alias("option_count"))
    return numbered.join(counts, group).withColumn(
        "display_name",
        F.when(F.col("option_count") > 1, F.concat("vendor_name", F.lit(" "), F.col("option_no").cast("string"), F.lit("안")))
        .otherwise(F.col("vendor_name")),
    )


def apply_overrides(cells: DataFrame, overrides: DataFrame) -> DataFrame:
    """Lay manual cell values over (supplier_id, row_label); an override clears status and highlight."""
    o = overrides.select("supplier_id", "row_label", F.col("value").alias("_new"), F.lit(True).alias("_set"))
    hit = F.coalesce("_set", F.lit(False))
    return (
        cells.join(o, ["supplier_id", "row_label"], "left")
        .withColumn("value", F.when(hit, F.col("_new")).otherwise(F.col("value")))
        .withColumn("status", F.when(~hit, F.col("status")))
        .withColumn("highlight", F.when(~hit, F.col("highlight")))
        .drop("_new", "_set")
    )


def visible_rows(cells: DataFrame) -> DataFrame:
    """Drop comparison rows whose cells are all missing; the notes row always stays."""
    shown = (
        cells.groupBy("project_id", "row_label")
        .agg(F.bool_or(~F.coalesce(F.col("status") == "missing", F.lit(False))).alias("_any"))
        .where(F.col("_any") | (F.col("row_label") == "특이사항"))
    )
    return cells.join(shown.select("project_id", "row_label"), ["project_id", "row_label"], "left_semi")


def bucket_cells(breakdown: DataFrame) -> DataFrame:
    """Unpivot the cost buckets into comparison cells."""
    labels = {
        "display_hw": "디스플레이 H/W", "system_equipment": "시스템 장비", "installation": "설치 공사비",
        "materials": "자재비(케이블·브라켓 등)", "travel_expense": "출장비", "etc": "기타",
        "software": "소프트웨어", "content": "콘텐츠",
    }
    entries = F.array(*[
        F.struct(
            F.lit(labels[b]).alias("row_label"),
            F.col(f"{b}_amount").cast("string").alias("value"),
            F.col(f"{b}_status").alias("status"),
            F.lit(None).cast("string").alias("highlight"),
        )
        for b in v.BUCKETS
    ])
    return breakdown.select("project_id", F.col("quote_id").alias("supplier_id"), F.explode(entries).alias("c")).select(
        "project_id", "supplier_id", "c.*"
    )
