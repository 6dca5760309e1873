"""Amount, delivery and line checks, issue lists and quality summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import vocab as v
from quotelake.functions.durations import delivery_line, weeks_from_text
from quotelake.functions.expr import contains_any, messages, strip

# --------------------------------------------------------------------- amounts


def _money(amount: Column) -> Column:
    return F.format_number(amount, 0)


def _whole(value: Column) -> Column:
    """Truncate towards zero."""
    return value.cast("bigint")


def amount_validation(quotes: DataFrame) -> DataFrame:
    """Cross-check supply, tax, total and the line sum of every quote.

    Expects total_supply_price, tax_amount, total_with_vat and line_sum.
    """
    supply, tax, total = F.col("total_supply_price"), F.col("tax_amount"), F.col("total_with_vat")
    line_sum = F.nullif(F.col("line_sum"), F.lit(0).cast("bigint"))
    base = (
        quotes.withColumn("calculated_total_with_vat", supply + tax)
        .withColumn("difference", total - F.col("calculated_total_with_vat"))
        .withColumn("expected_tax_amount", F.rint(supply * 0.1).cast("bigint"))
        .withColumn("tax_difference", tax - F.col("expected_tax_amount"))
        .withColumn("line_items_sum", line_sum)
        .withColumn("line_items_difference", supply - F.col("line_items_sum"))
    )
    gap = F.abs("difference")
    zero = F.lit(0)
    tax_ok = F.coalesce(F.col("tax_difference"), zero) == 0
    lines_ok = F.coalesce(F.col("line_items_difference"), zero) == 0
    relative = F.when(total != 0, gap / total).otherwise(1.0)
    small = (gap <= 50000) | (tax_ok & lines_ok & ((gap <= 100000) | (relative <= 0.005)))
    unknown = total.isNull() | tax.isNull()
    off = F.coalesce(F.col("difference") != 0, F.lit(True))
    tax_bad = F.abs(F.coalesce("tax_difference", zero)) > F.greatest(
        F.lit(10000), _whole(F.coalesce("expected_tax_amount", zero) * 0.02)
    )
    lines_bad = F.abs(F.coalesce("line_items_difference", zero)) > F.greatest(
        F.lit(10000), _whole(F.coalesce(supply, zero) * 0.03)
    )
    first = (
        F.when(unknown, "not_enough_data")
        .when(~off, "normal")
        .when(small, "rounding_or_adjustment_possible")
        .otherwise("amount_mismatch")
    )
    status = F.when((first == "normal") & (tax_bad | lines_bad), "amount_mismatch").otherwise(first)
    notes = messages(
        (
            ~unknown & off & small,
            F.concat(F.lit("공급가+VAT와 견적서 총액이 "), _money(gap), F.lit("원 차이납니다. 만원 단위 절사 또는 조정금액 가능성 확인 필요")),
        ),
        (
            ~unknown & off & ~small,
            F.concat(F.lit("공급가+VAT와 견적서 총액이 "), _money(gap), F.lit("원 차이납니다. 금액 확인 필요")),
        ),
        (
            tax_bad,
            F.concat(F.lit("VAT가 공급가의 10%와 "), _money(F.abs("tax_difference")), F.lit("원 차이납니다. VAT 확인 필요")),
        ),
        (lines_bad, v.MSG_LINES_MISMATCH),
    )
    return base.withColumn("validation_status", status).withColumn(
        "amount_message", F.nullif(F.array_join(F.array_distinct(notes), " / "), F.lit(""))
    )


def line_arithmetic(lines: DataFrame) -> DataFrame:
    """Lines whose amount is not quantity × unit price. A narrow filter, no shuffle."""
    known = F.col("unit_price").isNotNull() & F.col("total_price").isNotNull() & (F.col("quantity") != 0)
    return (
        lines.where(known)
        .withColumn("calculated_amount", F.rint(F.col("quantity") * F.col("unit_price")).cast("bigint"))
        .withColumn("difference", F.col("total_price") - F.col("calculated_amount"))
        .where(F.col("difference") != 0)
    )


def reconcile_line_sum(quotes: DataFrame) -> DataFrame:
    """Residual to append when lines fall short of the supply price, or the supply lowered to the line sum."""
    supply = F.coalesce("total_supply_price", F.col("total_with_vat") - F.col("tax_amount"), "total_with_vat", F.lit(0))
    base = quotes.withColumn("supply", supply)
    diff = F.col("supply") - F.col("line_sum")
    tolerance = F.greatest(F.lit(10000), _whole(F.col("supply") * 0.03))
    apply = F.coalesce((F.col("supply") != 0) & (F.col("line_sum") != 0) & (F.abs(diff) > tolerance), F.lit(False))
    empty = F.col("line_sum").isNull() & (F.col("supply") > 0)
    fixed = base.withColumn(
        "residual_amount", F.when(apply & (diff > 0), diff).when(empty, F.col("supply"))
    ).withColumn("reconciled_supply", F.when(apply & (diff < 0), F.col("line_sum")).otherwise(F.col("supply")))
    expected = F.rint(F.col("reconciled_supply") * 1.1).cast("bigint")
    total = F.col("total_with_vat")
    implausible = total.isNull() | (total <= F.col("reconciled_supply")) | (
        F.abs(total - expected) > F.greatest(F.lit(50000), _whole(F.col("reconciled_supply") * 0.02))
    )
    return fixed.withColumn(
        "reconciled_total", F.when((F.col("reconciled_supply") > 0) & implausible, expected).otherwise(total)
    )


def residual_lines(reconciled: DataFrame, display_text: Column) -> DataFrame:
    """One synthetic line per quote that has a residual."""
    is_display = contains_any(F.lower(display_text), ["led", "전광판", "비디오월", "display", "screen", "디스플레이"])
    return reconciled.where(F.col("residual_amount").isNotNull()).select(
        "quote_id",
        F.when(is_display, "Display hardware").otherwise("견적 품목").alias("name"),
        F.when(is_display, "DISPLAY").otherwise("ETC").alias("category"),
        F.lit(1.0).alias("quantity"),
        F.col("residual_amount").alias("unit_price"),
        F.col("residual_amount").alias("total_price"),
        F.lit(True).alias("reconciliation_residual"),
    )


# --------------------------------------------------------------------- delivery


def delivery_validation(quotes: DataFrame) -> DataFrame:
    basis = strip(F.coalesce("delivery_basis_raw", F.lit("")))
    base = quotes.withColumn("_basis", basis).withColumn(
        "delivery_raw",
        F.nullif(F.when(F.col("_basis") != "", F.col("_basis")).otherwise(delivery_line(F.col("notes_raw"))), F.lit("")),
    )
    raw = F.col("delivery_raw")
    source = F.when(F.col("_basis") != "", "delivery_basis_raw").when(raw.isNotNull(), "notes_raw")
    weeks = weeks_from_text(raw)
    talk = F.coalesce(raw.rlike(v.DELIVERY_DISCUSSION_PATTERN), F.lit(False))
    status = (
        F.when(talk, "discussion_required")
        .when(raw.isNull(), "missing")
        .when(weeks.isNull(), "needs_review")
        .when(~F.col("delivery_weeks").eqNullSafe(weeks), "normalized")
        .otherwise("normal")
    )
    return (
        base.withColumn("delivery_source", source)
        .withColumn("normalized_delivery_weeks", weeks)
        .withColumn("delivery_status", status)
        .withColumn(
            "delivery_message",
            F.when(talk, v.MSG_DELIVERY_TALK)
            .when(raw.isNull(), v.MSG_DELIVERY_MISSING)
            .when(weeks.isNull(), v.MSG_DELIVERY_REVIEW),
        )
        .drop("_basis")
    )


def apply_delivery(validated: DataFrame) -> DataFrame:
    """Overwrite the stored weeks where the text decides them."""
    status = F.col("delivery_status")
    return validated.withColumn(
        "delivery_weeks",
        F.when(status.isin("normal", "normalized"), F.col("normalized_delivery_weeks"))
        .when(status == "discussion_required", F.lit(None))
        .otherwise(F.col("delivery_weeks")),
    ).withColumn("delivery_basis_raw", F.coalesce(F.nullif(F.col("delivery_basis_raw"), F.lit("")), "delivery_raw"))


# ------------------------------------------------------------------------ issues


def name_spec_unsplit(name: Column) -> Column:
    return (F.length(strip(name)) >= 50) & name.rlike(v.SPEC_KEYWORD_PATTERN)


def _noisy(text: Column) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), ["quotation", "quote", "estimate", "no."])


def line_flags(lines: DataFrame) -> DataFrame:
    """Per-quote booleans over the lines, reduced map-side.

    Expects name, spec_raw, quantity, unit_price, total_price, category, cost_type and
    spec_parsed (map of strings).
    """
    spec = F.lower(F.coalesce("spec_raw", F.lit("")))
    text = F.lower(F.concat_ws(" ", "name", "spec_raw"))
    display = F.col("category") == "DISPLAY"
    has = lambda *keys: F.coalesce(*[F.col("spec_parsed")[k] for k in keys]).isNotNull()
    priced = (F.col("quantity") != 0) & F.col("unit_price").isNotNull() & F.col("total_price").isNotNull()
    flags = {
        "line_item_name_spec_not_separated": name_spec_unsplit(F.col("name"))
        | ((spec == "") & (F.length("name") > 30)),
        "row_number_used_as_quantity": F.col("quantity").isin(2.0, 3.0, 4.0)
        & contains_any(text, ["vx400pro", "controller", "player", "processor", "all-in-one"]),
        "_swapped": priced & (F.col("quantity") == 1) & (F.col("unit_price") == F.col("total_price"))
        & (F.col("total_price") >= 1000000),
        "line_item_amount_missing": F.col("total_price").isNull(),
        "_total_mismatch": priced
        & (F.abs(_whole(F.col("quantity") * F.col("unit_price")) - F.col("total_price")) > 10000),
        "display_screen_size_missing": display & ~has("screen_size_mm", "full_screen_size_mm")
        & contains_any(spec, ["화면", "screen", "display size", "전체 크기"]),
        "display_resolution_missing": display & ~has("resolution", "resolution_type") & spec.contains("해상도"),
        "display_brightness_missing": display & ~has("brightness_cd_m2", "brightness_nit")
        & contains_any(spec, ["밝기", "nit", "cd"]),
        "display_pixel_pitch_missing": display & ~has("pixel_pitch_mm", "pitch_mm") & spec.contains("pitch"),
        "display_power_consumption_missing": display & ~has("power_consumption_kw", "power_consumption_w")
        & contains_any(spec, ["최대전력", "최대소비전력", "전기용량"]),
        "display_refresh_rate_missing": display & ~has("refresh_rate", "refresh_rate_hz") & spec.contains("refresh rate"),
        "line_item_arithmetic_mismatch": priced
        & (F.rint(F.col("quantity") * F.col("unit_price")).cast("bigint") != F.col("total_price")),
        "normalized_cost_type_missing": F.col("cost_type").isNull(),
        "unparsed_residual_present": F.coalesce(F.col("spec_parsed")["reconciliation_residual"] == "true", F.lit(False)),
        "spec_sanitized": F.col("spec_parsed")["spec_sanitization"].isNotNull(),
    }
    return lines.groupBy("quote_id").agg(
        *[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()],
        F.count("*").alias("line_item_count"),
    )


def quote_issues(quotes: DataFrame, flags: DataFrame) -> DataFrame:
    """Ordered list of issue names per quote.

    ``quotes`` must already carry the amount and delivery validation columns plus
    partner_found, project_name, project_name_source and received_at.
    """
    joined = quotes.join(flags, "quote_id", "left")
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    status = F.col("validation_status")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    pairs = [
        (blank("vendor_name"), "vendor_name_missing"),
        (_noisy(F.col("vendor_name")), "vendor_name_noise_included"),
        (~F.col("partner_found"), "vendor_name_partner_not_matched"),
        (blank("project_name"), "project_name_missing"),
        (F.col("project_name_source") == "file_name_fallback", "project_name_fallback_used"),
        (_noisy(F.col("project_name")), "project_name_noise_included"),
        (F.coalesce(F.col("total_supply_price"), F.lit(0)) == 0, "total_supply_price_missing"),
        (F.col("tax_amount").isNull(), "tax_amount_missing"),
        (F.col("total_with_vat").isNull(), "total_with_vat_missing"),
        (status == "amount_mismatch", "amount_mismatch"),
        (status == "rounding_or_adjustment_possible", "amount_rounding_or_adjustment"),
        (F.coalesce("line_items_difference", F.lit(0)) != 0, "line_items_sum_mismatch"),
        (F.coalesce("tax_difference", F.lit(0)) != 0, "tax_total_mismatch"),
        (F.coalesce("line_item_count", F.lit(0)) == 0, "line_items_empty"),
        (on("line_item_name_spec_not_separated"), "line_item_name_spec_not_separated"),
        (on("row_number_used_as_quantity"), "row_number_used_as_quantity"),
        (~status.isin("normal", "rounding_or_adjustment_possible") & on("_swapped"), "quantity_unit_price_swapped"),
        (on("line_item_amount_missing"), "line_item_amount_missing"),
        ((status != "normal") & on("_total_mismatch"), "line_item_total_mismatch"),
        (on("display_screen_size_missing"), "display_screen_size_missing"),
        (on("display_resolution_missing"), "display_resolution_missing"),
        (on("display_brightness_missing"), "display_brightness_missing"),
        (on("display_pixel_pitch_missing"), "display_pixel_pitch_missing"),
        (on("display_power_consumption_missing"), "display_power_consumption_missing"),
        (on("display_refresh_rate_missing"), "display_refresh_rate_missing"),
        (on("line_item_arithmetic_mismatch"), "line_item_arithmetic_mismatch"),
        (F.col("delivery_status") == "missing", "delivery_missing"),
        (F.col("delivery_status") == "discussion_required", "delivery_to_be_discussed"),
        (F.col("delivery_status") == "normalized", "delivery_weeks_not_normalized"),
        (F.col("warranty_months").isNull(), "warranty_missing"),
        (
            F.col("warranty_months").isNull()
            & contains_any(F.coalesce("source_text", F.lit("")), ["무상", "보증", "유지보수", "A/S", "AS", "warranty"]),
            "warranty_raw_exists_but_not_parsed",
        ),
        (on("normalized_cost_type_missing"), "normalized_cost_type_missing"),
        (on("unparsed_residual_present"), "unparsed_residual_present"),
        (on("spec_sanitized"), "spec_sanitized"),
        (
            F.col("received_at").isNull() | (F.to_date("received_at") == F.lit("1970-01-01").cast("date")),
            "quote_date_missing",
        ),
    ]
    return joined.withColumn("detected_issues", messages(*pairs))


def check_required(quotes: DataFrame) -> DataFrame:
    """Messages a person has to look at, from the validation columns and line flags."""
    return quotes.withColumn(
        "check_required",
        F.array_distinct(
            messages(
                (F.coalesce("line_item_name_spec_not_separated", F.lit(False)), v.MSG_NAME_SPEC_SPLIT),
                (~F.col("validation_status").isin("normal", "not_enough_data"), F.col("amount_message")),
                (F.coalesce("line_item_arithmetic_mismatch", F.lit(False)), v.MSG_LINE_ARITHMETIC),
                (F.col("delivery_message").isNotNull(), F.col("delivery_message")),
                (F.coalesce("is_multi_option_possible", F.lit(False)), v.MSG_MULTI_OPTION),
            )
        ),
    )


# ----------------------------------------------------------------- quality reports


def issue_top(issues: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent issues; ties by name."""
    return (
        issues.select(F.explode("detected_issues").alias("issue"))
        .groupBy("issue").count()
        .orderBy(F.col("count").desc(), "issue").limit(n)
    )


def quality_summary(issues: DataFrame, lines: DataFrame) -> DataFrame:
    """Coverage counters of an extraction run: one aggregate over quotes, one over lines."""
    present = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    status = lambda s: F.count_if(F.col("validation_status") == s)
    q = issues.agg(
        F.count("*").alias("quote_result_count"),
        present("vendor_name").alias("vendor_name_extracted_count"),
        present("project_name").alias("project_name_extracted_count"),
        F.count_if(
            (F.coalesce("total_with_vat", F.lit(0)) != 0) | (F.coalesce("total_supply_price", F.lit(0)) != 0)
        ).alias("total_amount_extracted_count"),
        present("tax_amount").alias("tax_amount_extracted_count"),
        F.count_if(F.col("received_at").isNotNull()).alias("quote_date_valid_count"),
        F.count_if(F.coalesce("line_item_count", F.lit(0)) > 0).alias("line_items_extracted_count"),
        present("warranty_months").alias("warranty_extracted_count"),
        F.count_if(
            (F.coalesce("delivery_weeks", F.lit(0)) != 0) | (F.coalesce("delivery_basis_raw", F.lit("")) != "")
        ).alias("delivery_extracted_count"),
        status("normal").alias("amount_validation_normal_count"),
        status("rounding_or_adjustment_possible").alias("amount_rounding_or_adjustment_count"),
        status("amount_mismatch").alias("amount_mismatch_count"),
        F.count_if(~F.col("validation_status").isin("normal", "not_enough_data")).alias("remaining_amount_mismatch_count"),
        F.count_if(F.col("partner_found")).alias("partner_matched_count"),
        F.sum(F.size("detected_issues")).cast("bigint").alias("detected_issue_count"),
    )
    display = F.col("category") == "DISPLAY"
    spec = lambda *keys: F.count_if(
        display & F.coalesce(*[F.col("spec_parsed")[k] for k in keys]).isNotNull()
    )
    li = lines.agg(
        F.count_if(F.col("total_price").isNull()).alias("line_item_amount_missing_count"),
        F.count_if(display).alias("display_item_count"),
        F.count_if(display & (F.coalesce("spec_raw", F.lit("")) != "")).alias("display_spec_raw_present_count"),
        spec("screen_size_mm", "full_screen_size_mm").alias("display_screen_size_extracted_count"),
        spec("resolution", "resolution_type").alias("display_resolution_extracted_count"),
        spec("brightness_cd_m2", "brightness_nit").alias("display_brightness_extracted_count"),
        spec("pixel_pitch_mm", "pitch_mm").alias("display_pixel_pitch_extracted_count"),
        spec("power_consumption_kw", "power_consumption_w").alias("display_power_consumption_extracted_count"),
    )
    one = F.lit(1).alias("_one")  # both sides are single rows
    return q.select(one, "*").join(li.select(one, "*"), "_one").drop("_one")


def quality_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per-quote issue counts of two runs, keeping the quotes of the later run."""
    b = before.select("quote_id", F.size("detected_issues").alias("before_issue_count"))
    a = after.select("quote_id", F.size("detected_issues").alias("after_issue_count"))
    joined = a.join(b, "quote_id", "left").withColumn("before_issue_count", F.coalesce("before_issue_count", F.lit(0)))
    return joined.withColumn("delta", F.col("after_issue_count") - F.col("before_issue_count")).withColumn(
        "improved", F.col("delta") < 0
    )
