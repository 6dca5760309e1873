"""Quote scoring and ranking inside each project (and product group)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import vocab as v
from quotelake.functions.expr import clamp, contains_any, group1, lookup, messages, round2, strip
from quotelake.functions.names import normalize_company
from quotelake.functions.vector import cosine, norm, similarity_score
from quotelake.operators.scale import best_per_group, falling, position, rank_all, running_before, top_per_group

# ---------------------------------------------------------------- column expressions


def comparable_price() -> Column:
    """Quoted supply price when positive, else the sum of the priced, non-optional lines."""
    return F.when(F.col("total_supply_price") > 0, F.col("total_supply_price")).otherwise(F.col("priced_sum"))


def required_weeks(schedule: Column) -> Column:
    text = F.replace(schedule, F.lit(" "), F.lit(""))
    weeks = group1(text, r"(\d+(?:\.\d+)?)주").cast("double")
    months = group1(text, r"(\d+(?:\.\d+)?)개월").cast("double")
    value = F.coalesce(F.rint(weeks), F.rint(months * 4)).cast("int")
    return F.when(value.isNotNull(), F.greatest(F.lit(1), value))


def required_warranty(raw_text: Column, keywords: Column) -> Column:
    """Warranty months the request insists on, NULL when it names none."""
    text = F.concat_ws(" ", F.coalesce(raw_text, F.lit("")), F.array_join(keywords, " "))
    years = F.coalesce(
        group1(text, r"보증\s*(\d+)\s*년\s*이상|(\d+)\s*년\s*이상\s*보증", 1),
        group1(text, r"보증\s*(\d+)\s*년\s*이상|(\d+)\s*년\s*이상\s*보증", 2),
    )
    months = F.coalesce(
        group1(text, r"보증\s*(\d+)\s*개월\s*이상|(\d+)\s*개월\s*이상\s*보증", 1),
        group1(text, r"보증\s*(\d+)\s*개월\s*이상|(\d+)\s*개월\s*이상\s*보증", 2),
    )
    asked = contains_any(text, ["보증", "무상보증", "A/S"])
    return F.when(asked, F.coalesce(years.cast("int") * 12, months.cast("int")))


def spec_score() -> Column:
    return F.when(F.col("cosine").isNull(), F.lit(50.0)).otherwise(clamp(similarity_score(F.col("cosine"))))


def price_score() -> Column:
    price, low = F.col("price"), F.col("lowest_price")
    base = low / price * 100.0
    over = F.coalesce(price > F.col("budget_max"), F.lit(False))
    return F.when(price_known(), clamp(base - F.when(over, 10.0).otherwise(0.0))).otherwise(50.0)


def price_known() -> Column:
    return F.coalesce((F.col("price") > 0) & F.col("lowest_price").isNotNull(), F.lit(False))


def schedule_given() -> Column:
    return F.coalesce(F.length("install_schedule_text") > 0, F.lit(False))


def delivery_discussed() -> Column:
    return strip(F.coalesce("delivery_basis_raw", F.lit(""))) == "별도협의"


def delivery_score() -> Column:
    return (
        F.when(~schedule_given(), 100.0)
        .when(F.col("required_weeks").isNull(), 70.0)
        .when(delivery_discussed(), 70.0)
        .when(F.col("delivery_weeks").isNull(), 50.0)
        .when(F.col("delivery_weeks") <= F.col("required_weeks"), 100.0)
        .otherwise(clamp(F.col("required_weeks") / F.col("delivery_weeks") * 100.0))
    )


def warranty_score() -> Column:
    return (
        F.when(F.col("warranty_months").isNull(), 50.0)
        .when(F.col("warranty_months") >= F.col("target_months"), 100.0)
        .otherwise(clamp(F.col("warranty_months") / F.col("target_months") * 100.0))
    )


def install_conflict() -> Column:
    compact = F.regexp_replace(F.coalesce("notes_raw", F.lit("")), r"(?U)[\s|]+", "")
    return F.col("has_install") & contains_any(compact, v.INSTALL_CONFLICT_TOKENS)


def install_separate() -> Column:
    return contains_any(F.coalesce("notes_raw", F.lit("")), ["설치비 별도", "시공비 별도"])


def installation_score() -> Column:
    return (
        F.when(install_conflict(), 100.0)
        .when(install_separate(), 0.0)
        .when(F.col("has_install"), 100.0)
        .otherwise(0.0)
    )


def speed_ordinal(value: Column) -> Column:
    return F.coalesce(lookup(F.lower(value), {**v.SPEED_ORDINAL, **v.SPEED_KOREAN}), F.lit(0))


def finance_ordinal(value: Column) -> Column:
    return F.coalesce(lookup(F.lower(value), {**v.FINANCE_ORDINAL, **v.FINANCE_KOREAN}), F.lit(0))


def check_messages() -> Column:
    """Points to be checked by a person, in scoring order."""
    late = schedule_given() & F.col("required_weeks").isNotNull()
    notes = F.coalesce("notes_raw", F.lit(""))
    no_req = ~F.col("has_req_vec")
    no_quote = F.col("has_req_vec") & ~F.col("has_quote_vec")
    return messages(
        (no_req, v.MSG_NO_REQUEST_VECTOR),
        (no_quote, v.MSG_NO_QUOTE_VECTOR),
        (F.col("has_req_vec") & F.col("has_quote_vec") & F.col("cosine").isNull(), v.MSG_SPEC_FAILED),
        (~price_known(), v.MSG_NO_PRICE),
        (price_known() & (F.col("price") > F.col("budget_max")), v.MSG_OVER_BUDGET),
        (schedule_given() & F.col("required_weeks").isNull(), v.MSG_SCHEDULE_UNCLEAR),
        (late & delivery_discussed(), v.MSG_DELIVERY_TALK),
        (late & ~delivery_discussed() & F.col("delivery_weeks").isNull(), v.MSG_NO_DELIVERY),
        (F.col("warranty_months").isNull(), v.MSG_NO_WARRANTY),
        (install_conflict(), v.MSG_INSTALL_CONFLICT),
        (~install_conflict() & install_separate(), v.MSG_INSTALL_SEPARATE),
        (
            ~install_conflict() & ~install_separate() & ~F.col("has_install")
            & contains_any(notes, ["설치", "시공"]),
            v.MSG_INSTALL_UNCLEAR,
        ),
    )


# ---------------------------------------------------------------- table operators


def partner_index(partners: DataFrame) -> DataFrame:
    """Partner master keyed by normalized name; the last of several equal names wins."""
    return (
        partners.withColumn("partner_key", normalize_company(F.col("name")))
        .groupBy("partner_key")
        .agg(F.max_by(F.struct(*partners.columns), F.col("supp_key")).alias("partner"))
    )


def attach_partner(quotes: DataFrame, partners: DataFrame, small: bool = False) -> DataFrame:
    """Left join of the partner master (broadcast if ``small``) on the normalized vendor name, with a found flag."""
    keyed = quotes.withColumn("partner_key", normalize_company(F.col("vendor_name")))
    index = partner_index(partners)
    return keyed.join(F.broadcast(index) if small else index, "partner_key", "left").withColumn(
        "partner_found", F.col("partner").isNotNull()
    )


def lowest_prices(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest positive comparable price per competing set (partial minimum before the shuffle)."""
    return (
        quotes.withColumn("price", comparable_price())
        .where(F.col("price") > 0)
        .groupBy(*keys)
        .agg(F.min("price").alias("lowest_price"))
    )


#: Bytes of vectors, each counted with 32 more for its row, that are few enough for a broadcast.
FEW_VECTOR_BYTES = 64 << 20


def few_vectors(vectors: DataFrame, limit: int = FEW_VECTOR_BYTES) -> bool:
    """Whether the vectors fit a broadcast; one small job over their sizes."""
    width = 4 if dict(vectors.dtypes)["vec"] == "array<float>" else 8
    return vectors.agg(F.coalesce(F.sum(F.coalesce(F.size("vec"), F.lit(0)) * width + 32), F.lit(0))).first()[0] <= limit


def compare_inputs(
    quotes: DataFrame, requirements: DataFrame, vectors: DataFrame, partners: DataFrame, small: bool = False,
    few_partners: bool = False,
) -> DataFrame:
    """Every quote with the cosine to its request, the request's limits and the facts of its partner.

    Vectors travel in the type they are stored in; ``small`` ones are broadcast, so that no quote moves with a vector.
    ``few_partners`` are broadcast too.
    """
    normed = vectors.select("vec_id", "vec", norm(F.col("vec").cast("array<double>")).alias("n"))
    near = F.broadcast if small else lambda side: side
    qv = near(normed.select(F.col("vec_id"), F.col("vec").alias("quote_vec"), F.col("n").alias("qn")))
    rv = near(normed.select(F.col("vec_id").alias("req_vec_id"), F.col("vec").alias("req_vec"), F.col("n").alias("rn")))
    reqs = requirements.select(
        "project_id", "budget_max", "install_schedule_text",
        required_weeks(F.col("install_schedule_text")).alias("required_weeks"),
        F.coalesce(required_warranty(F.col("raw_text"), F.col("required_keywords")), F.lit(12)).alias("target_months"),
        F.col("vec_id").alias("req_vec_id"),
    )
    with_request = quotes.join(reqs, "project_id").join(rv, "req_vec_id", "left") if small else quotes.join(
        reqs.join(rv, "req_vec_id", "left"), "project_id")
    # the two vectors end here: only the cosine goes through the joins below
    double = lambda name: F.col(name).cast("array<double>")
    compared = (
        with_request.join(qv, "vec_id", "left")
        .withColumn("cosine", cosine(double("req_vec"), double("quote_vec"), F.col("rn"), F.col("qn")))
        .withColumn("has_req_vec", F.col("req_vec").isNotNull())
        .withColumn("has_quote_vec", F.col("quote_vec").isNotNull())
        .drop("quote_vec", "req_vec", "qn", "rn")
    )
    facts = partners.select(
        "name", "supp_key", "is_premium", "success_rate", "response_speed", "financial_status", "is_excluded")
    return attach_partner(compared, facts, few_partners)


def score_quotes(
    quotes: DataFrame,
    requirements: DataFrame,
    vectors: DataFrame,
    partners: DataFrame,
    keys: list[str] | None = None,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """All score parts, the weighted score and the messages of every quote.

    ``keys`` is the competing set: ``[project_id]`` or ``[project_id, product_group]``.
    """
    keys = keys or ["project_id"]
    compared = compare_inputs(quotes, requirements, vectors, partners)
    return score_compared(compared.join(lowest_prices(quotes, keys), keys, "left"), weights)


def score_compared(compared: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The scores of rows of :func:`compare_inputs` with the ``lowest_price`` of their competing set; a narrow pass."""
    wt = weights or v.QUOTE_WEIGHTS
    scored = (
        compared.withColumn("price", comparable_price())
        .withColumn("_spec", spec_score())
        .withColumn("_price", price_score())
        .withColumn("_delivery", delivery_score())
        .withColumn("_warranty", warranty_score())
        .withColumn("_install", installation_score())
        .withColumn("check_required", check_messages())
        .withColumn(
            "final_score",
            round2(clamp(
                F.col("_spec") * wt["spec"] + F.col("_price") * wt["price"] + F.col("_delivery") * wt["delivery"]
                + F.col("_warranty") * wt["warranty"] + F.col("_install") * wt["installation"]
            )),
        )
        .withColumn("spec_score", round2(F.col("_spec")))
        .withColumn("price_score", round2(F.col("_price")))
        .withColumn("delivery_score", round2(F.col("_delivery")))
        .withColumn("warranty_score", round2(F.col("_warranty")))
        .withColumn("installation_score", round2(F.col("_install")))
        .withColumn("is_premium", F.coalesce("partner.is_premium", F.lit(False)))
        .withColumn("success_rate", F.coalesce("partner.success_rate", F.lit(0.0)))
        .withColumn("speed_ordinal", speed_ordinal(F.col("partner.response_speed")))
        .withColumn("finance_ordinal", finance_ordinal(F.col("partner.financial_status")))
        .withColumn("is_excluded", F.coalesce("partner.is_excluded", F.lit(False)))
        .withColumn("business_rule_passed", F.lit(True))
    )
    gap = (F.col("price") - F.col("lowest_price")) / F.col("lowest_price")
    wide_gap = F.coalesce((F.col("price") != 0) & (gap > 0.05), F.lit(False))
    return (
        scored.withColumn("price_gap_rate", F.when(F.col("price") != 0, gap))
        .withColumn("comparison_risks", messages((wide_gap, v.MSG_PRICE_GAP_RISK)))
        .withColumn(
            "rule_warnings",
            messages(
                (~F.col("partner_found"), v.MSG_PARTNER_UNKNOWN),
                (F.col("is_excluded"), v.MSG_PARTNER_EXCLUDED_QUOTE),
                (wide_gap, v.MSG_PRICE_GAP_RULE),
            ),
        )
        .withColumn(
            "matched_rules",
            messages(
                (F.col("is_premium"), "premium_partner"),
                (F.col("success_rate") >= 0.10, "high_success_rate"),
                (F.lower("partner.response_speed") == "fast", "fast_response"),
            ),
        )
        .drop("_spec", "_price", "_delivery", "_warranty", "_install", "has_req_vec", "has_quote_vec", "partner")
    )


def business_order() -> list[Column]:
    """Eight descending keys; equal quotes keep their input order."""
    return [
        F.col("business_rule_passed").desc(), F.col("final_score").desc(), F.col("price_score").desc(),
        F.col("spec_score").desc(), F.col("is_premium").desc(), F.col("success_rate").desc(),
        F.col("speed_ordinal").desc(), F.col("finance_ordinal").desc(), F.col("input_no").asc(),
    ]


def business_place() -> list[Column]:
    """The same order as parts of an ascending position."""
    names = ("business_rule_passed", "final_score", "price_score", "spec_score", "is_premium", "success_rate", "speed_ordinal", "finance_ordinal")
    kinds = {"business_rule_passed": "int", "is_premium": "int"}
    return [part for n in names for part in falling(F.col(n), kinds.get(n, "double"))] + [F.col("input_no")]


def top_quotes(scored: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    return top_per_group(scored.where(F.col("business_rule_passed")), keys, business_order(), n)


def rank_quotes(scored: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Rank of every quote in its competing set; hot sets are cut by the whole order."""
    return rank_all(scored, keys, position(*business_place()), business_order(), hot)


def selected_partner_filter(quotes: DataFrame, selected: DataFrame, enabled: bool = True) -> DataFrame:
    """Keep quotes of the selected partners; a project where none matches keeps all.

    ``selected`` has (project_id, partner_name).
    """
    if not enabled:
        return quotes
    keyed = quotes.withColumn("partner_key", normalize_company(F.col("vendor_name")))
    names = selected.select(
        "project_id", normalize_company(F.col("partner_name")).alias("partner_key")
    ).where(F.col("partner_key") != "").distinct()
    matched = keyed.join(names, ["project_id", "partner_key"], "left_semi")
    projects_hit = matched.select("project_id").distinct()
    untouched = keyed.join(projects_hit, "project_id", "left_anti")
    return matched.unionByName(untouched).drop("partner_key")


def rank_score_conflicts(ranked: DataFrame, keys: list[str], epsilon: float = v.SCORE_TIE_EPSILON) -> DataFrame:
    """Rows whose rank contradicts their score, each with the row it was compared with.

    A later rank that beats the best score so far by more than ``epsilon`` flags both
    rows; every row keeps its first finding only.
    """
    group = [*keys, "business_rule_passed"]
    known = ranked.where(F.col("final_score").isNotNull() & F.col("rank").isNotNull())
    # best so far: highest score, earliest rank on a tie
    best = F.struct(F.col("final_score").alias("score"), (-F.col("rank")).alias("neg_rank"), F.col("quote_id").alias("quote_id"))
    seen = running_before(known, group, "rank", F.max, best, "prev")
    later = seen.where(F.col("final_score") > F.col("prev.score") + epsilon).select(
        *group, "quote_id", "rank", "final_score",
        F.col("prev.quote_id").alias("compared_quote_id"),
        (-F.col("prev.neg_rank")).alias("compared_rank"),
        F.col("prev.score").alias("compared_final_score"),
        F.lit(0).alias("_role"),
    )
    earlier = later.select(
        *group,
        F.col("compared_quote_id").alias("quote_id"), F.col("compared_rank").alias("rank"),
        F.col("compared_final_score").alias("final_score"),
        F.col("quote_id").alias("compared_quote_id"), F.col("rank").alias("compared_rank"),
        F.col("final_score").alias("compared_final_score"),
        F.lit(1).alias("_role"),
    )
    first = best_per_group(
        later.unionByName(earlier), [*group, "quote_id"], [F.col("_role"), F.col("compared_rank")]
    )
    return first.drop("_role").withColumn("message", F.lit(v.MSG_RANK_MISMATCH))


def run_counters(valid: DataFrame, scope: DataFrame) -> DataFrame:
    """Candidate, failed and filtered counts per project."""
    good = valid.groupBy("project_id").agg(
        F.count_if(F.col("failure_reason").isNull()).alias("candidate_count"),
        F.count_if(F.col("failure_reason").isNotNull()).alias("failed_candidate_count"),
    )
    dropped = scope.groupBy("project_id").agg(F.count_if(~F.col("included")).alias("filtered_candidate_count"))
    return good.join(dropped, "project_id", "left").fillna(0, ["filtered_candidate_count"])
