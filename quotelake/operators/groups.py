"""Product groups: which group a quote competes in, and which groups a project compares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import vocab as v
from quotelake.functions.groups import canonical_group, distinct_canonical, group_order_key, primary_group


def line_groups(lines: DataFrame) -> DataFrame:
    """Distinct product groups over the lines of each quote.

    ``collect_set`` holds at most one entry per known group, so it stays tiny for any quote.
    """
    named = lines.select("quote_id", F.explode(F.array("name", "spec_raw")).alias("t")).select(
        "quote_id", canonical_group(F.col("t")).alias("g")
    )
    return named.groupBy("quote_id").agg(F.array_sort(F.collect_set("g")).alias("product_groups"))


def quote_groups(quotes: DataFrame, lines: DataFrame, direct: Column | None = None) -> DataFrame:
    """``product_groups`` of every quote: a stated group wins, else project name and lines decide."""
    from_lines = line_groups(lines)
    joined = quotes.join(from_lines, "quote_id", "left")
    name = F.array_compact(F.array(canonical_group(F.col("project_name"))))
    merged = F.array_sort(
        F.array_union(F.coalesce("product_groups", F.array().cast("array<string>")), name)
    )
    if direct is None:
        return joined.withColumn("product_groups", merged)
    stated = distinct_canonical(direct, lambda t: canonical_group(t, include_generic=False))
    return joined.withColumn("product_groups", F.when(F.size(stated) > 0, stated).otherwise(merged))


def requirement_groups(reqs: DataFrame, columns: list[str], array_columns: list[str]) -> DataFrame:
    values = F.concat(F.array(*[F.col(c) for c in columns]), *[F.col(c) for c in array_columns])
    return reqs.withColumn("requirement_groups", distinct_canonical(values, canonical_group))


def dominant_group(grouped: DataFrame) -> DataFrame:
    """Per project: the group most quotes name, or a request for a manual selection."""
    counts = (
        grouped.select("project_id", F.explode("product_groups").alias("product_group"))
        .groupBy("project_id", "product_group").count()
    )
    # one row per known group and project from here on
    top = (
        counts.groupBy("project_id")
        .agg(
            F.sum("count").alias("known"),
            F.reverse(F.array_sort(F.collect_list(F.struct("count", "product_group")))).alias("by_count"),
        )
    )
    first, second = F.get("by_count", F.lit(0)), F.get("by_count", F.lit(1))
    lead = first["count"] > F.coalesce(second["count"], F.lit(0))
    chosen = lead & ((first["count"] >= 2) | (first["count"] / F.col("known") >= 0.6))
    decided = top.select(
        "project_id",
        F.when(chosen, first["product_group"]).alias("selected_group"),
        first["count"].alias("top_count"),
        "known",
    )
    projects = grouped.select("project_id").distinct()
    return projects.join(decided, "project_id", "left").select(
        "project_id",
        "selected_group",
        F.coalesce("top_count", F.lit(0)).alias("top_count"),
        F.coalesce("known", F.lit(0)).alias("known_count"),
        F.col("selected_group").isNull().alias("selection_required"),
        F.when(F.col("known").isNull(), v.MSG_GROUP_UNKNOWN)
        .when(F.col("selected_group").isNull(), v.MSG_GROUP_UNDECIDED)
        .alias("reason"),
    )


def product_group_scope(grouped: DataFrame, reqs: DataFrame, is_split: Column | None = None) -> DataFrame:
    """Flag the quotes that take part in the comparison, with the reason for each exclusion.

    Quotes without a recognised group stay in; a project where nothing matches keeps all.
    """
    split = F.coalesce(is_split, F.lit(False)) if is_split is not None else F.lit(False)
    chosen = reqs.select("project_id", "requirement_groups").join(
        dominant_group(grouped).select("project_id", "selected_group"), "project_id", "left"
    )
    by_request = F.size("requirement_groups") > 0
    selected = F.when(by_request, F.col("requirement_groups")).otherwise(F.array_compact(F.array("selected_group")))
    scope = chosen.select(
        "project_id",
        selected.alias("selected_groups"),
        F.when(by_request, "requirement")
        .when(F.col("selected_group").isNotNull(), "quote_pool_dominant_group")
        .otherwise("quote_pool_ambiguous")
        .alias("source"),
    )
    flagged = grouped.join(scope, "project_id").withColumn("_split", split).withColumn(
        "_match",
        (F.size("selected_groups") == 0)
        | (F.size("product_groups") == 0)
        | F.arrays_overlap("product_groups", "selected_groups"),
    )
    any_match = flagged.groupBy("project_id").agg(F.bool_or("_match").alias("_any"))
    reason = (
        F.when(F.col("source") == "requirement", v.MSG_SCOPE_REQUEST)
        .when(F.col("_split"), v.MSG_SCOPE_SPLIT)
        .otherwise(v.MSG_SCOPE_OTHER_QUOTES)
    )
    return (
        flagged.join(any_match, "project_id")
        .withColumn("fallback_used", ~F.col("_any"))
        .withColumn("included", F.col("_match") | ~F.col("_any"))
        .withColumn("uncertain", F.col("included") & (F.size("product_groups") == 0) & (F.size("selected_groups") > 0))
        .withColumn("exclusion_reason", F.when(~F.col("included"), reason))
        .drop("_match", "_any", "_split")
    )


def drop_split_parents(quotes: DataFrame) -> DataFrame:
    """Remove quotes that live on as option children (parent_quote_id of another row)."""
    parents = quotes.where(F.col("parent_quote_id").isNotNull()).select(
        F.col("parent_quote_id").alias("quote_id")
    ).distinct()
    children = quotes.where(F.col("parent_quote_id").isNotNull())
    roots = quotes.where(F.col("parent_quote_id").isNull()).join(parents, "quote_id", "left_anti")
    return roots.unionByName(children)


def competing_groups(grouped: DataFrame, is_split_child: Column | None = None) -> DataFrame:
    """One row per (quote, product group) it competes in; several groups collapse to the primary
    one except for option children."""
    child = F.coalesce(is_split_child, F.lit(False)) if is_split_child is not None else F.lit(False)
    groups = (
        F.when(F.size("product_groups") == 0, F.array(F.lit(v.UNCATEGORIZED_GROUP)))
        .when((F.size("product_groups") > 1) & ~child, F.array(primary_group(F.col("product_groups"))))
        .otherwise(F.col("product_groups"))
    )
    return grouped.withColumn("product_group", F.explode(groups)).withColumn(
        "group_order", group_order_key(F.col("product_group"))
    )


def group_counts(competing: DataFrame) -> DataFrame:
    """Quotes per project and product group, with project and grand totals."""
    return (
        competing.rollup("project_id", "product_group")
        .agg(F.count("*").alias("quote_count"), F.grouping_id().cast("int").alias("level"))
    )
