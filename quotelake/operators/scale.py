"""Ranking and running aggregates that keep their parallelism on hot groups.

A plain ``row_number() over (partition by project ...)`` sends a whole project to
one task. Here a *hot* key (more rows than ``limit``) is cut into ranges of the whole
sort order, down to its last key, by splitters sampled from its own rows, so equal
scores are spread as well; the range sizes are prefix-summed, and every range is
ranked on its own. Keys that are not hot keep a single range, so the common case
pays for one shuffle only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
CHUNK = 10_000
#: Parts into which every group is dealt before its first rows are taken.
PARTS = 16
#: Ranges into which a hot key is cut, about.
RANGES = 256


def falling(value: Column, kind: str = "double") -> list[Column]:
    """Parts of a position that ascends as ``value`` descends, with nulls last."""
    return [value.isNull(), -value.cast(kind)]


def position(*parts: Column) -> Column:
    """A value that compares like the parts in turn; nulls come first."""
    return F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])


def hot_keys(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> DataFrame:
    """(keys, _rows) of the keys with more than ``limit`` rows; at most rows/limit of them, counted map-side first.

    The count runs at once and its few rows come back as a local table: where no key is hot, Spark sees an empty one
    and leaves out the joins with it, and a ranking moves every row once.
    """
    counted = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)
    rows = counted.collect()
    found = df.sparkSession.createDataFrame(rows, counted.schema)
    return found if rows else found.limit(0)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per group with their rank.

    The first ``n`` of every part of a group are taken before the first ``n`` of the group. The parts need a
    partitioning of their own, so that Spark limits rows before both shuffles and may split a join below by skew:
    a hot group never reaches one task whole. A part is that of the rows' task: where a table lies by group, most rows
    end before the first shuffle.
    """
    parted = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    within, w = W.partitionBy(*keys, "_part").orderBy(*order), W.partitionBy(*keys).orderBy(*order)
    some = parted.withColumn(out, F.row_number().over(within)).where(F.col(out) <= n).drop("_part", out)
    return some.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def best_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_best").drop("_best")


def rank_all(
    df: DataFrame,
    keys: list[str],
    place: Column,
    order: list[Column],
    hot: DataFrame,
    out: str = "rank",
    ranges: int = RANGES,
) -> DataFrame:
    """``row_number`` of every row. ``place`` ascends with ``order`` and tells all rows of a key apart (:func:`position`).

    ``hot`` holds the keys to be cut and their numbers of rows; see :func:`hot_keys`. The splitters of a key are a
    sample of its rows by a hash of their place, of about ``ranges`` rows whatever its size. They only decide who
    ranks where: any sample gives the same ranks.
    """
    rate = F.greatest(F.ceil(F.col("_rows") / ranges).cast("bigint"), F.lit(1).cast("bigint"))
    placed = df.withColumn("_place", place)
    sampled = placed.join(hot, keys).where(F.pmod(F.xxhash64("_place"), rate) == 0)
    splitters = sampled.groupBy(*keys).agg(F.sort_array(F.collect_set("_place")).alias("_splitters"))
    below = F.size(F.filter("_splitters", lambda s: s < F.col("_place")))
    cut = placed.join(splitters, keys, "left").withColumn(
        "_range", F.when(F.col("_splitters").isNotNull(), below).otherwise(0)).drop("_splitters", "_place")
    sizes = cut.join(hot.select(*keys), keys, "left_semi").groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.sum("_size").over(before)).drop("_size")
    ranked = cut.join(offsets, [*keys, "_range"], "left")
    inside = W.partitionBy(*keys, "_range").orderBy(*order)
    return ranked.withColumn(
        out, (F.row_number().over(inside) + F.coalesce("_offset", F.lit(0))).cast("int")
    ).drop("_range", "_offset")


def running_before(
    df: DataFrame, keys: list[str], position: str, agg, value: Column, out: str, chunk: int = CHUNK
) -> DataFrame:
    """``agg(value)`` over all earlier rows of the group, by chunks of ``position`` (1-based).

    ``agg`` must be mergeable with itself (max, min, sum). Only groups longer than
    one chunk produce carry rows.
    """
    chunk_no = ((F.col(position) - 1) / chunk).cast("bigint")
    rows = df.withColumn("_v", value).withColumn("_chunk", chunk_no)
    totals = rows.groupBy(*keys, "_chunk").agg(agg("_v").alias("_tot"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        totals.withColumn("_carry", agg("_tot").over(before)).where(F.col("_chunk") > 0).drop("_tot")
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    both = rows.withColumn("_in", agg("_v").over(inside)).join(carry, [*keys, "_chunk"], "left")
    merged = agg_pair(agg, F.col("_in"), F.col("_carry"))
    return both.withColumn(out, merged).drop("_v", "_chunk", "_in", "_carry")


def agg_pair(agg, a: Column, b: Column) -> Column:
    """Combine two partial results of ``agg``; NULL means no rows."""
    if agg is F.sum:
        return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
            F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        )
    if agg is F.max:
        return F.when(a.isNull() | (b > a), b).otherwise(a)
    if agg is F.min:
        return F.when(a.isNull() | (b < a), b).otherwise(a)
    raise ValueError("running_before supports sum, max and min")
