"""Record keeping on plain tables: upsert, patch, delete, latest state, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_state(events: DataFrame, keys: list[str], order: list[str], values: list[str], where: Column | None = None) -> DataFrame:
    """Newest record per key by ``order``. A map-side-combined maximum, so hot keys cost one row per task."""
    rows = events if where is None else events.where(where)
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in dict.fromkeys([*order, *values])])


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace rows with the same key; new keys are added."""
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def patch(current: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Overwrite only the fields a change gives a value for."""
    p = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = current.join(p, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c))).drop(f"_{c}")
    return out


def delete_projects(tables: dict[str, DataFrame], project_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove projects from every table that carries project_id."""
    gone = project_ids.select("project_id").distinct()
    return {name: df.join(gone, "project_id", "left_anti") for name, df in tables.items()}


def status_counts(projects: DataFrame) -> DataFrame:
    """Projects per status and in total (status NULL)."""
    return projects.rollup("status").agg(F.count("*").alias("n"))


def search_projects(projects: DataFrame, term: str = "", workflow: str | None = None, page: int = 1, size: int = 10) -> DataFrame:
    """One page of the projects whose id, name or company contains the term, newest first."""
    t = F.lit(term.strip().lower())
    hit = F.lower(F.col("project_id").cast("string")).contains(t) | F.lower("name").contains(t) | F.lower("company_name").contains(t)
    found = projects.where(hit)
    if workflow is not None:
        found = found.where(F.col("status") == workflow)
    ordered = found.orderBy(F.col("created_at").desc(), F.col("project_id"))
    return ordered.offset((page - 1) * size).limit(size)


def recent(records: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return records.orderBy(*order).limit(n)


def write_partitioned(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Store a table split by a hash of its key, so later runs prune to the touched folders."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)
