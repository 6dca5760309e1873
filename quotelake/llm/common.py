"""Helpers shared by the operators: lineage cuts, connected components, edge reduction inside a task."""

from __future__ import annotations

import re
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's `spark.checkpoint.dir`.

    Where none is named, a local master gets a temporary one (tests); a cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, label): every node that is not the smallest of its component, with that smallest.

    Alternating large-star and small-star rounds; the edge count never grows, minima are pre-aggregated before each
    shuffle and a hub's rows meet only in joins, which adaptive execution splits. Null ends and self links are ignored.
    """
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _signature(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(rest.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, seen = seen, _signature(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["x"], row["s"]


class Forest:
    """Union-find over 0..n-1 on numpy arrays: a task keeps one spanning link per node instead of every pair."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n, dtype=np.int64)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.parent[u], self.parent[v]
            differs = a != b
            if not differs.any():
                return
            u, v, a, b = u[differs], v[differs], a[differs], b[differs]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                jump = self.parent[self.parent]
                if np.array_equal(jump, self.parent):
                    break
                self.parent = jump

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.parent[child]
