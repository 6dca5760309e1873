"""Sharding by extendible hashing: the directory splits only buckets above the byte limit, one hash bit at a time.

A document's bucket is a prefix of its hash bits. All documents start in one bucket (depth 0); a bucket above the limit
splits on its next bit, every other bucket stays. Sizes only shrink along a prefix, so a document's depth is the first
at which its prefix's bytes fit. A pass sums bytes over prefixes of `PASS_BITS` more bits (partial sums before the
shuffle) and finds those depths for all of them; only documents below buckets still too large enter the next pass.
Identifiers, hashes and sizes are shuffled, never texts, and the directory stays a table.

The bits come from md5 of the id. Repeated ids share all 60 of them; for these, 60 further bits from the text and a
row number follow, so that they too can be split. A bucket with one document never splits: a document above the limit
is a shard of its own and is marked `oversize`.

Defined cases: null text has 0 bytes; null ids count as repeats of one id; an empty table has no shards; other columns
are ignored, and kept by `write_shards`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import cut

#: Bytes of text in a shard.
LIMIT = 16 << 20
#: Bits of each of the two hash words, and bits that one pass looks ahead.
BITS = 60
PASS_BITS = 12


def _prefix(depth) -> F.Column:
    """The first `depth` bits of the two words as a pair of numbers."""
    return F.struct(
        F.when(depth >= BITS, F.col("h")).otherwise(F.expr("shiftright(h, cast(greatest(60 - d, 0) as int))")).alias("p"),
        F.when(depth <= BITS, F.lit(0).cast("long")).otherwise(
            F.expr("shiftright(h2, cast(greatest(120 - d, 0) as int))")).alias("q"),
    )


def assign(
    docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", pass_bits: int = PASS_BITS
) -> DataFrame:
    """(id, n_bytes, shard_id, depth, shard_bytes, shard_docs, oversize) of every document; shard_id is the bit prefix."""
    return _named(_rows(docs, limit, id_col, text_col, pass_bits, ())).drop("row")


def _rows(docs: DataFrame, limit: int, id_col: str, text_col: str, pass_bits: int, keep: tuple[str, ...]) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
        F.expr(f"shiftrightunsigned(xxhash64(`{text_col}`, monotonically_increasing_id()), 4)").alias("h2"), *keep,
    )
    todo, done, depth = cut(rows), [], 0
    while True:
        end = min(depth + pass_bits, 2 * BITS)
        leaves = cut(_leaves(todo, limit, depth, end))
        at_end = todo.withColumn("d", F.lit(end)).withColumn("cell", _prefix(F.col("d"))).drop("d")
        found = at_end.join(leaves, "cell")
        done.append(found.where("leaf IS NOT NULL"))
        if end == 2 * BITS or leaves.where("leaf IS NULL").isEmpty():
            break
        todo = cut(found.where("leaf IS NULL").select(rows.columns))
        depth = end
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _leaves(rows: DataFrame, limit: int, start: int, end: int) -> DataFrame:
    """(cell at depth `end`, leaf depth or null, bytes, docs of the leaf); at the last bit every cell is a leaf."""
    sums = rows.withColumn("d", F.lit(end)).withColumn("cell", _prefix(F.col("d"))).groupBy("cell").agg(
        F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.first("h").alias("h"), F.first("h2").alias("h2"))
    levels = sums.withColumn("d", F.explode(F.sequence(F.lit(start), F.lit(end)))).withColumn("prefix", _prefix(F.col("d")))
    total = levels.groupBy("d", "prefix").agg(F.sum("b").alias("bytes"), F.sum("n").alias("docs")).where(
        (F.col("bytes") <= limit) | (F.col("docs") == 1) | (F.col("d") == 2 * BITS))
    first = levels.join(total, ["d", "prefix"], "left").groupBy("cell").agg(
        F.min(F.when(F.col("bytes").isNotNull(), F.struct("d", "bytes", "docs"))).alias("leaf"))
    return first.select("cell", F.col("leaf.d").alias("leaf"), F.col("leaf.bytes").alias("shard_bytes"),
                        F.col("leaf.docs").alias("shard_docs"), (F.col("leaf.bytes") > limit).alias("oversize"))


def _named(rows: DataFrame) -> DataFrame:
    bits = F.concat(F.lpad(F.bin("h"), BITS, "0"), F.lpad(F.bin("h2"), BITS, "0"))
    return rows.select(
        "row", "id", "n_bytes", F.substring(bits, F.lit(1), F.col("leaf")).alias("shard_id"),
        F.col("leaf").cast("int").alias("depth"), "shard_bytes", "shard_docs", "oversize",
    )


def write_shards(
    docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the documents as one Parquet folder per shard (shard=<bits>); a task holds one shard's rows at a time.

    Where the documents have a column `shard` of their own, the folders take the first free of shard_, shard__, ...
    """
    folder = "shard"
    while folder.lower() in {c.lower() for c in docs.columns}:
        folder += "_"
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__document")
    rows = docs.select(F.col(id_col), F.col(text_col), columns)
    placed = _rows(rows, limit, id_col, text_col, PASS_BITS, ("__document",))
    named = placed.select(
        F.concat(F.lit("b"), F.substring(F.concat(F.lpad(F.bin("h"), BITS, "0"), F.lpad(F.bin("h2"), BITS, "0")),
                                         F.lit(1), F.col("leaf"))).alias("__shard"), "__document")
    named.repartition("__shard").select(F.col("__shard").alias(folder), "__document.*").write.partitionBy(folder).parquet(path)
