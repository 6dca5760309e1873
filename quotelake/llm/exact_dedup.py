"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash; DataFrame functions only.

Texts are equal when they agree after white space is deleted. The first scan groups by the length of the remaining
text and by the hash of its first `PREFIX` characters; only numbers are shuffled, already counted by each task. A row
whose length, or whose length and prefix, nobody shares is unique and is never hashed in full. Lengths and prefixes in
company set the bits of a bitmap of fixed size, which the second scan meets as a broadcast of `BITS` bits (8 MiB) at
most. Only rows whose bit is set take the full hash (SHA-256); a bit set by chance costs a hash, never a wrong group.
Texts never enter a shuffle: it carries ids, lengths and hashes.

Hot groups: counts and the row that stays are partial aggregates. The `HEAVY` largest groups are joined back to their
rows by broadcast (a bound by row number), all others by a shuffle in which no group can hold more than one row of
each `HEAVY`.

Defined cases: a null text is an empty one, and all empty texts are equal; of rows equal in every respect (id and
text) exactly one stays; a null id sorts after all others; repeated ids with different texts are different rows;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.llm.common import cut

PREFIX = 256
#: Bits of the bitmap of lengths and prefixes in company; a full one only means that every row takes the full hash.
BITS = 1 << 26
HEAVY = 1000
_WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Bits of one bitmap that the bitmap functions build.
_PIECE = 32768


def without_white(text: Column) -> Column:
    """The text without `[\\x20\\x09-\\x0D]`."""
    for sign in _WHITE:
        text = F.replace(text, F.lit(sign), F.lit(""))
    return text


def _rows(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.length("text").cast("long").alias("n_chars"), without_white(F.col("text")).alias("bare"))
    return rows.select(
        "id", "n_chars", "bare", F.octet_length("bare").cast("long").alias("size"),
        F.xxhash64(F.substring("bare", 1, prefix)).alias("head"))


def shared_heads(rows: DataFrame) -> DataFrame:
    """(size, head, n): the lengths that several rows have, and of these the prefixes that several rows have."""
    heads = rows.groupBy("size", "head").agg(F.count("*").alias("n"))
    sizes = heads.groupBy("size").agg(F.sum("n").alias("of_size")).where("of_size > 1")
    return heads.join(sizes, "size").where("n > 1").select("size", "head", "n")


def _slot(bits: int) -> Column:
    return F.pmod(F.xxhash64("size", "head"), F.lit(bits))


def _bitmap(shared: DataFrame, bits: int) -> DataFrame:
    """(piece, marks): at most bits / 32768 rows of 4 KiB."""
    slots = shared.select(_slot(bits).alias("slot")).select(
        F.floor(F.col("slot") / _PIECE).alias("piece"), (F.col("slot") % _PIECE).alias("bit"))
    return slots.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("marks"))


def _marked(bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring("marks", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, bits: int = BITS,
    heavy: int = HEAVY, digest_all: bool = False,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    `text_sha256` is null for rows found unique by length or prefix, unless `digest_all` asks for the hash of every
    row as an output; the refinement itself is the same.
    """
    rows = _rows(docs, id_col, text_col, prefix)
    slot = _slot(bits)
    placed = rows.withColumn("piece", F.floor(slot / _PIECE)).withColumn("bit", slot % _PIECE)
    met = placed.join(F.broadcast(_bitmap(shared_heads(rows), bits)), "piece", "left")
    open_ = _marked(F.col("bit"))
    full = F.sha2(F.col("bare").cast("binary"), 256)
    hashed = cut(met.select(
        "id", "n_chars", F.monotonically_increasing_id().alias("row"), open_.alias("open"),
        (full if digest_all else F.when(open_, full)).alias("sha")))
    place = F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), "id", "row")
    groups = cut(hashed.where("open").groupBy("sha").agg(
        F.count("*").alias("n"), F.min(place).alias("stays")).where("n > 1"))
    answer = ("id", "n", "stays", "row", "sha")
    large = groups.orderBy(F.desc("n"), "sha").limit(heavy)
    tried = hashed.join(F.broadcast(large), "sha", "left")
    small = groups.join(F.broadcast(large.select("sha")), "sha", "left_anti")
    rest = tried.where("n IS NULL").drop("n", "stays")
    single = (F.lit(1).cast("long").alias("n"), F.struct(F.col("id"), F.col("row")).alias("stays"))
    parts = (
        tried.where("n IS NOT NULL").select("id", "n", F.struct("stays.id", "stays.row").alias("stays"), "row", "sha"),
        rest.where("open").join(small, "sha", "left").select(
            "id", F.coalesce("n", F.lit(1)).alias("n"),
            F.when(F.col("n").isNull(), F.struct("id", "row")).otherwise(F.struct("stays.id", "stays.row")).alias("stays"),
            "row", "sha"),
        rest.where(~F.col("open")).select("id", *single, "row", "sha"),
    )
    every = parts[0].select(*answer).union(parts[1].select(*answer)).union(parts[2].select(*answer))
    return every.select(
        "id", F.col("stays.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("stays.row")).alias("kept"), F.col("sha").alias("text_sha256"))
