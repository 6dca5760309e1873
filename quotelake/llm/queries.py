"""Registered queries of the numbered operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.bpe import bpe_round_trip
from quotelake.llm.chat import format_chats
from quotelake.llm.common import table
from quotelake.llm.decontam import contamination
from quotelake.llm.embed_dedup import near_vectors
from quotelake.llm.exact_dedup import exact_groups
from quotelake.llm.hard_negatives import hard_negatives
from quotelake.llm.html_extract import extract
from quotelake.llm.quality import quality_scores
from quotelake.llm.sharding import LIMIT, assign
from quotelake.llm.simhash import simhash_components
from quotelake.llm.token_align import alignments
from quotelake.llm.token_count import token_counts
from quotelake.llm.warc import derive, page_responses


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its SimHash fingerprint and component."""
    return simhash_components(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    found = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component."""
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    coded = bpe_round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return coded.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard."""
    return assign(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return derive(page_responses(table(spark, sf_dir, "pages"))).select(
        F.col("id").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "payload_digest",
        "block_digest", "content_type", "content_length", "source_headers", F.col("block").cast("string").alias("block"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its benchmark hits."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers on every document."""
    return alignments(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    ).withColumnRenamed("id", "doc_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all rows; every seventh label is moved on by one."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: _scaled(x.cast("double"))).alias("embedding"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def _scaled(x: Column) -> Column:
    """floor(256 x); a component that is no finite number stays as it is, so that its row takes no part."""
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.floor(x * 256).cast("double")).otherwise(x)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of all equal to it."""
    return exact_groups(table(spark, sf_dir, "documents"), digest_all=True).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_embed_dedup": op3_embed_dedup,
    "op4_bpe": op4_bpe,
    "op5_html_extract": op5_html_extract,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_chat_format": op8_chat_format,
    "op9_decontaminate": op9_decontaminate,
    "op10_warc": op10_warc,
    "op11_token_align": op11_token_align,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_dedup": op13_exact_dedup,
}

_WORDS = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP9_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
    unnest([array_to_string(w[i:i + least(len(w), 13) - 1], ' ') FOR i IN range(1, greatest(len(w) - 12, 1) + 1)]) AS g
  FROM items WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
grams AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
    unnest([array_to_string(w[j:j + n - 1], ' ') FOR j IN range(1, len(w) - n + 2)]) AS g
  FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (SELECT doc_id, item_id, grams.n AS n, i FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

def op7_sql(limit: int = LIMIT) -> str:
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
levels AS (SELECT doc_id, n_bytes, h, unnest(range(0, 61)) AS d FROM docs),
sums AS (SELECT d, h >> (60 - d) AS p, sum(n_bytes)::BIGINT AS b, count(*) AS n FROM levels GROUP BY ALL),
leaf AS (
  SELECT doc_id, min(l.d) AS depth FROM levels l JOIN sums s ON s.d = l.d AND s.p = l.h >> (60 - l.d)
  WHERE b <= {limit} OR n = 1 GROUP BY doc_id)
SELECT doc_id, n_bytes, left(lpad(bin(h), 60, '0'), depth::INT) AS shard_id, depth::INT AS depth, b AS shard_bytes,
  n AS shard_docs, b > {limit} AS oversize
FROM docs JOIN leaf USING (doc_id) JOIN sums ON sums.d = depth AND sums.p = h >> (60 - depth)
"""


OP8_SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, text, '<|im_start|>' || coalesce(role, 'unknown') || chr(10)
    || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS line FROM conversations),
chats AS (
  SELECT conv_id, list((turn, role, text) ORDER BY turn, role, text) AS seq, count(*) AS n_turns,
    string_agg(line, '' ORDER BY turn, role, text) AS text FROM turns GROUP BY conv_id),
prefixes AS (SELECT DISTINCT unnest([seq[1:k] FOR k IN range(1, len(seq))]) AS seq FROM chats),
kept AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM chats WHERE seq NOT IN (SELECT seq FROM prefixes) GROUP BY seq)
SELECT conv_id, 0::BIGINT AS part, n_turns, n_copies, text FROM kept JOIN chats USING (conv_id)
"""

OP12_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i]))::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER best)::INT AS rank, id AS negative_id, positive_score,
  score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER best <= 5
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
  row_number() OVER best = 1 AS kept, sha AS text_sha256
FROM docs WINDOW best AS (PARTITION BY sha ORDER BY n DESC, doc_id NULLS LAST)
"""

ORACLES: dict[str, str] = {
    "op7_sharding": op7_sql(),
    "op8_chat_format": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_exact_dedup": OP13_SQL,
}
