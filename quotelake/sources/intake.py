"""Batch intake: screening, hashing, dead letters, structured quotes and storage projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.functions.expr import first_match, strip

# Accepted upload types, empty spellings, fields kept out of storage.
QUOTE_EXTENSIONS = [".pdf", ".png", ".jpg", ".jpeg", ".xlsx", ".xls"]
EMPTY_WORDS = ["", "미입력", "없음", "null", "undefined", "none"]
HEAVY_FIELDS = [
    "embedding_vector", "requirement_embedding", "partner_embedding", "raw", "raw_document", "binary_content",
    "api_key", "endpoint", "deployment", "raw_llm_output",
]
CAPPED_FIELDS = ["source_text", "ocr_text"]
MSG_NO_DOCUMENT = "QuoteDocument가 없습니다."
MSG_NO_QUOTE_ID = "quote_id가 없습니다."
MSG_BAD_DOCUMENT = "유효하지 않은 QuoteDocument입니다."


#: Columns of Spark's file source.
FILE = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as (path, modificationTime, length, content). Spark's file source passes over files of no bytes."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    )


def stream_files(spark: SparkSession, path: str, pattern: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """The same as a stream of new files."""
    reader = spark.readStream.format("binaryFile").schema(FILE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def write_bundles(files: DataFrame, folder: str) -> None:
    """Pack files (path, content) into bundles: Parquet tables with the columns of the file source, one row a file.

    Millions of small files cost a folder entry, an opening and a place in the driver's listing each; packed ones cost
    their bytes. A file of any size is one row.
    """
    files.select(
        "path", F.current_timestamp().alias("modificationTime"), F.octet_length("content").cast("long").alias("length"), "content",
    ).write.parquet(folder)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Files out of the bundles of a folder, in the columns of :func:`read_files`."""
    return spark.read.schema(FILE).parquet(path)


def stream_bundles(spark: SparkSession, path: str, bundles_per_batch: int | None = None) -> DataFrame:
    """The same as a stream of new bundles."""
    reader = spark.readStream.schema(FILE)
    if bundles_per_batch:
        reader = reader.option("maxFilesPerTrigger", bundles_per_batch)
    return reader.parquet(path)


def screen_files(files: DataFrame, name: Column | None = None, accepted: list[str] = QUOTE_EXTENSIONS) -> DataFrame:
    """Add ``reject_reason``: unsupported extension or empty file. The extension is that of ``name``, else of the path."""
    ext = F.lower(F.regexp_extract(F.col("path") if name is None else name, r"(\.[^./\\]+)$", 1))
    return files.withColumn("extension", ext).withColumn(
        "reject_reason",
        F.when(~ext.isin(accepted), "unsupported_extension").when(F.col("length") == 0, "empty_file"),
    )


def with_file_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("file_hash", F.sha2(F.col(content).cast("binary"), 256)).withColumn(
        "short_hash", F.substring("file_hash", 1, 8)
    )


def dedupe_files(files: DataFrame, order: str) -> DataFrame:
    """One file per content hash, the first by ``order``.

    Only the keys travel: the winner of each hash is found with a map-side-combined
    minimum, so thousands of copies of one file cost one row per task.
    """
    return files.groupBy("file_hash").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def split_good_bad(rows: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead letter) by a nullable reason column."""
    return rows.where(F.col(reason).isNull()).drop(reason), rows.where(F.col(reason).isNotNull())


def screen_candidates(quotes: DataFrame) -> DataFrame:
    """Add ``failure_reason``: a quote needs an id, and a vendor name or at least one line."""
    blank = F.coalesce(F.col("vendor_name"), F.lit("")) == ""
    return quotes.withColumn(
        "failure_reason",
        F.when(F.coalesce(F.col("quote_id").cast("string"), F.lit("")) == "", MSG_NO_QUOTE_ID).when(
            blank & (F.coalesce("line_count", F.lit(0)) == 0), MSG_BAD_DOCUMENT
        ),
    )


def normalize_empty(value: Column) -> Column:
    """NULL for the usual spellings of 'nothing entered'."""
    text = strip(value)
    return F.when(~F.lower(text).isin(EMPTY_WORDS), text)


def strip_heavy(df: DataFrame, text_chars: int | None = None) -> DataFrame:
    """Projection for storage: no vectors or secrets; source texts are cut where ``text_chars`` is named."""
    out = df.drop(*HEAVY_FIELDS)
    for name in CAPPED_FIELDS:
        if text_chars and name in out.columns:
            out = out.withColumn(name, F.substring(F.col(name), 1, text_chars))
    return out


def to_record(df: DataFrame, keys: list[str], out: str = "record_json") -> DataFrame:
    """Row as JSON text next to its keys."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias(out))


def from_record(df: DataFrame, schema: T.StructType, column: str = "record_json") -> DataFrame:
    return df.select(F.from_json(column, schema).alias("r")).select("r.*")


# ------------------------------------------------------------- structured quotes

LINE_SCHEMA = (
    "name string, category string, quantity string, unit string, unit_price string, total_price string, "
    "is_optional string, spec_raw string, extraction_confidence string"
)
QUOTE_JSON_SCHEMA = (
    "vendor_name string, quote_id string, received_at string, project_name string, total_supply_price string, "
    "total_with_vat string, currency string, delivery_weeks string, delivery_basis_raw string, warranty_months string, "
    f"notes_raw string, extraction_confidence string, line_items array<struct<{LINE_SCHEMA.replace(' string', ':string')}>>"
)
DEFAULT_CONFIDENCE = 0.5
DEFAULT_LINE_CONFIDENCE = 0.5


def tolerant_long(text: Column) -> Column:
    """Whole number from text with commas, currency marks or a decimal part; NULL when none."""
    cleaned = F.regexp_replace(text, r"[^0-9.\-]", "")
    return cleaned.try_cast("double").cast("bigint")


def tolerant_double(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def tolerant_bool(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.coalesce(low.isin("true", "1", "yes", "y"), F.lit(False))


def parse_json_quotes(raw: DataFrame, column: str = "raw_json") -> DataFrame:
    """Typed quote and its lines from JSON text; unreadable text gets a ``failure_reason``."""
    q = F.from_json(F.col(column), QUOTE_JSON_SCHEMA)
    bad = F.col("q").isNull() | F.try_parse_json(F.col(column)).isNull()
    vendor = F.coalesce(F.col("q.vendor_name"), F.lit(""))
    lines = F.transform(
        F.coalesce(F.col("q.line_items"), F.array().cast(f"array<struct<{LINE_SCHEMA.replace(' string', ':string')}>>")),
        _typed_line,
    )
    return (
        raw.withColumn("q", q)
        .withColumn("failure_reason", F.when(bad, "invalid_json"))
        .withColumn("vendor_name", vendor)
        .withColumn("quote_ref", F.col("q.quote_id"))
        .withColumn("total_supply_price", F.coalesce(tolerant_long(F.col("q.total_supply_price")), F.lit(0)))
        .withColumn("total_with_vat", tolerant_long(F.col("q.total_with_vat")))
        .withColumn("delivery_weeks", tolerant_long(F.col("q.delivery_weeks")).cast("int"))
        .withColumn("warranty_months", tolerant_long(F.col("q.warranty_months")).cast("int"))
        .withColumn(
            "extraction_confidence",
            F.coalesce(tolerant_double(F.col("q.extraction_confidence")), F.lit(DEFAULT_CONFIDENCE)),
        )
        .withColumn("line_items", lines)
        .drop("q")
    )


def _typed_line(item: Column) -> Column:
    categories = ["DISPLAY", "MOUNT", "CABLE", "PLAYER", "SOFTWARE", "INSTALL", "ETC"]
    cat = F.upper(F.trim(item["category"]))
    return F.struct(
        F.coalesce(item["name"], F.lit("")).alias("name"),
        F.when(cat.isin(categories), cat).otherwise("ETC").alias("category"),
        F.coalesce(tolerant_double(item["quantity"]), F.lit(1.0)).alias("quantity"),
        F.coalesce(item["unit"], F.lit("")).alias("unit"),
        tolerant_long(item["unit_price"]).alias("unit_price"),
        tolerant_long(item["total_price"]).alias("total_price"),
        tolerant_bool(item["is_optional"]).alias("is_optional"),
        F.coalesce(item["spec_raw"], F.lit("")).alias("spec_raw"),
        F.coalesce(tolerant_double(item["extraction_confidence"]), F.lit(DEFAULT_LINE_CONFIDENCE)).alias("extraction_confidence"),
    )


def explode_lines(typed: DataFrame, keys: list[str]) -> DataFrame:
    """Typed lines as rows with their position."""
    return typed.select(*keys, F.posexplode("line_items").alias("line_no", "item")).select(
        *keys, (F.col("line_no") + 1).alias("line_no"), "item.*"
    )


# -------------------------------------------------------------------- quote ids


def safe_id_part(value: Column) -> Column:
    """Letters and digits kept, everything else one underscore."""
    text = F.regexp_replace(strip(value), r"(?U)\s+", "_")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_]", "_")
    return F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_+|_+$", "")


def quote_id(vendor: Column, received_at: Column, short_hash: Column) -> Column:
    safe = F.coalesce(F.nullif(safe_id_part(vendor), F.lit("")), F.lit("unknown_vendor"))
    stamp = F.date_format(F.coalesce(received_at, F.lit("1970-01-01").cast("timestamp")), "yyyyMMdd_HHmmss")
    return F.concat_ws("_", safe, stamp, short_hash)


def is_temporary_id(value: Column) -> Column:
    return ~F.coalesce(value.rlike(r"_[0-9]{8}_[0-9]{6}_[0-9a-fA-F]{8}$"), F.lit(False))


def option_quote_id(parent: Column, option_no: Column, label: Column) -> Column:
    tail = F.coalesce(F.nullif(safe_id_part(label), F.lit("")), F.concat(F.lit("option_"), option_no.cast("string")))
    return F.concat(parent, F.lit("_opt"), option_no.cast("string"), F.lit("_"), tail)


# --------------------------------------------------------------------- OCR grids


def dense_grid(cells: DataFrame) -> DataFrame:
    """Every (row, column) of every table, empty text where the source has no cell.

    The grid is built per table row from the widest column seen in the table, so only
    small per-table sizes are joined back.
    """
    size = cells.groupBy("quote_id", "table_no").agg(F.max("col_no").alias("_width"), F.max("row_no").alias("_height"))
    rows = size.withColumn("row_no", F.explode(F.sequence(F.lit(1), F.col("_height"))))
    full = rows.withColumn("col_no", F.explode(F.sequence(F.lit(1), F.col("_width")))).drop("_width", "_height")
    keys = ["quote_id", "table_no", "row_no", "col_no"]
    one = cells.groupBy(*keys).agg(F.max("value").alias("value"))
    return full.join(one, keys, "left").withColumn("value", F.coalesce("value", F.lit("")))


def document_kind(path: Column) -> Column:
    """Route of a file: sheet rows or text recognition."""
    low = F.lower(path)
    return first_match([(low.rlike(r"\.xlsx?$"), "sheet"), (low.endswith(".txt"), "text")], "recognition")
