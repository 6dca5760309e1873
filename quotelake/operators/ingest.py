"""From the bytes of quote files to typed, checked quotes, and a reason for every file that gives none.

One job for batch and stream: files are screened, hashed and decoded in a narrow pass; amounts, dates, delivery,
warranty, terms, lines, vendor and project are read from each text, checked against each other and given a quote id.
A bad file never stops the others: it becomes a row with its ``failure_reason``. Text recognition of scans is done by
an external producer; its texts arrive as the files' content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotelake.operators import extract as x
from quotelake.operators.tables import text_items
from quotelake.operators.validate import amount_validation, apply_delivery, delivery_validation
from quotelake.operators.vendors import resolve_vendor_names
from quotelake.sources.intake import QUOTE_EXTENSIONS, quote_id, screen_candidates, screen_files, with_file_hash

#: File names that end like this hold recognised text; the others are accepted with text as their content.
TEXT_EXTENSIONS = [".txt"]

_TEXT, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()
EXTRACTED = T.StructType([T.StructField(name, kind) for name, kind in (
    ("path", _TEXT), ("file_name", _TEXT), ("file_hash", _TEXT), ("quote_id", _TEXT), ("vendor_name", _TEXT),
    ("vendor_name_source", _TEXT), ("project_name", _TEXT), ("project_name_source", _TEXT), ("quote_date", T.DateType()),
    ("total_supply_price", _LONG), ("tax_amount", _LONG), ("total_with_vat", _LONG), ("line_count", _LONG), ("line_sum", _LONG),
    ("delivery_weeks", _INT), ("delivery_status", _TEXT), ("warranty_months", _INT), ("payment_terms", _TEXT),
    ("quote_validity_days", _INT), ("validation_status", _TEXT), ("check_required", T.ArrayType(_TEXT)), ("failure_reason", _TEXT),
)])


def file_name_of(path: Column) -> Column:
    """Last part of a path with its escapes resolved."""
    return F.try_url_decode(F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\+", "%2B"))


def decoded_files(files: DataFrame, accepted: list[str] = QUOTE_EXTENSIONS + TEXT_EXTENSIONS) -> DataFrame:
    """(path, file_name, modificationTime, file_hash, short_hash, text, reject_reason) of files as the binary source gives them.

    A ``file_name`` column is used where there is one; else the name comes from the path.
    """
    if "file_name" not in files.columns:
        files = files.withColumn("file_name", F.coalesce(file_name_of(F.col("path")), F.col("path")))
    named = with_file_hash(screen_files(files, F.col("file_name"), accepted))
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    read = F.when(valid, text)
    blank = F.regexp_replace(read, r"(?U)[\s﻿]", "") == ""
    reason = F.coalesce("reject_reason", F.when(~valid, "undecodable_text"), F.when(F.coalesce(blank, F.lit(True)), "empty_text"))
    return named.select(
        "path", "file_name", "modificationTime", "file_hash", "short_hash",
        F.when(F.col("reject_reason").isNull(), read).alias("text"), reason.alias("reject_reason"))


def extract_files(decoded: DataFrame, partners: DataFrame) -> DataFrame:
    """One row for each decoded file: the quote read from it, or ``failure_reason`` alone.

    ``partners`` has ``name``. Lines and vendor candidates are reduced by path; texts do not enter those shuffles.
    """
    good = decoded.where("reject_reason IS NULL")
    texts = good.select("path", "file_name", "modificationTime", "file_hash", "short_hash", "text")
    read = x.quote_date(x.terms(x.warranty(x.delivery(x.summary_amounts(texts)))))
    lines = text_items(texts.select("path", "text")).groupBy("path").agg(
        F.count("*").alias("line_count"), F.sum("supply_amount").alias("line_sum"))
    vendors = resolve_vendor_names(texts.select(
        F.col("path").alias("doc_id"), "text", "file_name", F.lit("").alias("vendor_name")), partners)
    vendors = vendors.select(F.col("doc_id").alias("path"), "vendor_name", "vendor_name_source")
    named = x.resolve_project_name(
        read.join(vendors, "path", "left").join(lines, "path", "left").withColumn("project_name", F.lit(""))
    ).drop("text")
    typed = named.select(
        "path", "file_name", "file_hash", "short_hash", "modificationTime", "vendor_name", "vendor_name_source", "quote_date",
        F.col("resolved_project_name").alias("project_name"), "project_name_source", "project_name_check",
        F.col("supply_amount").cast("long").alias("total_supply_price"), F.col("tax_amount").cast("long").alias("tax_amount"),
        F.col("total_amount").cast("long").alias("total_with_vat"), F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.col("line_sum").cast("long").alias("line_sum"), "delivery_basis_raw", F.lit("").alias("notes_raw"),
        F.col("delivery_weeks").cast("int").alias("delivery_weeks"), F.col("warranty_months").cast("int").alias("warranty_months"),
        "warranty_check", "payment_terms", F.col("quote_validity_days").cast("int").alias("quote_validity_days"))
    checked = apply_delivery(delivery_validation(amount_validation(typed)))
    stamp = F.coalesce(F.col("quote_date").cast("timestamp"), F.col("modificationTime"))
    known = F.when(F.col("vendor_name_source") != "unresolved", F.col("vendor_name"))
    checked = checked.withColumn("vendor_name", known).withColumn(
        "quote_id", quote_id(F.coalesce("vendor_name", F.lit("")), stamp, F.col("short_hash")))
    messages = F.array_compact(F.array("amount_message", "delivery_message", "warranty_check", "project_name_check"))
    quotes = screen_candidates(checked.withColumn("check_required", messages))
    dead = decoded.where("reject_reason IS NOT NULL").withColumn("failure_reason", F.col("reject_reason"))
    return quotes.select(*EXTRACTED.names).unionByName(
        dead.select("path", "file_name", "file_hash", "failure_reason"), allowMissingColumns=True
    ).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EXTRACTED.fields])
