"""Embedding store: content hashes, stale entries, refresh through a user hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.operators.partners import format_history

HASH_FIELDS = [
    "name", "specialty_tags", "is_premium", "success_rate", "response_speed", "financial_status", "is_excluded",
    "solution_breakdown", "installation_count", "company_location",
]


def source_hash(columns: list[str] = HASH_FIELDS, maps: tuple[str, ...] = ("solution_breakdown",)) -> Column:
    """Hash of the profile fields an embedding depends on; map entries sorted so order never matters."""
    parts = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in columns]
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def stale_partners(partners: DataFrame, store: DataFrame, dim: int | None) -> DataFrame:
    """Partners whose stored vector is absent, older than the profile, or of another dimension."""
    current = partners.withColumn("source_hash", source_hash())
    fresh = store.where(F.size("vec") == dim) if dim is not None else store.where(F.size("vec") > 0)
    return current.join(fresh.select("name", "source_hash"), ["name", "source_hash"], "left_anti")


def partner_text() -> Column:
    """Text a partner profile is embedded from."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    history = F.nullif(format_history(F.col("solution_breakdown")), F.lit(""))
    words = F.array_distinct(F.concat("specialty_tags", F.map_keys("solution_breakdown")))
    return F.concat_ws(
        "\n",
        line("파트너명", F.col("name")),
        line("전문 분야", F.array_join("specialty_tags", ", ")),
        line("솔루션 키워드", F.array_join(words, ", ")),
        line("partner_type", F.when(F.col("is_premium"), "premium partner").otherwise("standard partner")),
        line("설치 실적 수", F.col("installation_count").cast("string")),
        line("솔루션 이력", history),
    )


def requirement_text() -> Column:
    """Text a request is embedded from; empty fields leave no line."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), F.nullif(F.trim(value), F.lit("")))
    return F.concat_ws(
        "\n",
        line("고객사", F.col("customer_name")),
        line("요청 요약", F.col("request_summary")),
        line("카테고리", F.col("category")),
        line("지역", F.col("region")),
        line("설치 일정", F.col("install_schedule_text")),
        line("예산 상한", F.concat(F.col("budget_max").cast("string"), F.lit("원"))),
        F.when(F.size("required_keywords") > 0, line("키워드", F.array_join("required_keywords", ", "))),
    )


def quote_text() -> Column:
    """Head of the text a quote is embedded from."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), F.nullif(F.trim(value), F.lit("")))
    return F.concat_ws(
        "\n",
        line("업체명", F.col("vendor_name")),
        line("공급가 합계", F.col("total_supply_price").cast("string")),
        line("VAT 포함 총액", F.col("total_with_vat").cast("string")),
        line("납기 주수", F.concat(F.col("delivery_weeks").cast("string"), F.lit("주"))),
        line("납기 원문", F.col("delivery_basis_raw")),
        line("보증기간", F.concat(F.col("warranty_months").cast("string"), F.lit("개월"))),
        line("비고", F.col("notes_raw")),
    )


def embed(df: DataFrame, text: str, embed_fn: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    """Add ``vec`` by calling the user's model on Arrow batches of texts; a wrong dimension fails the job."""
    schema = f"{df.drop(text).schema.simpleString()[7:-1].replace(':', ' ')}, {text} string, vec array<double>"
    columns = [*[c for c in df.columns if c != text], text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = embed_fn(pdf[text].tolist())
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"embedding dimension is not {dim}")
            yield pdf.assign(vec=vectors)

    return df.select(*columns).mapInPandas(run, schema)


def refresh_store(partners: DataFrame, store: DataFrame, embed_fn, dim: int) -> DataFrame:
    """New store: fresh entries kept, stale or missing ones embedded again, departed names kept."""
    stale = stale_partners(partners, store, dim)
    fresh_vectors = embed(stale.select("name", "source_hash", partner_text().alias("text")), "text", embed_fn, dim)
    kept = store.join(stale.select("name"), "name", "left_anti").select("name", "source_hash", "vec")
    return kept.unionByName(fresh_vectors.select("name", "source_hash", "vec"))
