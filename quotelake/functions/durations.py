"""Delivery and warranty durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelake.functions import vocab as v
from quotelake.functions.expr import div_ceil, group1, strip


def delivery_line(notes: Column) -> Column:
    """First note line that talks about delivery."""
    lines = F.split(F.coalesce(notes, F.lit("")), r"\r\n|\r|\n")
    hits = F.filter(lines, lambda s: _mentions_delivery(s))
    return strip(F.get(hits, F.lit(0)))


def _mentions_delivery(text: Column) -> Column:
    cond = text.contains(v.DELIVERY_LINE_TOKENS[0])
    for token in v.DELIVERY_LINE_TOKENS[1:]:
        cond = cond | text.contains(token)
    return cond


def weeks_from_text(raw: Column) -> Column:
    """Weeks named in a delivery phrase; days round up; NULL when to be discussed."""
    weeks = group1(raw, v.DELIVERY_WEEK_PATTERN).cast("int")
    days = F.coalesce(
        group1(raw, v.DELIVERY_DAY_PATTERN).cast("int"), group1(raw, r"(?U)^\s*(\d{1,3})\s*$").cast("int")
    )
    return F.when(
        ~F.coalesce(raw.rlike(v.DELIVERY_DISCUSSION_PATTERN), F.lit(False)), F.coalesce(weeks, div_ceil(days, 7))
    )
