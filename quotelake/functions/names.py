"""Company-name normalization and other name clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Corporate-form marks removed before names are compared.
CORPORATE_MARKS = r"(?i)\(주\)|㈜|주식회사|주\)"
NAME_ALPHABET = r"[^0-9A-Za-z가-힣]"


def normalize_company(name: Column) -> Column:
    """Comparison key of a company name: no corporate marks, letters and digits only, lower case."""
    text = F.regexp_replace(F.coalesce(name, F.lit("")), CORPORATE_MARKS, "")
    return F.lower(F.regexp_replace(text, NAME_ALPHABET, ""))
