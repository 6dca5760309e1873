"""Small Column helpers shared by every operator. All stay JVM-side."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    The optimizer inlines a plain ``withColumn`` into later expressions, also into
    lambdas, where it would run again for every array element. A one-element generator
    keeps the value materialized and stays narrow.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, tokens: list[str]) -> Column:
    """True when any token occurs in ``text`` (literal, case-sensitive).

    Longer lists become one alternation, which keeps the generated code small enough
    for the JIT compiler.
    """
    if len(tokens) <= 2:
        return any_of([text.contains(t) for t in tokens])
    return text.rlike("|".join(re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", t) for t in tokens))


def contains_any_case(text: Column, tokens: list[str]) -> Column:
    """:func:`contains_any` of the text in lower case, without making it: lower-casing what is not ASCII is slow.

    Tokens are in lower case; of ASCII letters no token may hold a k or end in i, which other capitals have as lower case.
    """
    return text.rlike("(?i)" + "|".join(re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", t) for t in tokens))


def compact(text: Column) -> Column:
    """Lower-case with ASCII spaces removed; NULL reads as empty."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")))


# Every Unicode whitespace (the plain ``\\s`` of the regex engine is ASCII only). The characters below 256 are
# named one by one, which the engine keeps as one bit set; the others stand behind one range, so that a letter fails at once.
_SPACES = r"\t\x0b\f \x1c\x1d\x1e\x1f\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
SPACE = rf"[\r\n{_SPACES}]"
SPACE_IN_LINE = f"[{_SPACES}]"


def squeeze(text: Column) -> Column:
    """Lower-case with every kind of whitespace removed."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", ""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


#: Every character of ``SPACE``.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(r"[\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", c))


def strip_cell(text: Column) -> Column:
    """:func:`strip` for short texts: no pattern is run, but positions of all characters are held."""
    return F.btrim(text, F.lit(SPACES))


def spaceless(text: Column) -> Column:
    """Every kind of whitespace removed."""
    return F.regexp_replace(text, SPACE + "+", "")


def matched(text: Column, pattern: str, convert) -> Column:
    """``convert`` of the first match's first group; NULL without a match, where nothing is converted.

    A conversion of the empty string would fail, which costs as much as many matches.
    """
    found = F.filter(F.array(F.when(text != "", F.regexp_extract(text, pattern, 1))), lambda a: a != "")
    return F.get(F.transform(found, convert), F.lit(0))


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def round2(value: Column) -> Column:
    """Two decimals, ties to even on the scaled double (the usual scripting-language rule)."""
    return F.rint(value * 100.0) / 100.0


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def messages(*pairs: tuple[Column, str | Column]) -> Column:
    """Array of the messages whose condition holds, in the given order."""
    parts = [
        F.when(cond, F.lit(msg) if isinstance(msg, str) else msg) for cond, msg in pairs
    ]
    return F.array_compact(F.array(*parts))


def lookup(column: Column, table: dict, default=None) -> Column:
    """Constant dictionary lookup as a CASE expression."""
    out = None
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(default))


def first_match(rules: list[tuple[Column, object]], default=None) -> Column:
    """Ordered CASE: value of the first rule whose condition holds."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def group1(text: Column, pattern: str, idx: int = 1) -> Column:
    """Capture group of the first match, NULL when nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, idx), F.lit(""))


def to_long(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def div_ceil(value: Column, by: int) -> Column:
    return F.ceil(value.cast("double") / by).cast("int")
