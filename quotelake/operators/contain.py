"""Containment join: which needle names occur inside which texts.

A theta join on ``contains`` would compare every text with every needle. Instead each needle is anchored at the rarest
of its short substrings (grams): the one that the fewest needles hold. Texts are read in slices that overlap by the
longest needle, so of a text of any length only small pieces and its marked positions are held at a time. A slice keeps only the positions whose gram is marked in a table of the anchors' hashes, a
value of fixed size. Those positions meet the anchors by an equality join
on the gram, the piece at the anchor's offset with the needle's length is cut out, and the pieces meet the needles by
an equality join. Longest needle, gram lengths and marks are one scalar subquery: building the plan runs no job. Many needles fill the marks, so that
most positions pass: a caller that knows its needles to be few enough for every executor (:func:`few_enough`) has them
broadcast, so that positions and pieces stay in their task and only pieces that are a needle are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4
#: Characters of the outer slices; the inner ones are cut out of them.
LONG = 1 << 16
#: Characters of a slice; cutting a gram out of it takes time in proportion.
SLICE = 64
#: Marks of the table of anchors' hashes; a full one only means that more positions reach the join.
MARKS = 1 << 15
#: Needles of up to this many characters in all, each counted with 64 more for its row, are few enough for a broadcast.
FEW_CHARACTERS = 64 << 20


def anchors(needles: DataFrame, needle: str, keys: list[str], gram: int = GRAM) -> DataFrame:
    """(keys, _needle, _gram, _offset): one gram for each needle, the one held by the fewest needles, last on ties."""
    distinct = needles.select(*keys, F.col(needle).alias("_needle")).where(F.length("_needle") > 0).distinct()
    size = F.least(F.lit(gram), F.length("_needle"))
    grams = distinct.withColumn("_offset", F.explode(F.sequence(F.lit(0), F.length("_needle") - size))).withColumn(
        "_gram", F.substring(F.col("_needle"), F.col("_offset") + 1, size))
    held = grams.select(*keys, "_needle", "_gram").distinct().groupBy(*keys, "_gram").agg(F.count("*").alias("_held"))
    best = grams.join(held, [*keys, "_gram"]).groupBy(*keys, "_needle").agg(
        F.min(F.struct("_held", (-F.col("_offset")).alias("_back"), "_gram")).alias("_best"))
    return best.select(*keys, "_needle", "_best._gram", (-F.col("_best._back")).alias("_offset"))


def _slot(gram: Column) -> Column:
    return F.pmod(F.hash(gram), F.lit(MARKS))


def _outline(found: DataFrame) -> Column:
    """Longest needle, gram lengths and the table of marks of all anchors, as one value."""
    slots = found.groupBy(_slot(F.col("_gram")).cast("long").alias("id")).agg(
        F.max(F.length("_needle")).alias("longest"), F.collect_set(F.length("_gram")).alias("grams"))
    every = found.sparkSession.range(MARKS).join(slots, "id", "left")
    marks = F.transform(F.sort_array(F.collect_list(F.struct("id", F.col("longest").isNotNull().alias("set")))), lambda m: m["set"])
    return every.agg(
        F.max("longest").alias("longest"), F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams"), marks.alias("marks"),
    ).select(F.struct("longest", "grams", "marks").alias("outline")).scalar()


def _sliced(texts: DataFrame, size: int) -> DataFrame:
    """Texts in slices that overlap by all but one character of the longest needle (and of one slice more)."""
    parts = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    more = F.ceil((F.col("_longest") - 1) / size).cast("int")
    after = lambda i: F.substring(F.array_join(F.slice("_parts", i + 2, F.col("_more")), ""), F.lit(1), F.col("_longest") - 1)
    whole = F.transform("_parts", lambda part, i: F.concat(part, after(i)))
    staged = texts.withColumn("_parts", parts).withColumn("_more", more)
    return staged.withColumn("_slice", F.explode(whole)).drop("_parts", "_more", "_text").withColumnRenamed("_slice", "_text")


def few_enough(needles: DataFrame, needle_col: str, limit: int = FEW_CHARACTERS) -> bool:
    """Whether the needles fit a broadcast; one small job over them."""
    return needles.agg(F.coalesce(F.sum(F.length(needle_col) + 64), F.lit(0))).first()[0] <= limit


def containment_join(
    texts: DataFrame, text_col: str, needles: DataFrame, needle_col: str, keys: list[str] | None = None,
    keep_text: bool = True, gram: int = GRAM, long: int = LONG, size: int = SLICE, small: bool = False,
) -> DataFrame:
    """Inner join of rows where ``text_col`` contains ``needle_col`` (equal ``keys`` first); ``small`` needles are broadcast.

    Empty needles match nothing; a needle that occurs twice in a text gives one row; null keys match nothing.
    Output: the columns of both sides, without the text when ``keep_text`` is off.
    """
    keys = keys or []
    real = needles.where(F.length(needle_col) > 0)
    found = anchors(real, needle_col, keys, gram)
    near = F.broadcast if small else lambda side: side
    outline = _outline(found)
    ids = [c for c in texts.columns if keep_text or c != text_col]
    # No filter on the text: it may be an expression that would then be evaluated again. Empty ones have no slices.
    cut = texts.select(*ids, F.col(text_col).alias("_text"), outline["longest"].alias("_longest"))
    cut = _sliced(_sliced(cut, long), size)
    cut = cut.withColumn("_grams", outline["grams"]).withColumn("_marks", outline["marks"])
    # One loop over grams and positions; only marked positions become rows of it.
    place = cut.withColumn("_g", F.explode("_grams")).where(F.length("_text") >= F.col("_g")).withColumn(
        "_place", F.explode(F.sequence(F.lit(1), F.length("_text") - F.col("_g") + 1))).withColumn(
        "_gram", F.substring("_text", F.col("_place"), F.col("_g"))).where(
        F.get("_marks", _slot(F.col("_gram"))))
    start = F.greatest(F.col("_place") - F.col("_longest"), F.lit(1))
    hits = place.select(
        *ids, "_gram", (F.col("_place") - start + 1).alias("_at"), F.substring(F.col("_text"), start, F.col("_longest") * 2).alias("_near"))
    shapes = found.select(*keys, "_gram", "_offset", F.length("_needle").alias("_size")).distinct()
    first = F.col("_at") - F.col("_offset")
    pieces = hits.join(near(shapes), [*keys, "_gram"]).where(first >= 1).select(
        *ids, F.substring(F.col("_near"), first, F.col("_size")).alias("_piece"))
    wanted = real.withColumn("_piece", F.col(needle_col))
    if small:  # pieces that are no needle end here, before anything is moved
        pieces = pieces.join(near(wanted.select("_piece").distinct()), "_piece", "left_semi")
    return pieces.distinct().join(near(wanted), [*keys, "_piece"]).drop("_piece")
