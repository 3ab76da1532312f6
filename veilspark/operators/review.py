"""Review of found entities: what a person ticked, left out or wrote over, merged with what was detected and what is stored.

Detected entities are (entity, category, confidence); reviews are (entity, checked, text, category, surrogate), where blank or
null overrides keep what was detected; the stored mapping is as in ``mapping``. Everything is grouped by key, once by the
detected text and once by the text after the review, with sums that merge before the shuffle; no list of a key is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mapping as m

#: Entities of at least this confidence are ticked where no review says otherwise.
TICKED = 0.75


def _given(column: str) -> Column:
    return F.when(F.trim(column) != "", F.trim(column))


def projected(detected: DataFrame, reviews: DataFrame, threshold: float = TICKED) -> DataFrame:
    """(original, category, surrogate, reviewed): the entries that result, one a detected text (in any case): ticked ones, with
    the overrides. Of several detected forms the surest counts (then the first by bytes), of several reviews of one text the
    greatest; reviews of what wasn't detected add entries of their own if they are ticked and have a category."""
    kinds = "entity string, category string, confidence double, checked boolean, text string, new_category string, surrogate string"
    found = detected.select("entity", "category", "confidence", *[F.lit(None).cast(t).alias(n) for n, t in (f.split(" ") for f in kinds.split(", ")[3:])], F.lit(False).alias("review"))
    said = reviews.select("entity", F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("confidence"), "checked", _given("text").alias("text"), _given("category").alias("new_category"), _given("surrogate").alias("surrogate"), F.lit(True).alias("review"))
    rows = found.unionByName(said).filter("entity IS NOT NULL")
    surest = F.min(F.when(~F.col("review"), F.struct((-F.col("confidence")).alias("c"), "entity", "category"))).alias("d")
    greatest = F.max(F.when(F.col("review"), F.struct(F.coalesce("checked", F.lit(False)).alias("checked"), "text", "new_category", "surrogate", "entity"))).alias("r")
    by_text = rows.groupBy(F.lower("entity").alias("key")).agg(surest, greatest)
    ticked = by_text.filter(F.coalesce("r.checked", -F.col("d.c") >= threshold))
    out = ticked.select(F.coalesce("r.text", "d.entity", "r.entity").alias("original"), F.coalesce("r.new_category", "d.category").alias("category"), F.col("r.surrogate").alias("surrogate"), F.col("r").isNotNull().alias("reviewed"))
    return out.filter("category IS NOT NULL")


def merged(stored: DataFrame, items: DataFrame) -> DataFrame:
    """One row a key (lower original) of the stored mapping and projected items: original, category, surrogate, origin
    (stored, reviewed, detected) and conflict, which lists where others of the key differ from what counts.

    What is stored counts first, then reviewed items, then detected ones; of equals the least by bytes."""
    rows = stored.select("original", "category", "surrogate", F.lit(0).alias("rank")).unionByName(items.select("original", "category", "surrogate", F.when(F.col("reviewed"), 1).otherwise(2).alias("rank")))
    first = F.min(F.struct("rank", "original", "category", "surrogate")).alias("x")
    spread = lambda c: F.min(c) != F.max(c)
    by_key = rows.groupBy(F.lower("original").alias("key")).agg(first, spread("category").alias("c"), spread("surrogate").alias("s"))
    conflict = F.concat_ws(",", F.when(F.col("c"), "category"), F.when(F.col("s"), "surrogate"))
    origin = F.element_at(F.array(F.lit("stored"), F.lit("reviewed"), F.lit("detected")), F.col("x.rank") + 1)
    return by_key.select("x.original", "x.category", "x.surrogate", origin.alias("origin"), F.when(conflict != "", conflict).alias("conflict"))


def grown(stored: DataFrame, detected: DataFrame, reviews: DataFrame, threshold: float = TICKED) -> DataFrame:
    """The mapping with the entries that the review adds; stored ones are left as they are, blank surrogates numbered."""
    new = merged(stored, projected(detected, reviews, threshold)).filter("origin <> 'stored'")
    return m.add_bulk(stored, new.select("original", "category", "surrogate", F.concat(F.when(F.col("origin") == "reviewed", "0").otherwise("1"), F.lower("original")).alias("position")))
