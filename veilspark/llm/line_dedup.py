"""Line dedup by site-relative frequency, as DataFrame expressions.

A line is boilerplate on a site if it stands on at least MIN_PAGES of the site's pages and on more than RATIO of them;
boilerplate lines are dropped from every page of that site. Lines are compared without white space at their ends; blank
lines are never counted or dropped. Sites are counted by hashes first (eight bytes a line, merged before the shuffle);
only lines that pass are then counted by their text, so a hash collision changes nothing.

Null text stays null; pages of a null site form one site; repeated rows count as pages each; an empty table gives no
rows; other columns pass through (columns n_lines and n_dropped are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

RATIO = 0.1
MIN_PAGES = 10
SPACES = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def boilerplate(pages: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, line, pages, site_pages) of the boilerplate lines; fewer than lines a page / ratio for a site."""
    rows = pages.select(F.coalesce(F.col(site_col).cast("string"), F.lit("\x00")).alias("site"), F.expr(f"array_distinct(filter(transform(split(cast({text_col} AS string), chr(10), -1), l -> btrim(l, {SPACES})), l -> l <> ''))").alias("lines"))
    totals = written(rows.groupBy("site").agg(F.count("*").alias("site_pages")), "line-sites")
    hashed = rows.select("site", F.explode(F.expr("transform(lines, l -> xxhash64(l))")).alias("h"))
    often = hashed.groupBy("site", "h").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    likely = written(often.join(totals, "site").filter(F.col("pages") > ratio * F.col("site_pages")).select("site", "h"), "line-likely")
    lines = rows.select("site", F.explode("lines").alias("line")).withColumn("h", F.xxhash64("line"))
    exact = lines.join(likely, ["site", "h"], "left_semi").groupBy("site", "line").agg(F.count("*").alias("pages"))
    return exact.join(totals, "site").filter((F.col("pages") >= min_pages) & (F.col("pages") > ratio * F.col("site_pages")))


def dedup_lines(pages: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` without boilerplate lines in the text column, and with n_lines and n_dropped (long)."""
    found = boilerplate(pages, site_col, text_col, ratio, min_pages)
    # Written, so the optimizer knows its size: a small one is broadcast, a large one joined by shuffles that split hot sites.
    per_site = written(found.groupBy("site").agg(F.collect_set("line").alias("__drop")), "line-boilerplate").withColumnRenamed("site", "__site")
    columns = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    out = pages.select(*columns, F.coalesce(F.col(site_col).cast("string"), F.lit("\x00")).alias("__site")).join(per_site, "__site", "left")
    out = out.withColumn("__lines", F.expr(f"split(cast({text_col} AS string), chr(10), -1)"))
    out = out.withColumn("__kept", F.expr(f"CASE WHEN __drop IS NULL THEN __lines ELSE filter(__lines, l -> NOT array_contains(__drop, btrim(l, {SPACES}))) END"))
    text = F.expr(f"CASE WHEN size(__kept) < size(__lines) THEN array_join(__kept, chr(10)) ELSE cast({text_col} AS string) END")
    return out.select(*[text.alias(c) if c == text_col else c for c in columns], F.expr("cast(coalesce(size(__lines), 0) AS bigint)").alias("n_lines"), F.expr("cast(coalesce(size(__lines) - size(__kept), 0) AS bigint)").alias("n_dropped"))
