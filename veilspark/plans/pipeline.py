"""Whole queries: detect, map, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mapping as m
from ..operators import resolve, substitute
from ..operators.rules import Passes
from ..storage import written


#: Rows of one task of a detection, some milliseconds each at most.
SPREAD_ROWS = 20_000


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over at least as many partitions as there are cores, and as their rows need: detection is all computation."""
    spark = docs.sparkSession
    # Short rows that long texts are made of give few bytes, so few partitions by size: their number counts (of files, from footers).
    wanted, files = max(spark.sparkContext.defaultParallelism, -(-docs.count() // SPREAD_ROWS)), docs.inputFiles()
    # A file gives at least one partition; only where there are too few files, rows are dealt out.
    return docs.repartition(wanted) if len(files) < wanted else docs


def detect(docs: DataFrame, passes: Passes | None = None, text_col: str = "text", ner_col: str | None = None) -> DataFrame:
    return resolve.detect(docs, passes, text_col, ner_col)


def accepted(rows: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Entity rows that a review would have ticked beforehand."""
    return rows.filter(F.col("confidence") >= threshold)


def pseudonymize(docs: DataFrame, mapping: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", passes: Passes | None = None) -> tuple[DataFrame, DataFrame]:
    """(encoded documents with entities and replacements_made, the grown mapping). Detection, the dear part, and the mapping
    run once: both are written to the shared folder and read from there."""
    spark = docs.sparkSession
    found = written(detect(docs, passes, text_col), "detected")
    rows = accepted(resolve.entity_rows(found, id_col))
    grown = written(m.add_bulk(mapping if mapping is not None else m.empty(spark), m.from_entities(rows)), "mapping")
    return substitute.encode(found, grown, text_col), grown
