"""A corpus pipeline: each stage is a table of documents for the next one.

Every stage takes the columns of documents, ignores others and gives no rows for an empty table. A null or short text has too
few words and goes with the quality rules; null ids, languages and sources are kept as they are. Repeated rows are judged
each by itself until near-dedup keeps one of them; of equal ids with different texts each is a document of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import line_dedup, near_dedup, packing, quality, secret_scan
from veilspark.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; each row is judged by its own text, and goes with its verdict."""
    judged = quality.judged_rows(docs.select(*COLUMNS))
    return judged.filter("kept").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines."""
    return _with_text(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id."""
    return near_dedup.deduplicated(docs.select(*COLUMNS))


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    model = secret_scan.train(secret_scan.labelled_samples(spark))
    found = secret_scan.scan(docs.select(*COLUMNS), model)
    return _with_text(found.withColumn("text", secret_scan.redacted("text", "spans")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of the documents' ids."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("packing", packing_stage),
]

#: SQL can't express the robust estimate, the near-duplicate search or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
