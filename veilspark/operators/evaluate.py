"""Precision, recall and F1 of predicted entities against gold ones, by (category, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: tp (gold rows that are predicted), fp, fn, precision, recall, f1. Empty denominators give 1."""
    keys = ["category", "text"]
    tp = gold.join(predicted.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("tp"))
    counts = tp.join(predicted.agg(F.count("*").alias("p"))).join(gold.agg(F.count("*").alias("g")))  # single rows
    counts = counts.withColumn("fp", F.greatest(F.col("p") - F.col("tp"), F.lit(0))).withColumn("fn", F.greatest(F.col("g") - F.col("tp"), F.lit(0)))
    ratio = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(1.0)
    counts = counts.withColumn("precision", ratio("fp")).withColumn("recall", ratio("fn"))
    total = F.col("precision") + F.col("recall")
    return counts.select("tp", "fp", "fn", "precision", "recall", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0).alias("f1"))
