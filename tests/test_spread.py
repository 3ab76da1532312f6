"""What detection computes once, and how its rows are dealt out."""

from pyspark.sql import functions as F

from veilspark.operators import resolve
from veilspark.operators.rules import Passes, rules
from veilspark.plans.pipeline import SPREAD_ROWS, spread


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_extract_all(")


def test_candidates_that_are_exploded_are_found_once(spark):
    docs = spark.createDataFrame([(1, "Zürich, Zürich")], "id long, text string").repartition(2)
    passes = Passes(tuple(r for r in rules() if r.id == "place"))
    found = resolve.candidates(docs, passes)
    rows = found.select("id", F.explode("__all").alias("x"))
    fields = rows.select("id", F.col("x.cat").alias("cat"), F.col("x.t").alias("t"), F.expr("x.offs[0].s AS s"))
    assert _scans(fields) == _scans(found) > 0
    assert fields.collect() == [(1, "ort", "Zürich", 0)]


def test_many_short_rows_make_many_tasks(spark, tmp_path):
    spark.range(10 * SPREAD_ROWS).coalesce(1).write.parquet(str(tmp_path / "rows"))
    dealt = spread(spark.read.parquet(str(tmp_path / "rows")).withColumn("text", F.col("id").cast("string")))
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 10 * SPREAD_ROWS and max(sizes) < 1.1 * SPREAD_ROWS
