"""Tables in the folder that driver and executors share, and row numbers that no single task hands out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a new local one in local mode (tests); a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_veilspark_shared", None)
        if not path:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = spark._veilspark_shared = "file://" + tempfile.mkdtemp(prefix="veilspark-")
    return path.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, so lost executors cost no recomputation, and the
    optimizer knows its size."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Removes the files of a ``written`` table that nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def numbered(rows: DataFrame, key: str, order: Sequence[str], out: str) -> DataFrame:
    """``rows`` with the row number (long, from 1) within ``key`` by ``order``, whatever the size of a key.

    Rows are dealt out by ranges of key and order and numbered within each range; a range's first number is what the
    ranges before it hold, a table of one row a range and key. ``order`` should be total; equal rows are numbered anyhow.
    """
    ranges = written(rows.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()), "numbered")
    counts = ranges.groupBy(key, "__range").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__before", before).drop("__c")
    inside = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*order))
    return ranges.withColumn("__n", inside).join(starts, [key, "__range"]).withColumn(out, F.col("__n") + F.col("__before")).drop("__n", "__before", "__range")
