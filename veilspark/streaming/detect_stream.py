"""Detection and encoding of streams of documents.

Detection and encoding look at one row at a time, so they run on a stream as they are. Only the mapping grows: each batch's
new originals are added by a single writer in foreachBatch, as a delta of its own beside what is there, so that writing costs
a batch its new entries only. With each delta goes the highest number that each label has had, so numbers of entries that
are removed later are never given again, also after a restart. Every COMPACT_AFTER deltas become one base, and what a base
replaces is removed one compaction later, when no running batch reads it any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import mapping as m
from ..operators import resolve, substitute
from ..plans.pipeline import accepted
from ..storage import dropped, written

#: So many deltas are made one base.
COMPACT_AFTER = 50
COUNTERS = "label string, n int"


def entities(stream: DataFrame, *ids: str) -> DataFrame:
    """Entity rows of a stream of documents (append mode, no state)."""
    return resolve.entity_rows(resolve.detect(stream), *ids)


class MappingStore:
    """A mapping in a folder: base-N holds all up to batch N, delta-N what batch N added, counters-N the highest numbers of
    labels up to then. Only folders that were written whole count."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._hadoop("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self, kind: str) -> list[int]:
        if not self.fs.exists(self._hadoop("")):
            return []
        names = [p.getPath().getName() for p in self.fs.listStatus(self._hadoop(""))]
        return sorted(int(n.rsplit("-", 1)[1]) for n in names if n.startswith(f"{kind}-") and self.fs.exists(self._hadoop(f"{n}/_SUCCESS")))

    def name(self, kind: str, number: int) -> str:
        return f"{kind}-{number:012d}"

    def _read(self, schema: str, names: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def mapping(self, before: int | None = None) -> DataFrame:
        """All entries, or those of batches before one."""
        below = lambda kind: [n for n in self.numbers(kind) if before is None or n < before]
        bases = below("base")[-1:]
        deltas = [n for n in below("delta") if not bases or n > bases[0]]
        return self._read(m.SCHEMA, [self.name("base", n) for n in bases] + [self.name("delta", n) for n in deltas])

    def counters(self, before: int | None = None) -> DataFrame:
        last = [n for n in self.numbers("counters") if before is None or n < before][-1:]
        return self._read(COUNTERS, [self.name("counters", n) for n in last])

    def add(self, number: int, items: DataFrame) -> DataFrame:
        """The mapping with batch ``number``'s new originals; a batch that is repeated finds its own delta."""
        if number not in self.numbers("counters"):
            base, kept = self.mapping(number), self.counters(number)
            delta = f"{self.path}/{self.name('delta', number)}"
            if number not in self.numbers("delta"):
                m.additions(base, items, kept).write.mode("overwrite").parquet(delta)
            added = self.spark.read.schema(m.SCHEMA).parquet(delta)
            # A store without counters yet tells them by its entries.
            seen = added if self.numbers("counters") else base.unionByName(added)
            m.counters(seen, kept).select("label", F.col("n").cast("int").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{self.name('counters', number)}")
        return self.mapping(number + 1)

    def compact(self, number: int) -> None:
        """Makes one base of all up to batch ``number``, and removes what the base before it replaced."""
        bases = self.numbers("base")
        if len([n for n in self.numbers("delta") if not bases or n > bases[-1]]) < COMPACT_AFTER:
            return
        self.mapping(number + 1).write.mode("overwrite").parquet(f"{self.path}/{self.name('base', number)}")
        for base in bases[-1:]:
            for kind in ("base", "delta", "counters"):
                for n in self.numbers(kind):
                    if n < base or (n == base and kind == "delta"):
                        self.fs.delete(self._hadoop(self.name(kind, n)), True)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The mapping as it stands."""
    return MappingStore(spark, path).mapping()


def pseudonymize(stream: DataFrame, mapping_path: str, output_path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Encoded documents as Parquet, a folder a batch, so a batch that is repeated replaces its own output and delta."""

    def batch(docs: DataFrame, number: int) -> None:
        spark = docs.sparkSession
        store = MappingStore(spark, mapping_path)
        found = written(resolve.detect(docs, text_col=text_col), "stream")
        grown = store.add(number, m.from_entities(accepted(resolve.entity_rows(found, id_col))))
        substitute.encode(found.drop("entities"), grown, text_col).write.mode("overwrite").parquet(f"{output_path}/batch-{number:012d}")
        store.compact(number)
        dropped(found)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
