"""The mapping of originals to surrogates: a keyed table and its upkeep.

A mapping has the columns id, original, surrogate, category, confirmed; its key is lower(original). Ids are digests of the
key, so repeated tasks give the same ones. Labels are numbered by category: after the highest number that a category's
surrogates have (or had, where a table of counters is given), in order of arrival, leaving out numbers in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..storage import numbered

SCHEMA = "id string, original string, surrogate string, category string, confirmed boolean"


class EntryNotFound(KeyError):
    """No entry has the id."""


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def category_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lexicon.CATEGORIES, "category string, label string, priority int")


def label(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in lexicon.LABELS.items() for x in pair]), category)


def entry_id(original: Column) -> Column:
    return F.substring(F.sha2(F.lower(original), 256), 1, 32)


def counters(mapping: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(label, n): the highest number in a category's own surrogates, or in ``kept`` (label, n) if that is higher."""
    number = F.expr("try_cast(substring(surrogate, length(label) + 2) AS int)")
    found = mapping.withColumn("label", label(F.col("category"))).filter(F.expr("startswith(surrogate, concat(label, '-')) AND substring(surrogate, length(label) + 2) rlike '^[0-9]+$'")).select("label", number.alias("n"))
    if kept is not None:
        found = found.unionByName(kept.select("label", "n"))
    return found.filter("n IS NOT NULL").groupBy("label").agg(F.max("n").alias("n"))


def next_labels(mapping: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(category, surrogate) that the next entry of each category would get."""
    spark = mapping.sparkSession
    # Counters hold the highest number of a category's own entries; entries of other categories may have taken the next ones.
    cats = category_dim(spark).join(counters(mapping, kept), "label", "left").select("category", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    taken = mapping.select(F.regexp_extract("surrogate", "^(.*)-([0-9]+)$", 1).alias("label"), F.expr("try_cast(regexp_extract(surrogate, '^(.*)-([0-9]+)$', 2) AS bigint)").alias("k"), "surrogate").filter("k IS NOT NULL AND surrogate = concat(label, '-', k)").select("label", "k").distinct()
    above = numbered(taken.join(F.broadcast(cats), "label").filter("k > n"), "label", ["k"], "j")
    # The first j whose number isn't n + j is free.
    run = above.groupBy("label").agg(F.min(F.when(F.col("k") != F.col("n") + F.col("j"), F.col("j"))).alias("gap"), F.count("*").alias("c"))
    free = cats.join(run, "label", "left").withColumn("k", F.col("n") + F.coalesce("gap", F.col("c") + 1, F.lit(1)))
    return free.select("category", F.concat_ws("-", "label", F.col("k").cast("string")).alias("surrogate"))


def add_bulk(mapping: DataFrame, items: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """The mapping with new entries of ``items`` (original, category, surrogate or null, position): an original that is
    there, in any case, is left as it is; of several new ones the first counts. Blank surrogates are numbered."""
    return mapping.unionByName(additions(mapping, items, kept))


def additions(mapping: DataFrame, items: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """The entries that ``add_bulk`` adds."""
    first = Window.partitionBy(F.lower("original")).orderBy("position")
    fresh = items.filter("original IS NOT NULL").withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    fresh = fresh.join(mapping.select(F.lower("original").alias("__key")).distinct(), F.lower("original") == F.col("__key"), "left_anti")
    given = fresh.filter("trim(coalesce(surrogate, '')) <> ''").withColumn("surrogate", F.trim("surrogate"))
    blank = fresh.filter("trim(coalesce(surrogate, '')) = ''").withColumn("label", label(F.col("category")))
    # Numbers in use: of the mapping and of surrogates given by hand in this batch.
    used = mapping.select("surrogate").unionByName(given.select("surrogate")).distinct()
    used = used.withColumn("label", F.regexp_extract("surrogate", "^(.*)-([0-9]+)$", 1)).withColumn("k", F.expr("try_cast(regexp_extract(surrogate, '^(.*)-([0-9]+)$', 2) AS int)")).filter("k IS NOT NULL AND surrogate = concat(label, '-', k)")
    start = counters(mapping, kept)
    above = used.join(start, "label", "left").filter("k > coalesce(n, 0)").select("label", "k", F.coalesce("n", F.lit(0)).alias("n"))
    # The i-th new label comes after the j-th taken number if j's place among free numbers lies before i: in the merged
    # order of both, a label's row number is how far above the highest number it stands.
    arrived = numbered(blank.join(start, "label", "left"), "label", ["position", "original"], "i").withColumn("taken", F.lit(0))
    gaps = numbered(above, "label", ["k"], "j").select("label", (F.col("k") - F.col("n") - F.col("j")).alias("i"), F.lit(1).alias("taken"), F.col("k").cast("string").alias("original"))
    free = numbered(arrived.unionByName(gaps, allowMissingColumns=True), "label", ["i", "taken", "original"], "r").filter("taken = 0")
    named = free.withColumn("surrogate", F.concat_ws("-", "label", (F.coalesce("n", F.lit(0)) + F.col("r")).cast("string")))
    new = given.select("original", "surrogate", "category").unionByName(named.select("original", "surrogate", "category"))
    return new.select(entry_id(F.col("original")).alias("id"), "original", "surrogate", "category", F.lit(True).alias("confirmed"))


def import_entries(mapping: DataFrame, entries: DataFrame) -> DataFrame:
    """The mapping with entries whose originals are new; a new original under a known id takes that id's place."""
    keys = mapping.select(F.lower("original").alias("__key")).distinct()
    # The least id of an original, merged before the shuffle however often it comes.
    least = F.min(F.struct("id", *[c for c in mapping.columns if c != "id"])).alias("e")
    fresh = entries.groupBy(F.lower("original").alias("__low")).agg(least).join(keys, F.col("__low") == F.col("__key"), "left_anti").select("e.*")
    return mapping.join(fresh.select("id").distinct(), "id", "left_anti").unionByName(fresh.select(mapping.columns))


def update(mapping: DataFrame, patches: DataFrame) -> DataFrame:
    """The mapping with ``patches`` (id, surrogate, category, confirmed; null: as it was). Unknown ids raise."""
    missing = patches.join(mapping, "id", "left_anti").limit(1).collect()
    if missing:
        raise EntryNotFound(missing[0]["id"])
    p = patches.select("id", *[F.col(c).alias(f"__{c}") for c in ("surrogate", "category", "confirmed")])
    return mapping.join(p, "id", "left").select("id", "original", *[F.coalesce(f"__{c}", c).alias(c) for c in ("surrogate", "category", "confirmed")])


def remove(mapping: DataFrame, ids: DataFrame) -> DataFrame:
    missing = ids.join(mapping, "id", "left_anti").limit(1).collect()
    if missing:
        raise EntryNotFound(missing[0]["id"])
    return mapping.join(ids.select("id").distinct(), "id", "left_anti")


def listed(mapping: DataFrame) -> DataFrame:
    return mapping.orderBy(F.lower("original"), "id")


def from_entities(rows: DataFrame) -> DataFrame:
    """Items for add_bulk of entity rows (entity, category): one an original, in alphabetical order of arrival."""
    items = rows.groupBy(F.col("entity").alias("original")).agg(F.min("category").alias("category"))
    return items.select("original", "category", F.lit(None).cast("string").alias("surrogate"), F.lower("original").alias("position"))


#: Entries of one document of a saved mapping.
DOCUMENT_ENTRIES = 10_000


def save(mapping: DataFrame, path: str, field: str = "surrogate") -> None:
    """JSON documents, one a line, of DOCUMENT_ENTRIES entries or so: version, created_at (days), entries by lower(original).
    ``field`` names the surrogate. A small mapping is one document."""
    parts = max(1, -(-mapping.count() // DOCUMENT_ENTRIES))
    entry = F.struct("id", "original", F.col("surrogate").alias(field), "category", "confirmed")
    dealt = mapping.select(F.pmod(F.xxhash64(F.lower("original")), F.lit(parts)).alias("part"), F.struct(F.lower("original").alias("k"), entry.alias("e")).alias("x"))
    documents = dealt.groupBy("part").agg(F.array_sort(F.collect_list("x")).alias("x"))
    made = documents.select(F.lit(1).alias("version"), F.concat(F.lit("unix:"), F.unix_date(F.current_date()).cast("string")).alias("created_at"), F.transform("x", lambda y: y["e"]).alias("entries"))
    made.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load(spark: SparkSession, path: str, field: str = "surrogate", pretty: bool = False) -> DataFrame:
    """The mapping that documents hold; the version is not looked at. ``pretty``: one document a file, over many lines."""
    schema = f"version int, created_at string, entries array<struct<id: string, original: string, `{field}`: string, category: string, confirmed: boolean>>"
    rows = spark.read.schema(schema).option("multiLine", str(pretty).lower()).json(path).select(F.explode("entries").alias("e"))
    return rows.select("e.id", "e.original", F.col("e")[field].alias("surrogate"), "e.category", "e.confirmed")


def load_or_empty(spark: SparkSession, path: str, field: str = "surrogate", pretty: bool = False) -> DataFrame:
    """The mapping saved at ``path``, through the rules of an import; an empty one where nothing is there (a first start)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return empty(spark)
    return import_entries(empty(spark), load(spark, path, field, pretty))


def reset(spark: SparkSession, path: str) -> bool:
    """Removes a saved mapping; whether there was one. Only a folder of JSON documents or a single one is removed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return False
    if store.getFileStatus(at).isDirectory():
        names = [f.getPath().getName() for f in store.listStatus(at)]
        if not all(n.endswith(".json") or n.startswith(("_", ".")) for n in names):
            raise ValueError(f"{path!r} holds more than a saved mapping")
    return bool(store.delete(at, True))
