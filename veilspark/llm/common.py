"""Pieces that several operators share: skew-safe joins, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, new_folder, shared_dir, written  # noqa: F401

#: At most this many keys are broadcast as hot; all other keys hold fewer rows than each of these.
HOT_KEYS = 1000
#: Keys with fewer rows than this are never treated as hot.
HOT_ROWS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_keys(per_key: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """The heaviest keys, at most HOT_KEYS of them whatever the input's size."""
    return per_key.filter(F.col(weight) >= HOT_ROWS).orderBy(F.desc(weight), *keys).limit(HOT_KEYS)


def join_per_key(left: DataFrame, per_key: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``per_key``, which has one row a key and the number of left rows in ``weight``.

    The heaviest keys (HOT_KEYS at most) are joined by broadcast, so no task gets all rows of a hot key; all others
    by an ordinary join. ``left`` should be cheap to read twice. ``how`` is inner or left.
    """
    hot = hot_keys(per_key, keys, weight)
    names = hot.select(*keys)
    with_hot = left.join(F.broadcast(hot), keys, "inner")
    rest = left.join(F.broadcast(names), keys, "left_anti").join(per_key, keys, how)
    return with_hot.unionByName(rest.select(*with_hot.columns))


#: Bits of a key filter: 4 MB whatever the number of keys. Many more keys than that make it let more rows pass, no less.
FILTER_BITS = 1 << 25


def likely_in(left: DataFrame, right: DataFrame, keys: list[str], left_keys: list[str] | None = None, mark: str | None = None) -> DataFrame:
    """``left`` without most rows whose keys don't occur in ``right``: a bitmap of hashed keys, of bounded size, is broadcast.
    With ``mark``, all rows, and a column of that name tells which would be left.

    Used in front of a join that would deal out all of a wide table for a few of its rows.
    """
    place = lambda names: F.pmod(F.xxhash64(*names), F.lit(FILTER_BITS)) + 1
    bits = right.select(place(keys).alias("x")).select(F.bitmap_bucket_number("x").alias("__bucket"), F.bitmap_bit_position("x").alias("bit"))
    maps = bits.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("bit").alias("m"))
    # As longs of eight bytes each: a row's test then reads one of them, where binary would be copied whole for every row.
    longs = "transform(sequence(0, length(m) DIV 8 - 1), i -> cast(conv(hex(substring(m, cast(i * 8 + 1 AS int), 8)), 16, -10) AS bigint))"
    maps = maps.select("__bucket", F.expr(longs).alias("__map"))
    rows = left.withColumn("__x", place(left_keys or keys)).withColumn("__bucket", F.bitmap_bucket_number("__x")).withColumn("__x", F.bitmap_bit_position("__x")).join(F.broadcast(maps), "__bucket", "left")
    inside = F.expr("coalesce((shiftright(element_at(__map, cast(__x DIV 64 AS int) + 1), cast((7 - (__x DIV 8) % 8) * 8 + __x % 8 AS int)) & 1) = 1, false)")
    return (rows.withColumn(mark, inside) if mark else rows.filter(inside)).drop("__x", "__bucket", "__map")


def null_safe_key(column: Column) -> Column:
    """A long that orders rows with a null id first."""
    return F.coalesce(column.cast("long"), F.lit(-(2**63)))


def components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` over long ids: (node, component), component = least id in it.

    Alternating large-star and small-star steps; every step groups with partial aggregation, hot nodes are joined
    by broadcast of a bounded number of them, and each round's edges are a written table.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    now = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("deg"))
        large = join_per_key(both, least, ["u"], "deg").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = written(large.distinct(), tag)
        dropped(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))
        joined = join_per_key(large, least, ["u"], "deg")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct(), tag)
        dropped(large)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == tuple(seen):
            break
        state = tuple(seen)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
