"""Canonical exact digests of documents, with byte comparison inside equal buckets.

A text's canonical form is Unicode NFKC, case folded, NFKC again, with every run of white space as one blank and none
at the ends. Its digest is 128-bit XXH3. Rows whose digests are equal are compared by bytes: grouping by digest and
canonical bytes merges copies before the shuffle, so a group of any size costs a row a task. Should one digest hold
several byte strings, each gets the digest and its rank among them.

Nulls count as empty text; ids that are null sort first; repeated ids are ordered by text; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import null_safe_key, written


def canonical(text: str) -> bytes:
    """The bytes whose equality makes two texts the same."""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the following text's first."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(canonical(t or "")) for t in batch.column(1).to_pylist()], pa.string())], ["k", "digest"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, digest) of every row; k is the id with null as the least long."""
    return docs.select(null_safe_key(F.col(id_col)).alias("k"), F.col(text_col).cast("string")).mapInArrow(_digests, "k long, digest string")


def _range_bucket(column: Column, splits: list[int]) -> Column:
    """How many of the ascending splits are at most ``column``: a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column < F.lit(splits[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(splits))


#: Kinds of row in the ordered stream: a note that a digest occurs elsewhere too, a document, the next block's first one.
_NOTE, _DOC, _NEXT = 0, 1, 2
_STREAM = "doc_id long, n_chars long, digest string, canon binary, edited_sha256 string, edited_digest string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, kind = _NEXT last, k, kind, text): each document meets its follower."""
    noted: dict[int, set[str]] = {}
    held = None  # (bucket, doc_id, text, canonical, digest, noted)
    out: list[tuple] = []

    def emit(following: str, canon_next: bytes) -> None:
        _, doc_id, text, canon, own, is_noted = held
        edited = edited_text(text, following)
        canon_edited = canonical(edited)
        out.append((doc_id, len(text), own, canon if is_noted else None, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(canon_edited), float(canon == canon_edited), float(canon == canon_next)))

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("digest", pa.string()), ("canon", pa.binary()), ("edited_sha256", pa.string()), ("edited_digest", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    for batch in batches:
        for bucket, kind, k, doc_id, text, note in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if kind == _NOTE:
                if k not in noted:
                    noted.clear()
                noted.setdefault(k, set()).add(note)
                continue
            text = text or ""
            canon = canonical(text)
            if held:
                if held[0] != bucket:
                    raise ValueError("a block ended without its follower")
                emit(text, canon)
            own = digest(canon)
            held = (bucket, doc_id, text, canon, own, own in noted.get(k, ())) if kind == _DOC else None
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
            out.clear()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """(doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next) of every document.

    The edited text ends with the next document's start, so texts are dealt once into ``blocks`` ranges of ids; each
    block also gets the first document of the next one. Likeness is 1 for equal canonical bytes and 0 otherwise.
    """
    spark = docs.sparkSession
    rows = docs.select(null_safe_key(F.col(id_col)).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pass1 = written(digests(docs, id_col, text_col), "fp-digest")
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = sorted({int(x) for x in pass1.approxQuantile("k", [i / blocks for i in range(1, blocks)], 0.2 / blocks)}) if blocks > 1 else []
    bucket = _range_bucket(F.col("k"), splits).alias("bucket")

    firsts = pass1.groupBy(bucket).agg(F.min("k").alias("k")).orderBy("bucket").collect()  # a row a block
    if not firsts:
        firsts = []
    follows = [(firsts[(i + 1) % len(firsts)]["k"], r["bucket"]) for i, r in enumerate(firsts)]
    to_block = spark.createDataFrame(follows, "k long, bucket int")
    carried = rows.filter(F.col("k").isin([k for k, _ in follows])).groupBy("k").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    carried = carried.join(F.broadcast(to_block), "k").select("bucket", F.lit(_NEXT).alias("kind"), "k", F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("note"))

    repeated = pass1.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    hot = repeated.filter("n >= 64").orderBy(F.desc("n"), "digest").limit(1000)
    notes = pass1.join(F.broadcast(hot.select("digest")), "digest", "left_semi").unionByName(pass1.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(repeated.select("digest"), "digest", "left_semi"))
    notes = notes.select(bucket, F.lit(_NOTE).alias("kind"), "k", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.col("digest").alias("note"))

    stream = rows.select(bucket, F.lit(_DOC).alias("kind"), "k", "doc_id", "text", F.lit(None).cast("string").alias("note")).unionByName(carried).unionByName(notes)
    stream = stream.repartitionByRange(blocks, "bucket").sortWithinPartitions("bucket", F.col("kind") == _NEXT, "k", "kind", "text")
    found = written(stream.mapInArrow(_walk, _STREAM), "fp-stream")

    # Copies meet as one row a task here; several byte strings under one digest are numbered in byte order.
    variants = found.filter("canon is not null").groupBy("digest", "canon").agg(F.count("*").alias("n"))
    several = variants.groupBy("digest").agg(F.count("*").alias("kinds"), F.array_sort(F.collect_set("canon")).alias("all")).filter("kinds > 1")
    ranks = written(several.select("digest", F.posexplode("all").alias("rank", "canon")), "fp-rank")
    out = found.join(ranks, ["digest", "canon"], "left") if ranks.limit(1).count() else found.withColumn("rank", F.lit(None).cast("int"))
    return out.select("doc_id", "n_chars", F.concat_ws("-", "digest", F.col("rank").cast("string")).alias("fingerprint"), "edited_sha256", F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")
