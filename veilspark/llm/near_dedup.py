"""Near-duplicate documents by order MinHash and banded alignment.

A document is its sequence of occurrence-labelled shingles of five words (a document of fewer words is one shingle).
Each of SKETCHES sketches takes the TAKEN labelled shingles of least hash and keeps them in text order, so that two
documents share a sketch the likelier, the smaller their edit distance. Sharing a sketch makes candidates: a sketch's
documents are first paired with its least, its greatest and one pseudo-random member. Candidates are verified by aligning
their shingle sequences within the band that the threshold leaves; similarity is the length of the longest common
subsequence over that of the longer sequence (labelled shingles occur once, so it is a longest increasing run of places).
Where a sketch's documents are still of several classes, the rest is exact: a similarity of at least SIMILARITY needs so
many common shingles that two documents share one of their few rarest (in any order that all documents keep to), so the
documents of all such sketches are paired by their rarest shingles, across classes, and verified as well. How many documents
hold a shingle is counted exactly, so what a growing crowd shares is not among the rarest of a text with words of its own. Classes are the connected components of verified links and of
equal texts.

Equal texts count once until the end, in whatever number. Texts without a word link to none but equal ones. A null text
is an empty one; null ids sort first and stay null; repeated ids are told apart by text; an empty table gives no rows;
``classes`` ignores other columns and ``deduplicated`` returns them.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_per_key, likely_in, null_safe_key, written

WORDS = 5
SIMILARITY = 0.8
#: At similarity 0.8 (Jaccard about 2/3) a sketch of two agrees with probability 0.44, one of sixteen with 0.9999.
SKETCHES, TAKEN = 16, 2
#: Pairs that meet one copy of their common document's text.
SALT_ROWS = 128
#: Bytes of a word that is hashed by itself, and characters of texts that are hashed together.
LONG_WORD, PART_CHARS = 256, 1 << 21
_A = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_SEEDS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _A)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts, where each text's begin and the last one's end); ASCII white space parts words.

    Words are hashed together, eight bytes at a time; the few of more than LONG_WORD bytes one by one."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    blob = b" " + b" ".join(raw) + b" " * 8
    space = _SPACE[np.frombuffer(blob, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(blob) - 7, "<u8", blob, strides=(1,))
    out = _mix(size.astype(np.uint64) * _A)
    at, done = np.flatnonzero(size <= LONG_WORD), 0
    while len(at):
        out[at] = _mix((out[at] ^ (eight[begin[at] + done] & _FIRST_BYTES[np.minimum(size[at] - done, 8)])) * _A)
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(blob[begin[i] : begin[i] + size[i]])
    return out, np.searchsorted(begin, np.cumsum([1, *(len(r) + 1 for r in raw)]))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words."""
    return words_of([text])[0]


def parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts that are hashed together: of bounded size, or one text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > PART_CHARS:
            yield first, i
            first, size = i, 0
        size += len(text)
    if len(texts) > first:
        yield first, len(texts)


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """A hash of every ``size`` consecutive words; of all words if there are fewer."""
    if not len(words):
        return words
    k = min(size, len(words))
    out = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = out * _A + words[i : len(words) - k + 1 + i]
    return _mix(out)


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes with the number of their occurrence mixed in: each value occurs once."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = ordered[1:] == ordered[:-1]
    if not again.any():
        return hashes
    at = np.arange(len(hashes))
    number = np.empty(len(hashes), dtype=np.uint64)
    number[order] = (at - np.maximum.accumulate(np.where(again, 0, at))).astype(np.uint64)
    return np.where(number > 0, _mix(hashes + number * _A), hashes)


def sketches(labels: np.ndarray) -> list[int]:
    """One signed 64-bit value a sketch: its least-hashed labelled shingles, in text order."""
    if not len(labels):
        return []
    taken, out = min(TAKEN, len(labels)), []
    for number, seed in enumerate(_SEEDS):
        drawn = _mix(labels ^ seed)
        places = np.sort(np.argpartition(drawn, taken - 1)[:taken]) if len(labels) > taken else np.arange(taken)
        value = np.uint64(number + 1)
        for h in labels[places]:
            value = _mix(value * _A + h)
        out.append(int(value.astype(np.int64)))
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Common subsequence of labelled shingles over the longer length; 0 where it can't reach ``least``."""
    n = max(len(a), len(b))
    need = least * n - 1e-9
    if min(len(a), len(b)) < need or not n:
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    at = order[at]
    here = np.flatnonzero(b[at] == a)
    there = at[here]
    inside = np.abs(here - there) <= n - need  # the band: an alignment with more gaps falls below
    there = there[inside]
    if len(there) < need:
        return 0.0
    if (np.diff(there) > 0).all():
        length = len(there)
    else:
        tails: list[int] = []
        for place in there.tolist():
            i = bisect.bisect_left(tails, place)
            tails[i : i + 1] = [place]
        length = len(tails)
    return length / n if length >= need else 0.0


def _errstate(function):
    def run(*args):
        with np.errstate(over="ignore"):
            yield from function(*args)

    return run


@_errstate
def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            texts = [t or "" for t in batch.column(2).to_pylist()]
            same = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            bands = []
            for first, end in parts(texts):
                words, upto = words_of(texts[first:end])
                bands += [sketches(labelled(shingles(words[upto[i] : upto[i + 1]]))) for i in range(end - first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["k", "th", "same", "bands"])


@_errstate
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for whole in batches:
        for start in range(0, whole.num_rows, 200):
            batch = whole.slice(start, 200)
            rows = []
            for a, b, text_a, text_b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b not in held:
                    held = {b: labelled(shingles(word_hashes(text_b or "")))}
                found = similarity(labelled(shingles(word_hashes(text_a or ""))), held[b])
                if found:
                    rows.append((a, b, found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, k, th, same, bands) of every row: a written table. row is unique; k and th find the row's text again."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(null_safe_key(F.col(id_col)).alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))
    return written(rows.mapInArrow(_sketched, "k long, th long, same binary, bands array<long>").withColumn("row", F.monotonically_increasing_id()), "nd-sketch")


def candidates(reps: DataFrame) -> DataFrame:
    """Distinct (a, b): a row and a leader of one of its sketches."""
    banded = reps.select("row", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi"), F.min_by("row", F.xxhash64("row", "band")).alias("any")).filter("n > 1")
    leaders = written(leaders.select("band", "n", F.array_distinct(F.array("lo", "hi", "any")).alias("leaders")), "nd-leaders")
    pairs = join_per_key(banded, leaders, ["band"], "n").select(F.col("row").alias("a"), F.explode("leaders").alias("b")).filter("a <> b")
    return written(pairs.distinct(), "nd-pairs")


def texts_of(inside: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, text) of the distinct rows ``inside``: a written table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = written(rows.join(inside, "row", "left_semi").select("row", "k", "th"), "nd-keys")
    texts = docs.select(null_safe_key(F.col(id_col)).alias("k"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    # Joins of texts are by merging at every size: what moves grows with the input, and hot documents come in copies.
    texts = likely_in(texts, keys, ["k", "th"]).join(keys.hint("merge"), ["k", "th"]).select("row", "text")
    found = written(texts, "nd-texts")
    # Rows of one id and text find each other's text, too.
    return written(found.dropDuplicates(["row"]), "nd-texts-once") if keys.count() < found.count() else found


def texts_in(pairs: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, text) of the documents in ``pairs``: a written table."""
    inside = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    return texts_of(inside, rows, docs, id_col, text_col)


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b) of pairs; a document in many pairs comes in several copies, so no task gets all of its pairs."""
    degree = written(pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / SALT_ROWS).cast("int")), "nd-degree")
    salted = join_per_key(pairs, degree, ["b"], "n").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
    ours = salted.join(texts.withColumnsRenamed({"row": "a", "text": "text_a"}).hint("merge"), "a")
    theirs = texts.withColumnsRenamed({"row": "b", "text": "text_b"}).join(degree, "b").select("b", "text_b", F.explode(F.expr("sequence(0, copies - 1)")).alias("salt"))
    return ours.join(theirs.hint("merge"), ["b", "salt"]).select("a", "b", "text_a", "text_b")


@_errstate
def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, row, class, n) for every labelled shingle of each (row, class, text); n is how many the document has."""
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            texts, keys = [t or "" for t in batch.column(2).to_pylist()], [np.zeros(0, np.int64)]
            for first, end in parts(texts):
                words, upto = words_of(texts[first:end])
                keys += [labelled(shingles(words[upto[i] : upto[i + 1]])).astype(np.int64) for i in range(end - first)]
            sizes = np.array([len(k) for k in keys[1:]], dtype=np.int64)
            of = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(of), batch.column(1).take(of), pa.array(np.repeat(sizes, sizes))], ["key", "row", "class", "n"])


def _rarest(labels: DataFrame) -> DataFrame:
    """(key, row, class, n, at) of ``labels`` (key, row, class, n): those of which documents of different classes and at least SIMILARITY
    share one. All documents' shingles are put in one order: first those of one class only, which make no pair, then by the number of
    documents that hold them. A document's first shingles up to a fifth of it and one more do, ``at`` is the place of each; one with
    so many that no other class has is like none there."""
    shared = labels.groupBy("key").agg(F.count("*").alias("rows"), F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi")
    held = join_per_key(labels, written(shared.select("key", "rows"), "nd-shared"), ["key"], "rows")
    listed = held.groupBy("row").agg(F.first("class").alias("class"), F.first("n").alias("n"), F.collect_list(F.struct("rows", "key")).alias("held"))
    least = f"cast(ceil({SIMILARITY}D * n - 1e-9D) AS int)"
    first = listed.filter(f"size(held) >= {least}").selectExpr("row", "class", "n", "n - size(held) AS alone", f"slice(array_sort(held), 1, greatest(size(held) - {least} + 1, 0)) AS held")
    return first.select("row", "class", "n", "alone", F.posexplode("held").alias("i", "x")).select("x.key", "row", "class", "n", F.expr("alone + i + 1 AS at"))


def _pairs_by_key(keyed: DataFrame) -> DataFrame:
    """Distinct (a, b), a > b: all rows of one key and different classes that their lengths allow. A key's rows are cut into
    blocks and every two blocks meet in a group of their own, so no task gets all pairs of a key."""
    blocks = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi")
    blocks = written(blocks.select("key", "rows", F.ceil(F.col("rows") / SALT_ROWS).cast("int").alias("blocks")), "nd-blocks")
    rows = written(join_per_key(keyed, blocks, ["key"], "rows").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")), "nd-blocked")
    one = rows.select("key", F.col("block").alias("x"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("y"), *[F.col(c).alias(f"{c}1") for c in ("row", "class", "n", "at")])
    two = rows.select("key", F.explode(F.expr("sequence(0, block)")).alias("x"), F.col("block").alias("y"), *[F.col(c).alias(f"{c}2") for c in ("row", "class", "n", "at")])
    # Of the shingles that two documents share, the first is followed by all others, so there are at least as many places behind it.
    enough = f"1 + least(n1 - at1, n2 - at2) >= {SIMILARITY} * greatest(n1, n2) - 1e-6"
    met = one.join(two.hint("merge"), ["key", "x", "y"]).filter(f"class1 <> class2 AND (x < y OR row1 < row2) AND {enough}")
    return met.select(F.greatest("row1", "row2").alias("a"), F.least("row1", "row2").alias("b")).distinct()


def open_pairs(reps: DataFrame, compared: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame | None:
    """``texts`` holds those of all documents in ``compared``, so of all that share a sketch. Pairs (a, b) not compared yet, among them all of one sketch that may be alike and aren't of one class; None if there are none."""
    parts = components(links, tag="nd-parts").withColumnRenamed("node", "row")
    banded = reps.select("row", "bands").join(parts, "row", "left").select("row", F.coalesce("component", "row").alias("class"), F.explode("bands").alias("band"))
    banded = written(banded, "nd-classed-bands")
    # Of up to three documents, all pairs have been compared.
    left = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")).filter("n > 3 AND lo < hi")
    left = written(left.select("band", "n"), "nd-open")
    members = written(join_per_key(banded, left, ["band"], "n").select("row", "class").distinct(), "nd-members")
    if not members.limit(1).count():
        return None
    texts = texts.join(members.hint("merge"), "row").select("row", "class", "text")
    labels = written(texts.mapInArrow(_labels, "key long, row long, class long, n long"), "nd-labels")
    known = compared.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return written(_pairs_by_key(written(_rarest(labels), "nd-rarest")).join(known, ["a", "b"], "left_anti"), "nd-open-pairs")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, k, th, class_row, class_id, class_rows, n_links) of every row."""
    rows = sketched(docs, id_col, text_col)
    copies = written(rows.groupBy("same").agg(F.min("row").alias("rep"), F.count("*").alias("n")), "nd-copies")
    reps = written(rows.join(copies.select(F.col("rep").alias("row")), "row", "left_semi"), "nd-reps")
    pairs = candidates(reps)
    texts = texts_in(pairs, reps, docs, id_col, text_col)
    verified = lambda some, tag: written(with_texts(some, texts).mapInArrow(_verified, "a long, b long, similarity double"), tag)
    links = verified(pairs, "nd-links")
    left = open_pairs(reps, pairs, links, texts)
    if left is not None:
        links = links.unionByName(verified(left, "nd-more-links"))
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    parts = components(links, tag="nd-components")
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    of_text = copies.join(parts.join(degree, "node").withColumnRenamed("node", "rep"), "rep", "left").select("same", "n", F.coalesce("component", "rep").alias("class_row"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classed = written(join_per_key(rows.drop("bands"), written(of_text, "nd-texts-classes"), ["same"], "n").drop("same", "n"), "nd-classed")
    least = classed.groupBy("class_row").agg(F.min(F.struct("k", "row")).alias("first"), F.count("*").alias("class_rows"))
    return written(join_per_key(classed, written(least, "nd-least"), ["class_row"], "class_rows"), "nd-classes")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_rows, n_links) of every row: class_id is the least id of the class, n_links counts the links that were verified
    between the row's text and others: to leaders and, where these left classes open, to texts that share rare shingles. Links
    inside a class that follow from these are not looked for."""
    out = _classes(docs, id_col, text_col)
    id_of = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return out.select(id_of("k").alias("doc_id"), id_of("first.k").alias("class_id"), "class_rows", "n_links")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the least id of each class; of rows with one id and text, one."""
    out = _classes(docs, id_col, text_col)
    losers = out.filter("row <> first.row").select("k", "th").distinct()
    winners = out.filter("row = first.row").select("k", "th")
    losers = written(losers.join(winners, ["k", "th"], "left_anti"), "nd-losers")
    repeated = out.groupBy("k", "th").agg(F.count("*").alias("n")).filter("n > 1")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({"__k": null_safe_key(F.col(id_col)), "__th": F.xxhash64(text)})
    # Rows that the bitmap lets pass are joined; all others are no losers and stay where they are.
    marked = likely_in(keyed, losers, ["k", "th"], ["__k", "__th"], "__maybe")
    maybe = marked.filter("__maybe").join(losers.withColumnsRenamed({"k": "__k", "th": "__th"}).hint("merge"), ["__k", "__th"], "left_anti")
    kept = marked.filter("NOT __maybe").unionByName(maybe)
    if repeated.limit(1).count():
        kept = kept.dropDuplicates(["__k", "__th"])
    return kept.select(*docs.columns)
