"""Source divergence audit: how far the words of each source of a language are from those of its other sources.

Terms are runs of ASCII letters (lower-cased) and of characters beyond ASCII. A lookup table over the concatenated UTF-8
bytes of a batch finds their boundaries, xxhash groups the slices, and every slice is compared with its group's first one
byte by byte (slices that only share the hash are parted). What a batch counts is summed by group and term before it
is shuffled, so a common term or a large source is some rows a batch.

Terms of a language are then dealt out in blocks of about BLOCK_ENTRIES counts, each with the language's sources. A block
makes a CSR matrix, source by term, and takes for each source the divergence from all others by differences on the stored
entries, summed by ``reduceat``: pairs of zero counts have one value, which is multiplied. Blocks are summed by Spark. All
arithmetic is on integers; counts up to 9 * 10^15 stay exact.

Null text, language and source are read as ''. Repeated rows count each; groups without terms have pairs only; a language
without kept terms has pairs of value 0, one with a single source none. An empty table gives no rows. Other columns are
ignored. The number of a language's sources may grow: the result has its square of rows, and no task more than OUTPUT_ROWS
of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_per_key, written

#: Terms on fewer rows of their language than this are left out.
MIN_DOCS = 3
SCALE = 1_000_000_000
#: Ranks of terms that are told.
TOP_TERMS = 200
#: About so many bytes of text are counted at once, and so many counts make a block.
CHUNK_BYTES, BLOCK_ENTRIES = 1 << 23, 200_000
#: At most about so many pairs leave one task's block.
OUTPUT_ROWS = 500_000

#: Each byte of a term in lower case, 0 for bytes outside terms.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of all terms, and the number of the text that each stands in."""
    low = _LETTERS[data]
    inside = np.append(low != 0, False)
    before = np.append(False, inside[:-1])
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before)
    after = inside[1:].copy()
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside[:-1] & ~after) + 1
    return low, starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def _eights(low: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one little-endian number."""
    return np.ndarray(shape=(len(low) + 1,), dtype="<u8", buffer=np.append(low, np.zeros(8, np.uint8)), strides=(1,))


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def digests(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 of each slice, all slices of under 32 bytes together, a step of the hash at a time."""
    eights = _eights(low)
    h = lengths.astype(np.uint64) + _P5
    short = lengths < 32
    for k in (8, 16, 24):
        i = np.flatnonzero(short & (lengths >= k))
        h[i] = _turned(h[i] ^ (_turned(eights[starts[i] + k - 8] * _P2, 31) * _P1), 27) * _P1 + _P4
    done = lengths & ~7
    i = np.flatnonzero(short & (lengths & 4 > 0))
    h[i] = _turned(h[i] ^ ((eights[starts[i] + done[i]] & _MASKS[4]) * _P1), 23) * _P2 + _P3
    done = lengths & ~3
    for k in range(3):
        i = np.flatnonzero(short & (lengths & 3 > k))
        h[i] = _turned(h[i] ^ (low[starts[i] + done[i] + k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(~short).tolist():
        h[i] = xxhash.xxh64_intdigest(low[starts[i] : starts[i] + lengths[i]].tobytes())
    return h


def _equal(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each slice has the bytes of slice ``other``; eight bytes are compared at a time."""
    eights = _eights(low)
    same = lengths == lengths[other]
    rest, k = np.flatnonzero(same), 0
    while len(rest):
        mask = _MASKS[np.minimum(lengths[rest] - k, 8)]
        good = (eights[starts[rest] + k] & mask) == (eights[starts[other[rest]] + k] & mask)
        same[rest[~good]] = False
        k += 8
        rest = rest[good & (lengths[rest] > k)]
    return same


def _firsts(values: np.ndarray) -> np.ndarray:
    """Which of sorted values differ from the one before."""
    return np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)


def grouped(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed=digests) -> tuple[np.ndarray, np.ndarray]:
    """The group of each slice, and a slice of each group: slices of equal bytes, and no others, share one."""
    lengths = ends - starts
    hashes = hashed(low, starts, lengths)
    order = np.argsort(hashes)
    new = _firsts(hashes[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    apart = np.flatnonzero(~_equal(low, starts, lengths, first[group]))
    if len(apart):
        seen: dict[bytes, int] = {}
        more = []
        for i in apart.tolist():
            word = low[starts[i] : ends[i]].tobytes()
            if word not in seen:
                seen[word] = len(first) + len(seen)
                more.append(i)
            group[i] = seen[word]
        first = np.append(first, more)
    return group, first


def _words(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The slices as strings."""
    upto = np.append(0, np.cumsum(lengths))
    places = np.arange(upto[-1]) + np.repeat(starts - upto[:-1], lengths)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(low[places])])


def _counted(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of texts with their group numbers: (group, term, occurrences, texts) of each group and term."""
    low, starts, ends, text = slices(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    term, first = grouped(low, starts, ends)
    width = len(first)
    by_text = np.sort(text * width + term)
    at = np.flatnonzero(_firsts(by_text))
    n, by_text = np.diff(np.append(at, len(by_text))), by_text[at]
    key = owner[by_text // width] * width + by_text % width
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(_firsts(key))
    words = _words(low, starts[first], (ends - starts)[first])
    return key[at] // width, words.take(pa.array(key[at] % width)), np.add.reduceat(n[order], at), np.diff(np.append(at, len(key)))


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about CHUNK_BYTES of text."""
    text = batch.column(2)
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    upto = bounds[1:] - bounds[0]
    at = 0
    while at < batch.num_rows:
        last = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
        yield batch.slice(at, last - at)
        at = last


#: Rows that leave a worker together.
_ROWS = 50_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    for whole in batches:
        if not whole.num_rows:
            continue
        large = whole.set_column(2, "text", whole.column(2).cast(pa.large_binary()))
        for batch in _chunks(large):
            text = batch.column(2)
            bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            groups: dict[tuple[str, str], int] = {}
            owner = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
            group, terms, n, docs = _counted(data, bounds - bounds[0], owner)
            keys = list(groups)
            lang, source = (pa.array([k[i] for k in keys], pa.string()).take(pa.array(group)) for i in (0, 1))
            out = pa.RecordBatch.from_arrays([lang, source, terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names)
            yield from (out.slice(at, _ROWS) for at in range(0, out.num_rows, _ROWS))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows of every term of every group."""
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    # What workers counted goes to its term's task at once, for both groupings that follow: sums of few and small rows a chunk.
    rows = filled.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), by long division in thousands, so that nothing overflows."""
    rest, quotient = n + 1, np.zeros_like(n)
    for _ in range(3):
        part, rest = np.divmod(rest * 1000, total)
        quotient = quotient * 1000 + part
    return quotient + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def divergences(matrix: tuple[np.ndarray, np.ndarray, np.ndarray], columns: int, totals: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """[wanted rows, all rows]: the sum over columns of how far a wanted row's share is from each other row's. ``matrix`` is CSR
    (row bounds, columns, counts), ``totals`` what a row's shares are of."""
    bounds, col, n = matrix
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(totals)), sizes)
    share, zero = _shares(n, totals[row]), _shares(np.zeros_like(totals), totals)
    filled = np.flatnonzero(sizes)
    out = np.empty((len(wanted), len(totals)), np.int64)
    for i, a in enumerate(wanted.tolist()):
        mine = slice(bounds[a], bounds[a + 1])
        p = np.full(columns, zero[a])
        p[col[mine]] = share[mine]
        # As if all of the other row's counts were zero; then what its stored entries change.
        base = _apart(zero[a], zero)
        out[i] = base * (columns - sizes[a])
        for at in range(bounds[a], bounds[a + 1], 1 << 16):
            out[i] += _apart(share[at : min(at + (1 << 16), bounds[a + 1]), None], zero).sum(axis=0)
        change = _apart(p[col], share) - _apart(p[col], zero[row])
        if len(filled):
            out[i, filled] += np.add.reduceat(change, bounds[:-1][filled])
    return out


def _block(terms: pa.Table, sources: pa.Table) -> pa.Table:
    """One block's part of the pairs' sums, and its terms that may be among a source's first."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not sources.num_rows:
        return schema.empty_table()
    lang, vocabulary, lang_n = (sources.column(c)[0].as_py() for c in ("lang", "v", "lang_n"))
    names, totals = sources.column("source").combine_chunks(), sources.column("n").to_numpy() + vocabulary
    wanted = np.flatnonzero(sources.column("mine").to_numpy(zero_copy_only=False))
    if vocabulary == 0:
        value, told = np.zeros((len(wanted), len(names)), np.int64), []
    else:
        words = terms.column("term").to_pylist()
        lists = terms.column("s").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        per_term = np.asarray(lists.value_lengths()) if len(words) else np.zeros(0, np.int64)
        flat = lists.flatten()
        row = pc.index_in(flat.field("source"), value_set=names).to_numpy().astype(np.int64)
        n, col = flat.field("n").to_numpy().astype(np.int64), np.repeat(np.arange(len(words)), per_term)
        order = np.argsort(row, kind="stable")
        bounds = np.searchsorted(row[order], np.arange(len(names) + 1))
        value = divergences((bounds, col[order], n[order]), len(words), totals, wanted)
        told = []
        if len(words):
            overall = _shares(np.bincount(col, weights=n).astype(np.int64), np.full(len(words), lang_n + vocabulary))
            place = np.empty(len(words), np.int64)
            place[sorted(range(len(words)), key=[w.encode() for w in words].__getitem__)] = np.arange(len(words))
            for a in wanted.tolist():
                entries = order[bounds[a] : bounds[a + 1]]
                p, q = _shares(n[entries], np.full(len(entries), totals[a])), overall[col[entries]]
                more = p > q
                at, f = col[entries][more], _apart(p[more], q[more])
                best = np.lexsort((place[at], -f))[:TOP_TERMS]
                told.append((a, at[best], f[best]))
    a, b = np.nonzero(wanted[:, None] != np.arange(len(names)))
    columns = [names.take(pa.array(wanted[a])), pa.array(["pair"] * len(a), pa.string()), names.take(pa.array(b)), pa.array(value[a, b])]
    out = [pa.table([pa.array([lang] * len(a), pa.string()), *columns], schema=schema)]
    for a, at, f in told:
        out.append(pa.table([pa.array([lang] * len(at), pa.string()), pa.array([names[a].as_py()] * len(at), pa.string()), pa.array(["term"] * len(at), pa.string()), pa.array([words[i] for i in at.tolist()], pa.string()), pa.array(f)], schema=schema))
    return pa.concat_tables(out)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair``, the divergence of the source from each other one of its language;
    ``term``, its TOP_TERMS terms that stand out most from the language."""
    counts = term_counts(docs, text_col, lang_col, source_col)
    by_term = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("s"), F.sum("docs").alias("docs"))
    kept = written(by_term.filter(F.col("docs") >= min_docs).select("lang", "term", "s"), "audit-terms")
    totals = kept.select("lang", F.explode("s").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    groups = written(groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "audit-groups")
    vocabularies = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.size("s")).alias("entries"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("sources")).join(vocabularies, "lang", "left")
    langs = written(langs.select("lang", "lang_n", "sources", F.coalesce("v", F.lit(0)).alias("v"), F.ceil(F.greatest(F.coalesce("entries", F.lit(0)), F.lit(1)) / BLOCK_ENTRIES).cast("long").alias("blocks"), F.ceil(F.col("sources") * F.col("sources") / OUTPUT_ROWS).cast("long").alias("parts")), "audit-langs")
    sequence = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    terms = join_per_key(kept, langs.select("lang", "v", "blocks", "parts"), ["lang"], "v")
    terms = terms.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), sequence("parts").alias("p"), "term", "s")
    # A block has all sources of its language, and works out the rows of one part of them.
    sides = join_per_key(groups, langs, ["lang"], "sources").select("lang", "source", "n", "v", "lang_n", "parts", sequence("blocks").alias("block"))
    sides = sides.select("*", sequence("parts").alias("p")).select("lang", "block", "p", "source", "n", "v", "lang_n", (F.pmod(F.xxhash64("source"), F.col("parts")) == F.col("p")).alias("mine"))
    keys = ["lang", "block", "p"]
    rows = written(terms.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(_block, "lang string, source string, part string, item string, value long"), "audit-blocks")
    pairs = rows.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = rows.filter("part = 'term'").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(told)
