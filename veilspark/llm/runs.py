"""Periodic runs of words, and texts with their repeats collapsed.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``min_length`` and two periods long,
which no word beside it extends. Runs of period q hold a multiple of q at which the word equals the one q later, so all
of them are met on the harmonic grid of (period, multiple of it): n log n pairs for n words. The texts of a batch are
worked on together, in blocks of a bounded number of pairs: pairs whose words differ, or which no stretch of the needed
length can hold, go at once; for the others binary searches over prefix hashes tell, for all pairs simultaneously, how far
the words agree to both sides. Hashes only ever agree too often, so every run that is kept is compared word by word; texts
for which that fails (hostile ones) are solved without hashes.

Null and empty text has no runs. Repeated rows are worked each, rows may have any id; an empty table gives no rows; other
columns pass through (columns runs and collapsed are replaced). A text is held whole by one task, with some 200 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The least number of words of a run.
MIN_LENGTH = 12
#: Texts of about so many words together are worked on at once, and so many pairs of the grid.
BATCH_WORDS, BLOCK_PAIRS = 1 << 17, 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def _values(ids: np.ndarray) -> np.ndarray:
    """Random-looking 64-bit values of word numbers."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Hashes of all stretches of a sequence, by prefix sums."""

    def __init__(self, ids: np.ndarray):
        self.powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(ids), _BASE)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_values(ids) * self.powers[:-1], dtype=np.uint64)])

    def same(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``length`` from ``at`` and from ``at + period`` agree."""
        left = self.sums[at + length] - self.sums[at]
        return left * self.powers[period] == self.sums[at + period + length] - self.sums[at + period]


def _longest(most: np.ndarray, agrees) -> np.ndarray:
    """For each pair the greatest length up to ``most`` that agrees, by simultaneous binary searches."""
    low, high = np.zeros_like(most), most + 1
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        yes = agrees(open_, middle)
        low[open_[yes]] = middle[yes]
        high[open_[~yes]] = middle[~yes]
        open_ = open_[high[open_] - low[open_] > 1]
    return low


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): (0, 0, 1, 1, 1) and (0, 1, 0, 1, 2)."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _stretches(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int) -> np.ndarray:
    """Distinct (start, end, period, text) of stretches that agree with themselves one period later, by the grid."""
    sizes = ends - starts
    text, period = _spread(np.where(sizes >= min_length, sizes // 2, 0))
    period += 1
    points = (sizes[text] - 1) // period
    upto = np.cumsum(points)
    prefixes, padded = Prefixes(ids), np.append(ids, -1)
    found = []
    at_row = 0
    while at_row < len(period):
        done = upto[at_row - 1] if at_row else 0
        last = max(at_row + 1, int(np.searchsorted(upto, done + BLOCK_PAIRS, side="right")))
        row, k = _spread(points[at_row:last])
        row += at_row
        p = period[row]
        at = starts[text[row]] + k * p
        hit = np.flatnonzero(padded[at] == padded[at + p])
        at_row = last
        at, p, d = at[hit], p[hit], text[row[hit]]
        # The stretch of pairs that agree is this long; half of it lies on one side of the grid point.
        half = (np.maximum(p, min_length - p) + 1) // 2
        back, ahead = at - starts[d], ends[d] - at - p
        b, f = np.minimum(half, back), np.minimum(half, ahead)
        likely = ((ahead >= half) & prefixes.same(at, p, f)) | ((back >= half) & prefixes.same(at - b, p, b))
        at, p, d, back, ahead = at[likely], p[likely], d[likely], back[likely], ahead[likely]
        f = _longest(ahead, lambda i, n: prefixes.same(at[i], p[i], n))  # noqa: B023
        b = _longest(back, lambda i, n: prefixes.same(at[i] - n, p[i], n))  # noqa: B023
        whole = b + f + p >= np.maximum(min_length, 2 * p)
        if whole.any():
            block = np.stack([at - b, at + p + f, p, d], axis=1)[whole]
            found.append(np.unique(block, axis=0))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)


def _wrong(ids: np.ndarray, found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers of the texts in which a stretch isn't what its hashes told: a first one whose words differ, or another of the
    same place whose period isn't a multiple of the first one's."""
    owner = np.cumsum(first) - 1
    bad = found[found[:, 2] % found[first][owner, 2] != 0, 3]
    kept = found[first]
    lengths = kept[:, 1] - kept[:, 0] - kept[:, 2]
    upto, at, failed = np.cumsum(lengths), 0, [bad]
    while at < len(kept):
        last = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_PAIRS, side="right")))
        of, k = _spread(lengths[at:last])
        i = kept[at:last, 0][of] + k
        failed.append(kept[at:last, 3][of[ids[i] != ids[i + kept[at:last, 2][of]]]])
        at = last
    return np.unique(np.concatenate(failed))


def runs_without_hashes(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one sequence, period after period: n * n word comparisons."""
    best: dict[tuple[int, int], int] = {}
    for p in range(1, len(ids) // 2 + 1 if len(ids) >= min_length else 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids[:-p] == ids[p:], [False]]).astype(np.int8)))
        for s, e in edges.reshape(-1, 2).tolist():
            if e - s + p >= max(min_length, 2 * p):
                best.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def find_runs(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(text, start, length, period) of all runs of the texts ``ids[starts[i]:ends[i]]``, by text, start and period."""
    found = _stretches(ids, starts, ends, min_length)
    if not len(found):
        return np.zeros((0, 4), np.int64)
    # Of one place the least period is its own; it stands first.
    first = np.append(True, (np.diff(found[:, :2], axis=0) != 0).any(axis=1))
    wrong = _wrong(ids, found, first)
    kept = found[first]
    kept = kept[~np.isin(kept[:, 3], wrong)]
    out = [np.stack([kept[:, 3], kept[:, 0] - starts[kept[:, 3]], kept[:, 1] - kept[:, 0], kept[:, 2]], axis=1)]
    for text in wrong.tolist():
        out.append(np.array([(text, *r) for r in runs_without_hashes(ids[starts[text] : ends[text]], min_length)], np.int64).reshape(-1, 4))
    rows = np.concatenate(out)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _solve(texts: list[bytes | None], min_length: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed texts of a few texts."""
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    words = [(t or b"").split() for t in texts]  # white space of bytes: blank and 9 to 13
    sizes = np.array([len(w) for w in words])
    ids = np.fromiter((number(w, len(seen)) for own in words for w in own), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    rows = find_runs(ids, ends - sizes, ends, min_length)
    collapsed = []
    bounds = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    for i, own in enumerate(words):
        mine = rows[bounds[i] : bounds[i + 1]]
        if len(mine):
            edge = np.zeros(len(own) + 1, np.int64)
            np.add.at(edge, mine[:, 1] + mine[:, 3], 1)
            np.add.at(edge, mine[:, 1] + mine[:, 2], -1)
            own = [own[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        collapsed.append(None if texts[i] is None else b" ".join(own))
    flat = pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int64()) for k in (1, 2, 3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat).cast(_ARROW), pa.array(collapsed, pa.binary()).cast(pa.string())


def _groups(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_WORDS words together (six bytes a word)."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or b"") // 6
        if held >= BATCH_WORDS:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def detect(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with runs (array of start, length and period in words, by start then period) and collapsed: the words that
    no run holds after its first period, joined by a blank (null text: null)."""
    kept = [f for f in docs.schema.fields if f.name not in ("runs", "collapsed")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_col)).cast(pa.binary()).to_pylist()
            for begin, end in _groups(texts):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, *_solve(texts[begin:end], min_length)], [*names, "runs", "collapsed"])

    schema = T.StructType([*kept, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    return docs.select(*[docs[n] for n in names]).mapInArrow(run, schema)
