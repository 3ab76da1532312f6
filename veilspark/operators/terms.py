"""Where any of very many terms stands in texts: one pass a text, whatever the number of terms.

Terms are a trie with edges of eight bytes, held as flat arrays sorted by a hash of (node, bytes, kind of edge). All places
of a batch of texts walk it together: one gather and one binary search a level, and few places get beyond the first two
bytes. The arrays are built by one task of at most MAX_ENTRIES entries and MAX_BYTES bytes and broadcast; larger sets are
cut by hash into shards of that size, each of which reads the texts once, and only what was found is shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import written

#: Entries and bytes (of terms and what belongs to them) of one shard at most.
MAX_ENTRIES, MAX_BYTES = 1_000_000, 64_000_000
#: Bytes of text that one walk works on, if they are several texts.
WALK_BYTES = 1 << 21
#: A place of a term: bytes and characters from and to, the term, what belongs to it, and whether replacing the term takes it
#: (of places of one term that overlap, it takes the first).
PLACES = "array<struct<s: int, e: int, cs: int, ce: int, o: string, n: string, k: boolean>>"
PAIRS = "array<struct<o: string, n: string>>"

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)] + [(1 << 64) - 1], dtype=np.uint64)
_ON = 9  # the kind of an edge that goes on; 1 to 8 end a term after so many bytes


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=np.append(data, np.zeros(8, np.uint8)), strides=(1,))


def _hash(node: np.ndarray, word: np.ndarray, kind: int | np.ndarray, salt: int) -> np.ndarray:
    x = word * np.uint64(0x9E3779B97F4A7C15) ^ (node.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt) + np.asarray(kind).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class TermIndex:
    """Distinct terms, each of a byte or more; a term's number is its place in the list."""

    def __init__(self, terms: list[bytes]):
        self.lengths = np.array([len(t) for t in terms], dtype=np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        eights = _eights(np.frombuffer(b"".join(terms), np.uint8))
        node, at, number, made = np.zeros(len(terms), np.int64), starts, np.arange(len(terms)), 1
        rows, self.levels = [], []
        while len(number):
            rest = self.lengths[number] - (at - starts[number])
            word, ends = eights[at] & _MASKS[np.minimum(rest, 8)], rest <= 8
            self.levels.append(sorted(set(rest[ends].tolist()) | ({_ON} if not ends.all() else set())))
            rows.append((node[ends], word[ends], rest[ends], number[ends]))
            node, word, at, number = node[~ends], word[~ends], at[~ends] + 8, number[~ends]
            if not len(number):
                break
            order = np.lexsort((word, node))
            new = np.append(True, (node[order][1:] != node[order][:-1]) | (word[order][1:] != word[order][:-1]))
            first, child = order[new], np.empty(len(order), np.int64)
            child[order] = made + np.cumsum(new) - 1
            rows.append((node[first], word[first], np.full(len(first), _ON), child[first]))
            node, made = child, made + len(first)
        node, word, kind, value = (np.concatenate(c) if rows else np.zeros(0, np.uint64) for c in (zip(*rows, strict=True) if rows else [()] * 4))
        self.salt = 0
        while True:  # no two keys share a hash
            hashes = _hash(node, word, kind, self.salt)
            order = np.argsort(hashes)
            if not len(hashes) or (np.diff(hashes[order]) != 0).all():
                break
            self.salt += 1
        self.hashes, self.nodes, self.words, self.kinds, self.values = (x[order] for x in (hashes, node, word, kind.astype(np.int8), value))
        self.bits = max(16, int(len(hashes)).bit_length() + 4)
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self.hashes >> np.uint64(64 - self.bits)] = True
        self.heads = np.zeros(1 << 16, bool)
        if len(terms):
            two = (eights[starts] & np.uint64(0xFFFF)).astype(np.int64)
            self.heads[two[self.lengths > 1]] = True
            for b in set((two[self.lengths == 1] & 255).tolist()):
                self.heads[b::256] = True

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, term) of every occurrence in the texts ``data[offsets[i]:offsets[i + 1]]``, by place, then term."""
        none = np.zeros(0, np.int64)
        if not len(self.hashes) or not len(data):
            return none, none, none
        eights = _eights(data)
        at = np.flatnonzero(self.heads[(eights[:-1] & np.uint64(0xFFFF)).astype(np.int64)])
        start, node, end = at, np.zeros(len(at), np.int64), offsets[1:][np.searchsorted(offsets[1:], at, side="right")]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for kinds in self.levels:
            word, room, on = eights[at], end - at, None
            for kind in kinds:
                i = np.flatnonzero(room >= kind)
                part = word[i] & _MASKS[min(kind, 8)]
                h = _hash(node[i], part, kind, self.salt)
                likely = self.bitmap[h >> np.uint64(64 - self.bits)]
                i, part, h = i[likely], part[likely], h[likely]
                j = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                good = (self.hashes[j] == h) & (self.nodes[j] == node[i]) & (self.words[j] == part) & (self.kinds[j] == kind)
                if kind == _ON:
                    on = i[good], self.values[j[good]]
                else:
                    found.append((start[i[good]], self.values[j[good]]))
            if on is None:
                break
            start, at, end, node = start[on[0]], at[on[0]] + 8, end[on[0]], on[1]
        place, term = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none)
        order = np.lexsort((term, place))
        return np.searchsorted(offsets[1:], place[order], side="right"), place[order], term[order]


class _Strings:
    """Strings as one run of bytes and where each begins: no object a string."""

    def __init__(self, values: list[bytes]):
        self.bounds = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)  # MAX_BYTES at most
        self.data = np.frombuffer(b"".join(values), np.uint8)

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def take(self, at: pa.Array) -> pa.Array:
        whole = pa.Array.from_buffers(pa.string(), len(self.bounds) - 1, [None, pa.py_buffer(self.bounds), pa.py_buffer(self.data)])
        return whole.take(at)


class Entries:
    """Terms with what belongs to them: (term, its companion, what it becomes), the longest first, then by bytes. Equal terms
    are one term of the index; each entry counts."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes]]):
        rows = sorted(rows, key=lambda r: (-len(r[0]), r[0], r[1]))
        firsts = [i for i, r in enumerate(rows) if i == 0 or r[0] != rows[i - 1][0]]
        self.begins = np.array([*firsts, len(rows)])
        self.index = TermIndex([rows[i][0] for i in firsts])
        self.olds, self.news, self.made = (_Strings([r[k] for r in rows]) for k in range(3))
        self.longest = len(rows[0][0]) if rows else 0

    @property
    def strings(self) -> tuple[_Strings, _Strings]:
        return self.olds, self.news

    def entries_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``terms``, entry) of all entries of some terms."""
        counts = self.begins[terms + 1] - self.begins[terms]
        of = np.repeat(np.arange(len(terms)), counts)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + self.begins[terms][of]

    def find(self, texts: list[bytes] | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, place in it, term) of all occurrences, and the texts' bytes and bounds, for a few texts at a time."""
        lengths = [len(t) for t in texts] if isinstance(texts, list) else pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        sizes, begin = np.cumsum(lengths, dtype=np.int64), 0
        while begin < len(texts):
            last = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + WALK_BYTES, side="right")))
            some = texts[begin:last] if isinstance(texts, list) else _bytes(texts.slice(begin, last - begin))
            data = np.frombuffer(b"".join(some), np.uint8)
            offsets = np.append(0, np.cumsum([len(t) for t in some]))
            text, place, term = self.index.find(data, offsets)
            yield text + begin, place - offsets[text], term, data, offsets
            begin = last

    def _after(self, text: bytes, entries: list[int], windows: list[bytes], owner: list[tuple[int, int]], number: int) -> None:
        """Replaces entries one after the other; where a replacement stands, a window that any term across it fits in."""
        reach = self.longest - 1
        for e in entries:
            old, new = self.olds[e], self.made[e]
            if old not in text:
                continue
            parts, pos = text.split(old), 0
            text = new.join(parts)
            for part in parts[:-1]:
                pos += len(part)
                windows.append(text[max(0, pos - reach) : pos + len(new) + reach])
                owner.append((number, e))
                pos += len(new)

    def closed(self, texts: list[bytes]) -> list[list[int]]:
        """For each text the entries that replacing all in turn meets: those in the text, and those that a replacement makes."""
        known: list[set[int]] = [set() for _ in texts]
        for text, _, term, _, _ in self.find(texts):
            of, entry = self.entries_of(term)
            for t, e in zip(text[of].tolist(), entry.tolist(), strict=True):
                known[t].add(e)
        again = [i for i, k in enumerate(known) if k]
        while again:
            windows: list[bytes] = []
            owner: list[tuple[int, int]] = []
            for i in again:
                self._after(texts[i], sorted(known[i]), windows, owner, i)
            grown = set()
            for window, _, term, _, _ in self.find(windows):
                of, entry = self.entries_of(term)
                for w, e in zip(window[of].tolist(), entry.tolist(), strict=True):
                    number, by = owner[w]
                    if e > by and e not in known[number]:
                        known[number].add(e)
                        grown.add(number)
            again = sorted(grown)
        return [sorted(k) for k in known]


def dumped(entries: Entries) -> bytes:
    """Entries as bytes whose arrays need no copy to be read: their number and sizes, the pickle without them, the arrays."""
    arrays: list[pickle.PickleBuffer] = []
    head = pickle.dumps(entries, protocol=5, buffer_callback=arrays.append)
    parts = [memoryview(head), *(a.raw() for a in arrays)]
    sizes = np.array([len(parts), *(p.nbytes for p in parts)], dtype="<i8").tobytes()
    return b"".join(x for p in (sizes, *parts) for x in (p, bytes(-len(p) % 64)))


def loaded(data: bytes) -> Entries:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes, at, parts = np.frombuffer(data, "<i8", n + 1)[1:].tolist(), 8 * (n + 1), []
    for size in sizes:
        at += -at % 64
        parts.append(memoryview(data)[at : at + size])
        at += size
    return pickle.loads(parts[0], buffers=parts[1:])


@lru_cache(maxsize=1)
def _loaded(data: Broadcast) -> Entries:
    """One shard a worker; its arrays are those of the broadcast."""
    return loaded(data.value)


def _bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def _pairs(data: Broadcast) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        shard = _loaded(data)
        lists = shard.closed(_bytes(texts))
        at = pa.array([e for entries in lists for e in entries], pa.int64())
        flat = pa.StructArray.from_arrays([s.take(at) for s in shard.strings], ["o", "n"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in lists])), pa.int32()), flat)

    return run


def _places(data: Broadcast) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        shard = _loaded(data)
        counts, walks, first = np.zeros(len(texts), np.int64), [], 0
        for text, place, term, raw, offsets in shard.find(texts):
            if len(term):  # only what was found is kept of a walk, nothing as long as its texts
                of, entry = shard.entries_of(term)
                text, place, length = text[of], place[of], shard.index.lengths[term[of]]
                chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32))  # bytes that begin a character
                begin = offsets[text - first]
                numbers = [at.astype(np.int32) for at in (place, place + length, chars[begin + place] - chars[begin], chars[begin + place + length] - chars[begin])]
                walks.append((*numbers, entry, _taken(text, entry, place, length)))
                np.add.at(counts, text, 1)
            first += len(offsets) - 1
        return _as_places(shard, counts, walks)

    return run


def _taken(text: np.ndarray, entry: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of the places of one entry in one text, those that don't overlap the last one taken."""
    order = np.lexsort((place, entry, text))
    t, e, p, n = text[order], entry[order], place[order], length[order]
    close = (t[1:] == t[:-1]) & (e[1:] == e[:-1]) & (p[1:] < p[:-1] + n[:-1])
    taken = np.ones(len(order), bool)
    last = -1
    for i in np.flatnonzero(close).tolist():  # place i + 1 overlaps place i
        last = i if taken[i] else last
        taken[i + 1] = p[i + 1] >= p[last] + n[last]
    out = np.empty(len(order), bool)
    out[order] = taken
    return out


def _as_places(shard: Entries, counts: np.ndarray, walks: list[tuple[np.ndarray, ...]]) -> pa.Array:
    joined = [np.concatenate(c) for c in zip(*walks, strict=True)] if walks else [np.zeros(0, np.int32)] * 4 + [np.zeros(0, np.int64), np.zeros(0, bool)]
    at = pa.array(joined[4])
    flat = pa.StructArray.from_arrays([*map(pa.array, joined[:4]), *(s.take(at) for s in shard.strings), pa.array(joined[5])], ["s", "e", "cs", "ce", "o", "n", "k"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), flat)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(_bytes(b.column(i)) for i in range(3)), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([dumped(Entries(rows))], pa.binary())], ["data"])


def shards(entries: DataFrame) -> Iterator[Broadcast]:
    """``entries`` (o, n, r) as broadcast shards; their number follows from the size, which is counted first."""
    spark = entries.sparkSession
    ship(spark)
    size = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("o") + F.coalesce(F.octet_length("n"), F.lit(0)) + F.coalesce(F.octet_length("r"), F.lit(0))), F.lit(0)).alias("b")).first()
    parts = max(1, -(-size["n"] // MAX_ENTRIES), -(-size["b"] // MAX_BYTES))
    for k in range(parts):
        mine = entries.filter(F.pmod(F.xxhash64("o"), F.lit(parts)) == k) if parts > 1 else entries
        made = mine.select("o", "n", "r").coalesce(1).mapInArrow(_built, "data binary").collect()  # one row of bounded size
        yield spark.sparkContext.broadcast(bytes(made[0]["data"]) if made else dumped(Entries([])))


def one_shard(entries: DataFrame) -> Broadcast | None:
    """The broadcast of a set that one shard holds, else None."""
    size = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("o") + F.coalesce(F.octet_length("n"), F.lit(0)) + F.coalesce(F.octet_length("r"), F.lit(0))), F.lit(0)).alias("b")).first()
    return next(shards(entries)) if size["n"] <= MAX_ENTRIES and size["b"] <= MAX_BYTES else None


def _evaluated_once(udf):
    """As if it weren't deterministic: else the optimizer copies the call to each place that its result is used in."""
    return udf.asNondeterministic()


def pairs(data: Broadcast, text: Column) -> Column:
    """Entries that stand in a text, or come to stand in it when all are replaced in turn; in order."""
    return _evaluated_once(F.arrow_udf(_pairs(data), PAIRS))(text)


def places(data: Broadcast, text: Column) -> Column:
    """Every place of every entry in a text, by place, overlapping ones too."""
    return _evaluated_once(F.arrow_udf(_places(data), PLACES))(text)


def places_of(rows: DataFrame, entries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x) for every place of every entry in ``rows`` (key, text), shard after shard; each reads ``rows`` once."""
    out = None
    for data in shards(entries):
        found = written(rows.select(key, F.explode(places(data, F.col(text))).alias("x")), "places")
        data.unpersist()
        out = found if out is None else out.unionByName(found)
    return out
