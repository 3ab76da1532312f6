"""SentencePiece encoding and decoding in batched numpy.

A text is cut into words at the blank mark (exact, since no piece holds a mark after another character). Words not yet
known to the worker are solved together, all of one length at a time: rolling hashes of substrings probe the sorted
hashes of the pieces. For unigram models words advance place by place, and vectorised maxima over piece lengths store
the back pointers (Viterbi). Models of kind BPE do not choose the segmentation of the best total score, so Viterbi
would give other ids than their tokenizer; for them each step merges every word's best-scored adjacent pair, found by
the same probes and a vectorised maximum. The model file says which.

Null text gives null ids, empty text none; characters without a piece become byte pieces or the unknown id. Decoding
turns the blank mark into a blank, so texts that hold the mark itself come back with blanks. Repeated rows are worked
each; an empty table gives no rows; other columns pass through (columns ids and decoded are replaced).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as pb

BLANK = "▁"
#: Words that one worker remembers at most, and the longest it does.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 24
#: Longer words are solved one by one, in time near-linear in their length.
BATCH_CHARS = 48
#: Unknown characters score this much below the worst piece.
UNKNOWN_PENALTY = 10.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
UNIGRAM, BPE = 1, 2


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(15))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Model:
    """A table of pieces, and the solvers over it."""

    def __init__(self, pieces: list[tuple[str, float]], kind: int, unknown_id: int = 0, byte_ids: dict[int, int] | None = None, controls: set[int] = frozenset(), dummy_prefix: bool = True, extra_blanks: bool = True):
        self.kind, self.unknown_id, self.byte_ids, self.dummy_prefix, self.keep_blanks = kind, unknown_id, byte_ids or {}, dummy_prefix, extra_blanks
        self.bytes_of = [p.encode() for p, _ in pieces]
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        for i in controls:
            self.bytes_of[i] = b""
        self.bytes_of[unknown_id] = " ⁇ ".encode()
        usable = [i for i, (p, _) in enumerate(pieces) if p and i not in controls and i not in self.byte_ids.values() and i != unknown_id]
        self.id_of = {pieces[i][0]: i for i in usable}
        self.scores = {pieces[i][0]: pieces[i][1] for i in usable}
        if any(BLANK in p.lstrip(BLANK) for p in self.id_of):
            raise ValueError("a piece holds a blank mark after another character")
        self.lines_apart = not any("\n" in p for p in self.id_of if len(p) > 1)  # then nothing merges across a line's end
        self.longest = max(map(len, self.id_of), default=1)
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        hashes = np.array([self._hash(pieces[i][0]) for i in usable], dtype=np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one hash")
        self.key_id = np.array(usable, dtype=np.int64)[order]
        self.key_len = np.array([len(pieces[i][0]) for i in usable], dtype=np.int64)[order]
        self.key_score = np.array([pieces[i][1] for i in usable], dtype=np.float64)[order]
        self.powers = _BASE ** np.arange(BATCH_CHARS + 1, dtype=np.uint64)
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in _mixed(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4")):
            h = h * _BASE + c
        return h[0]

    @classmethod
    def from_file(cls, path: str) -> Model:
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only models that leave texts as they are, apart from the blank mark, are supported")
        kinds = pb.ModelProto.SentencePiece
        at = {k: {i for i, p in enumerate(proto.pieces) if p.type == k} for k in (kinds.CONTROL, kinds.BYTE, kinds.UNKNOWN, kinds.USER_DEFINED)}
        if at[kinds.USER_DEFINED] or proto.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("models with user-defined pieces, and those of words or characters, are not supported")
        byte_ids = {int(proto.pieces[i].piece[3:5], 16): i for i in at[kinds.BYTE]}
        return cls([(p.piece, p.score) for p in proto.pieces], proto.trainer_spec.model_type, proto.trainer_spec.unk_id, byte_ids, at[kinds.CONTROL], proto.normalizer_spec.add_dummy_prefix)

    def probe(self, hashes: np.ndarray, lengths: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """(found, place among the keys) of substring hashes."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return (self.keys[at] == hashes) & (self.key_len[at] == lengths), at

    def _prefixes(self, words: list[str]) -> np.ndarray:
        """Rolling hashes of all prefixes of words of one length."""
        length = len(words[0])
        codes = _mixed(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")).reshape(len(words), length)
        out = np.zeros((len(words), length + 1), dtype=np.uint64)
        for i in range(length):
            out[:, i + 1] = out[:, i] * _BASE + codes[:, i]
        return out

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the best segmentation's pieces begin, and prefix hashes, for words of one length; ties go to the longer last piece."""
        length, n = len(words[0]), len(words)
        prefix = self._prefixes(words)
        best, back = np.full((n, length + 1), -np.inf), np.zeros((n, length + 1), dtype=np.int64)
        best[:, 0] = 0
        for end in range(1, length + 1):
            for size in range(min(self.longest, end), 0, -1):
                found, at = self.probe(prefix[:, end] - prefix[:, end - size] * self.powers[size], size)
                score = np.where(found, self.key_score[at], self.worst if size == 1 else -np.inf) + best[:, end - size]
                better = score > best[:, end]
                best[better, end], back[better, end] = score[better], end - size
        begins = np.zeros((n, length), dtype=bool)
        rows, at = np.arange(n), np.full(n, length)
        while len(rows):
            at = back[rows, at]
            begins[rows, at] = True
            rows, at = rows[at > 0], at[at > 0]
        return begins, prefix

    def merges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that merging the best adjacent pair again and again leaves, leftmost first among equals."""
        length, n = len(words[0]), len(words)
        prefix = self._prefixes(words)
        after = np.tile(np.arange(1, length + 2), (n, 1))  # end of the symbol that begins here
        before = np.tile(np.arange(-1, length), (n, 1))  # begin of the symbol before the one that begins here
        pair = np.full((n, length), -np.inf)

        def rate(rows: np.ndarray, begin: np.ndarray) -> None:
            middle = after[rows, begin]
            inside = middle < length
            rows_in, begin_in, middle_in = rows[inside], begin[inside], middle[inside]
            end = after[rows_in, middle_in]
            size = end - begin_in
            found, at = self.probe(prefix[rows_in, end] - prefix[rows_in, begin_in] * self.powers[size], size)
            pair[rows_in, begin_in] = np.where(found, self.key_score[at], -np.inf)
            pair[rows[~inside], begin[~inside]] = -np.inf

        everyone = np.arange(n)
        for i in range(length - 1):
            rate(everyone, np.full(n, i))
        active = everyone
        while len(active):
            chosen = np.argmax(pair[active], axis=1)
            going = pair[active, chosen] > -np.inf
            active, chosen = active[going], chosen[going]
            if not len(active):
                break
            middle = after[active, chosen]
            end = after[active, middle]
            after[active, chosen] = end
            pair[active, middle] = -np.inf
            more = end < length
            before[active[more], end[more]] = chosen[more]
            rate(active, chosen)
            left = before[active, chosen]
            has = left >= 0
            rate(active[has], left[has])
        begins = np.zeros((n, length), dtype=bool)
        rows, at = everyone, np.zeros(n, dtype=np.int64)
        while len(rows):
            begins[rows, at] = True
            at = after[rows, at]
            rows, at = rows[at < length], at[at < length]
        return begins, prefix

    def _all_ids(self, words: list[str], begins: np.ndarray, prefix: np.ndarray) -> list[bytes]:
        """Ids of words of one length from where their pieces begin."""
        n, length = begins.shape
        rows, begin = np.nonzero(begins)
        end = np.append(begin[1:], 0)
        end[np.append(rows[1:] != rows[:-1], True)] = length
        size = end - begin
        found, at = self.probe(prefix[rows, end] - prefix[rows, begin] * self.powers[size], size)
        flat = np.where(found, self.key_id[at], -1).astype("<i4").tobytes()
        bounds = np.concatenate([[0], np.cumsum(begins.sum(axis=1)) * 4]).tolist()
        out = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for row in np.unique(rows[~found]).tolist():
            places = np.flatnonzero(begins[row]).tolist()
            out[row] = self._ids(words[row], [*places[1:], length])
        return out

    def merge_long(self, word: str) -> list[int]:
        """Ends of the merged pieces of one long word, by a heap of pairs."""
        n, scores = len(word), self.scores
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n:
                end = after[after[i]]
                if end - i <= self.longest and (score := scores.get(word[i:end])) is not None:
                    heapq.heappush(heap, (-score, i, after[i], end))

        for i in range(n):
            push(i)
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            if not alive[i] or after[i] != middle or not alive[middle] or after[middle] != end:
                continue
            alive[middle], after[i] = False, end
            if end < n:
                before[end] = i
            push(before[i])
            push(i)
        ends, at = [], 0
        while at < n:
            at = after[at]
            ends.append(at)
        return ends

    def viterbi_long(self, word: str) -> list[int]:
        best, back = [0.0] + [-np.inf] * len(word), [0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for size in range(min(self.longest, end), 0, -1):
                score = self.scores.get(word[end - size : end], self.worst if size == 1 else -np.inf) + best[end - size]
                if score > best[end]:
                    best[end], back[end] = score, end - size
        ends, at = [], len(word)
        while at:
            ends.append(at)
            at = back[at]
        return ends[::-1]

    def _ids(self, word: str, ends: list[int]) -> bytes:
        out, at = [], 0
        for end in ends:
            piece = word[at:end]
            i = self.id_of.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
            elif not (self.kind == UNIGRAM and out and out[-1] == self.unknown_id):
                out.append(self.unknown_id)
            at = end
        return np.array(out, dtype="<i4").tobytes()

    def solve(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of distinct words."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out = {}
        for length, group in by_length.items():
            if length > BATCH_CHARS:
                for w in group:
                    out[w] = self._ids(w, (self.merge_long if self.kind == BPE else self.viterbi_long)(w))
                continue
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                out.update(zip(part, self._all_ids(part, *(self.merges if self.kind == BPE else self.viterbi)(part)), strict=True))
        return out

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = (BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK)
        if BLANK * 2 not in marked and "\0" not in marked:
            marked = marked.replace(BLANK, "\0" + BLANK)
            if self.lines_apart:
                marked = marked.replace("\n", "\0\n\0")
            return [w for w in marked.split("\0") if w]
        return _WORDS.findall(marked)

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        get = self.cache.get
        cut = [None if t is None else self.words(t) for t in texts]
        parts = [None if ws is None else [get(w) for w in ws] for ws in cut]
        missing = [[i for i, p in enumerate(ps) if p is None] if ps else [] for ps in parts]
        fresh = self.solve(list({ws[i] for ws, at in zip(cut, missing, strict=True) for i in at}))
        for ws, ps, at in zip(cut, parts, missing, strict=True):
            for i in at:
                ps[i] = fresh[ws[i]]
        out = [None if ps is None else b"".join(ps) for ps in parts]
        known = self.cache
        for w, ids in fresh.items():
            if len(known) >= CACHE_ENTRIES:
                break
            if len(w) <= CACHE_CHARS:
                known[w] = ids
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One model a worker."""
    return Model.from_file(path)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), values], [*(batch.schema.names[i] for i in kept), name])


#: Texts worked on together.
_ROWS = 500


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, text_col: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            ids = model(path).encode(batch.column(batch.schema.names.index(text_col)).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in ids])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join([x or b"" for x in ids]), dtype="<i4"))
            yield _with_column(batch, "ids", pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([x is None for x in ids])))


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            ids = batch.column(batch.schema.names.index("ids"))
            texts = [None if not x.is_valid else model(path).decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in ids]
            yield _with_column(batch, "decoded", pa.array(texts, pa.string()))


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ids: array of int."""
    return docs.mapInArrow(lambda batches: encode_batches(batches, model_path, text_col), _schema(docs, "ids", T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` (with a column ids) with decoded: string."""
    return docs.mapInArrow(lambda batches: decode_batches(batches, model_path), _schema(docs, "decoded", T.StringType()))


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ids and decoded, in one pass of the workers."""
    schema = T.StructType([*_schema(docs, "ids", T.ArrayType(T.IntegerType())).fields, T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(lambda batches: decode_batches(encode_batches(batches, model_path, text_col), model_path), schema)
