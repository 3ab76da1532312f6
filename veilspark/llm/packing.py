"""Vector bin packing of tokenized examples into sequences.

Each example has three sizes: tokens, segments (one) and loss-bearing tokens; a sequence limits all three at once. The
open sequence takes, of a bounded window of waiting pieces, the one whose size vector has the largest dot product with
what the sequence has left, until none fits. With cutting allowed, pieces of full length go out at once, and what a
sequence still lacks is cut from the largest waiting piece; a partition's last sequence is cut into lengths that are
powers of two, which need no padding.

Partitions pack by themselves, straight off the scan: nothing is shuffled, and a repeated task gives the same pieces.
Null text is empty text (its end id alone); null and repeated ids are packed as they come; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizer import byte_bpe

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: Bits of sequence_id that number the sequences of one partition.
SEQUENCE_BITS = 40


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024
    cut: bool = True
    window: int = 256


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int
    loss_from: int

    def loss(self, length: int | None = None) -> int:
        end = self.start + (len(self.ids) if length is None else length)
        return max(0, end - max(self.start, self.loss_from))

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens, self.loss_from), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens, self.loss_from)


class Packer:
    """Takes pieces, gives out closed sequences (lists of pieces)."""

    def __init__(self, limits: Limits):
        self.limits, self.waiting = limits, []
        self.sizes: list[tuple[int, int, int]] = []  # of the waiting pieces

    def wait(self, piece: Piece) -> None:
        self.waiting.append(piece)
        self.sizes.append((len(piece.ids), 1, piece.loss()))

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        cap = self.limits
        if cap.cut:
            while len(piece.ids) >= cap.tokens and piece.loss(cap.tokens) <= cap.loss_tokens:
                full, piece = piece.split(cap.tokens)
                yield [full]
            while piece.loss() > cap.loss_tokens or len(piece.ids) > cap.tokens:
                part, piece = piece.split(min(cap.tokens, max(1, piece.loss_from - piece.start) if piece.loss_from > piece.start else cap.loss_tokens))
                self.wait(part)
        elif len(piece.ids) > cap.tokens or piece.loss() > cap.loss_tokens:
            raise ValueError(f"document {piece.doc_id} exceeds a limit and cutting is off")
        if len(piece.ids):
            self.wait(piece)
        while len(self.waiting) > cap.window:
            yield self.fill()

    def fill(self) -> list[Piece]:
        """One sequence from the waiting pieces."""
        cap, chosen = self.limits, []
        sizes = np.array(self.sizes, dtype=np.int64)
        scaled = sizes / np.array([cap.tokens, cap.segments, cap.loss_tokens])
        left = np.array([cap.tokens, cap.segments, cap.loss_tokens], dtype=np.int64)
        free = np.ones(len(sizes), dtype=bool)
        while left[0] and left[1]:
            fits = free & (sizes <= left).all(axis=1)
            if not fits.any():
                break
            score = scaled @ (left / np.array([cap.tokens, cap.segments, cap.loss_tokens]))
            best = int(np.argmax(np.where(fits, score, -1.0)))
            free[best] = False
            left -= sizes[best]
            chosen.append(self.waiting[best])
        if cap.cut and left[0] and left[1] and free.any():
            largest = int(np.argmax(np.where(free, sizes[:, 0], -1)))
            piece = self.waiting[largest]
            take = int(min(left[0], len(piece.ids)))
            if piece.loss(take) > left[2]:
                take = max(0, int(max(piece.loss_from - piece.start, 0) + left[2]))
            if take:
                part, rest = piece.split(take)
                chosen.append(part)
                free[largest] = len(rest.ids) > 0
                self.waiting[largest], self.sizes[largest] = rest, (len(rest.ids), 1, rest.loss())
        self.waiting, self.sizes = (list(compress(x, free)) for x in (self.waiting, self.sizes))
        return chosen

    def close(self) -> Iterator[list[Piece]]:
        while self.waiting:
            sequence = self.fill()
            total = sum(len(p.ids) for p in sequence)
            if not self.limits.cut or total == self.limits.tokens:
                yield sequence
                continue
            for bit in reversed(range(total.bit_length())):  # the sum of a length's powers of two
                if not total >> bit & 1:
                    continue
                need, part = 1 << bit, []
                while need:
                    piece = sequence.pop(0)
                    if len(piece.ids) > need:
                        piece, rest = piece.split(need)
                        sequence.insert(0, rest)
                    part.append(piece)
                    need -= len(piece.ids)
                yield part


def packed_batches(batches: Iterator[pa.RecordBatch], encode: Callable[[str], bytes], limits: Limits, end_id: int, partition: int) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text, loss_from) to batches of pieces."""
    packer, number, rows, held = Packer(limits), 0, [], 0
    end = np.array([end_id], dtype="<u4").tobytes()

    def put(sequence: list[Piece]) -> None:
        nonlocal number, held
        at = 0
        for p in sequence:
            rows.append((p.doc_id, p.start, len(p.ids), p.ids.tobytes(), p.doc_tokens, (partition << SEQUENCE_BITS) + number, at))
            at += len(p.ids)
        held += at
        number += 1

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    for source in batches:
        for doc_id, text, loss_from in zip(source.column(0).to_pylist(), source.column(1), source.column(2).to_pylist(), strict=True):
            ids = np.frombuffer(encode(text.as_py() or "") + end, dtype="<u4")
            for sequence in packer.add(Piece(doc_id, 0, ids, len(ids), loss_from or 0)):
                put(sequence)
            if held >= 1 << 20:
                yield batch()
                rows.clear()
                held = 0
    for sequence in packer.close():
        put(sequence)
    if rows:
        yield batch()


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", loss_from: str = "0", end_id: int = 0, limits: Limits = Limits()) -> DataFrame:
    """Pieces with their ids (binary, little-endian unsigned 32-bit). ``loss_from``: SQL of the first token that bears loss."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        yield from packed_batches(batches, byte_bpe(tokenizer_path).encode, limits, end_id, TaskContext.get().partitionId())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.expr(loss_from).cast("long").alias("loss_from")).mapInArrow(run, SCHEMA)
