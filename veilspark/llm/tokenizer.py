"""Byte-level BPE ids at speed: the tokenizer file's own ids, by way of a bounded cache of blank-delimited chunks.

Between a non-space and a blank followed by a non-space the pre-tokenizer always cuts, so a text split at single blanks
is tokenized chunk by chunk. Texts in which white space precedes a blank, or that hold a special token's string, go to
the tokenizer whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from struct import pack

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the pre-tokenizer's pattern of byte-level BPE files of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that one worker remembers at most.
CACHE_ENTRIES = 300_000
#: Chunks longer than this are not remembered.
CACHE_CHARS = 40


def _byte_of() -> dict[str, int]:
    """The printable stand-ins for bytes in such files: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Chunks(dict):
    """Ids of chunks behind a blank: known ones are looked up without a step of Python, others made."""

    def __init__(self, pieces: tiktoken.Encoding):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, chunk: str) -> bytes:
        found = self.pieces.encode_ordinary(" " + chunk)
        ids = pack(f"<{len(found)}I", *found)
        if len(self) < CACHE_ENTRIES and len(chunk) <= CACHE_CHARS:
            self[chunk] = ids
        return ids


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.pieces = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("|".join([r"\s ", *map(re.escape, special)]))
        self.cache = _Chunks(self.pieces)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without special tokens added."""
        if not text:
            return b""
        if self.odd.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *chunks = text.split(" ")
        head = np.array(self.pieces.encode_ordinary(first), dtype="<u4").tobytes()
        return head + b"".join(map(self.cache.__getitem__, chunks))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One tokenizer a worker."""
    return ByteBpe(path)
