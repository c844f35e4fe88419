"""Vectorised scanning of words in Arrow text columns.

A batch of texts is handled as one byte buffer: a table says which bytes part words, cumulative sums give each word a 64-bit
hash, and no Python object is made for a word. Bytes of 0x80 and above are never separators here, so scanning UTF-8 bytes
gives the same words as scanning code points. Equal words have equal hashes. The sums are taken modulo 2**64, where long words
can be built that differ and yet have equal sums (it takes 2**10 bytes or more), so words over LONG bytes have a cryptographic hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are scanned in chunks of about this many bytes (one longer text is a chunk of its own).
CHUNK_BYTES = 1 << 19
#: Words of more bytes are hashed one by one.
LONG = 128
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Rule:
    """Which bytes part words, and the byte that each byte counts as."""

    separator: np.ndarray
    folded: np.ndarray


def _rule(separators, lower: bool) -> Rule:
    sep = np.zeros(256, bool)
    sep[list(separators)] = True
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
        sep[65:91] = sep[97:123]
    return Rule(sep, fold)


def spaced(lower: bool = False) -> Rule:
    """Words [^\\x20\\x09-\\x0D]+, with A-Z lower-cased if asked for."""
    return _rule([0x20, *range(0x09, 0x0E)], lower)


def alnum() -> Rule:
    """Lower-cases A-Z; words are then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    return _rule([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)], True)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 64)
        for k, base in enumerate((_ODD, _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


#: What a byte adds to a sum.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Consecutive texts of a column and their words."""

    first: int  # index in the column of the first text
    data: np.ndarray  # the texts' bytes
    offsets: np.ndarray  # of each text in data, and the end
    start: np.ndarray  # of each word in data
    end: np.ndarray
    doc: np.ndarray  # of each word, counted from first
    hash: np.ndarray
    bounds: np.ndarray  # index of each text's first word, and the number of words

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words at which a window of so many words of one text starts, and the windows' hashes."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(np.arange(width, n + 1) <= self.bounds[1:][self.doc[: n - width + 1]])
        return at, window_hashes(self.hash, width)[at]

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of so many consecutive hashes."""
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    n = len(hashes) - width + 1
    return mix((total[width:] - total[:n]) * down[:n])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def scan(column: pa.Array, rule: Rule, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The words of all texts of the column, chunk by chunk; every text is in one chunk, in order."""
    offsets, data = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk_bytes, "right")) - 1)
        yield _chunk(i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], rule)
        i = j
    pa.default_memory_pool().release_unused()  # a worker that is used again keeps no batch's memory


def _chunk(first: int, offsets: np.ndarray, data: np.ndarray, rule: Rule) -> Chunk:
    size = len(data)
    word = np.zeros(size + 1, bool)
    np.logical_not(rule.separator[data], out=word[:size])
    before = np.zeros(size + 1, bool)
    before[1:] = word[:-1]
    before[offsets] = False  # a word never reaches into the next text
    start = np.flatnonzero(word & ~before)
    after = np.zeros(size + 1, bool)
    after[:-1] = word[1:]
    inner = offsets[offsets > 0]
    after[inner - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    up, down = powers(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(BYTE[rule.folded[data]] * up[:size], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(rule.folded[data[start[k] : end[k]]].tobytes(), digest_size=8).digest(), "little")
    bounds = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(doc, minlength=len(offsets) - 1), out=bounds[1:])
    return Chunk(first, data, offsets, start, end, doc, hashes, bounds)
