"""Substring deduplication by level-wise doubling.

A window of `width` words is removed if its words also start anywhere else. To find such windows, lengths double: 8, 16, 32,
and last the width itself. At each length every window that is still a candidate is represented by one of its sub-windows of
that length, the one with the least hash (leftmost of equal ones). Equal windows choose the same sub-window at the same place,
so a window can only repeat if its representative repeats, and as neighbouring windows share representatives, the short
lengths test a few hundredths of all positions. Only windows whose representative was found again are extended to twice the
length; rounds are skipped in bulk where no candidate survives.

Documents are dealt to blocks of bounded size by one shuffle, which all rounds read again. A round sends the distinct hashes
of each block, packed, to hash ranges, where they are counted, and one bit a hash comes back. A window that occurs a billion
times is thus at most one hash a block: no group of equal windows is ever gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import as_bytes, spread, without
from .words import scan, spaced, window_hashes

ADDED = ("n_words", "n_removed", "clean_text")
FIRST = 8
_SENT = "block int, bucket int, kind int, data binary"
_STATE, _HASHES = 0, 1
_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def lengths(width: int) -> list[int]:
    """The lengths of the rounds: doubling from FIRST while below the width, then the width."""
    out = []
    n = min(FIRST, width)
    while n < width:
        out.append(n)
        n *= 2
    return [*out, width]


def representatives(hashes: np.ndarray, length: int, width: int) -> np.ndarray:
    """For each window start, the start of its sub-window of the length with the least hash, leftmost of equal ones."""
    least = window_hashes(hashes, length)
    n = len(hashes) - width + 1
    at = np.arange(len(least))
    span, size = width - length + 1, 1
    while size * 2 <= span:
        right = least[size:] < least[:-size]
        least, at = np.where(right, least[size:], least[:-size]), np.where(right, at[size:], at[:-size])
        size *= 2
    if size < span:
        off = span - size
        right = least[off:] < least[:-off]
        at = np.where(right, at[off:], at[:-off])
    return at[:n]


class _Round:
    """What a block asks at one length: for each chunk the candidate windows, and the distinct hashes of their representatives."""

    def __init__(self, chunks, candidates: list[np.ndarray], length: int, width: int):
        self.candidates, self.hashes = candidates, []
        distinct, counts = [], []
        for c, at in zip(chunks, candidates, strict=True):
            if not len(at):
                self.hashes.append(np.zeros(0, np.uint64))
                continue
            own = window_hashes(c.hash, length)
            rep = at if length == width else representatives(c.hash, length, width)[at]
            self.hashes.append(own[rep])
            h, n = np.unique(own[np.unique(rep)], return_counts=True)
            distinct.append(h)
            counts.append(n)
        every = np.concatenate(distinct) if distinct else np.zeros(0, np.uint64)
        self.distinct, back = np.unique(every, return_inverse=True)
        self.twice = np.bincount(back, weights=np.concatenate(counts), minlength=len(self.distinct)) > 1 if len(every) else np.zeros(0, bool)

    def surviving(self, repeated: np.ndarray) -> list[np.ndarray]:
        """The candidates whose representative is among the distinct hashes marked as repeated."""
        return [at[repeated[np.searchsorted(self.distinct, h)]] if len(at) else at for at, h in zip(self.candidates, self.hashes, strict=True)]

    def sent(self, block: int, n_buckets: int, state: bytes) -> pa.Table:
        """The packed hashes for each bucket (hash range), with the marks of those found twice, and the block's state."""
        bucket = _bucket(self.distinct, n_buckets)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = [(block, block % n_buckets, _STATE, state)]
        for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=False):  # none if there are no hashes
            rows.append((block, int(bucket[a]), _HASHES, self.distinct[a:b].tobytes() + np.packbits(self.twice[a:b]).tobytes()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = next(k for k in range(len(data) * 8 // 65, -1, -1) if k * 8 + (k + 7) // 8 <= len(data))
    return np.frombuffer(data, np.uint64, n), np.unpackbits(np.frombuffer(data, np.uint8, offset=n * 8), count=n).astype(bool)


def _counted(key, rows):
    """For one hash range: a bit for each hash of each block, set if its window starts at two places or more."""
    blocks, kinds, data = (rows.column(x).to_pylist() for x in ("block", "kind", "data"))
    parts = [_unpack(d) if k == _HASHES else None for k, d in zip(kinds, data, strict=True)]
    lists = [p[0] for p in parts if p is not None]
    if lists:
        every = np.sort(np.concatenate(lists))
        again = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for block, kind, part, d in zip(blocks, kinds, parts, data, strict=True):
        if kind == _STATE:
            out.append(d)
            continue
        hashes, twice = part
        at = np.minimum(np.searchsorted(again, hashes), max(len(again) - 1, 0))
        out.append(np.packbits(twice | (again[at] == hashes) if len(again) else twice).tobytes())
    bucket = key[0].as_py()
    return pa.Table.from_arrays([rows.column("block"), pa.array([bucket] * len(out), pa.int32()), rows.column("kind"), pa.array(out, pa.binary())], schema=_ARROW)


def _state(chunks, candidates, width: int) -> bytes:
    marks = []
    for c, at in zip(chunks, candidates, strict=True):
        m = np.zeros(len(c.hash), bool)
        m[at] = True
        marks.append(m)
    return np.packbits(np.concatenate(marks)).tobytes() if marks else b""


def _read_state(chunks, state: bytes) -> list[np.ndarray]:
    total = sum(len(c.hash) for c in chunks)
    marks = np.unpackbits(np.frombuffer(state, np.uint8), count=total).astype(bool)
    out, at = [], 0
    for c in chunks:
        out.append(np.flatnonzero(marks[at : at + len(c.hash)]))
        at += len(c.hash)
    return out


def _answers(asked: _Round, rows: pa.Table, n_buckets: int) -> np.ndarray:
    """The returned bits, for the distinct hashes of the round."""
    n = np.bincount(_bucket(asked.distinct, n_buckets), minlength=n_buckets)
    got = {b: d for b, k, d in zip(*(rows.column(x).to_pylist() for x in ("bucket", "kind", "data")), strict=True) if k == _HASHES}
    parts = [np.unpackbits(np.frombuffer(got[b], np.uint8), count=n[b]) for b in np.flatnonzero(n).tolist()]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def remove_repeats(docs: DataFrame, text: str = "text", width: int = 35, block_bytes: int = 12_000_000) -> DataFrame:
    """Every row of docs (without the text) with n_words, n_removed and clean_text, the words that stay joined by one space.

    A word goes if a window of `width` words that covers it also starts anywhere else, in its own text too; windows are judged
    on the input. Texts shorter than the width lose nothing; null and empty texts have no words and an empty clean_text;
    repeated rows are documents of their own, so copies of width words or more go wholly; columns whose names clash with an
    added column are replaced. Windows are compared by a hash of 64 bits, at every length again.
    """
    spark = docs.sparkSession
    rule = spaced()
    steps = lengths(width)
    base = without(docs, *(x for x in ADDED if x != text), "_row", "_bytes", "_block")
    size = base.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n_blocks = spread(size, block_bytes, spark)
    n_buckets = n_blocks
    rest = [f for f in base.schema.fields if f.name.lower() != text.lower()]
    rows = base.select(*(f.name for f in rest), as_bytes(text).alias("_bytes"), F.monotonically_increasing_id().alias("_row"))
    blocks = rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(n_blocks)).cast("int")).groupBy("_block")

    def chunks_of(table: pa.Table) -> tuple[pa.Table, list]:
        table = table.sort_by("_row")
        return table, list(scan(table.column("_bytes"), rule))

    def first(key, table):
        _, chunks = chunks_of(table)
        candidates = [c.windows(width)[0] for c in chunks]
        return _Round(chunks, candidates, steps[0], width).sent(key[0].as_py(), n_buckets, _state(chunks, candidates, width))

    def survivors(chunks, back: pa.Table, k: int) -> list[np.ndarray]:
        state = next(d for x, d in zip(back.column("kind").to_pylist(), back.column("data").to_pylist(), strict=True) if x == _STATE)
        asked = _Round(chunks, _read_state(chunks, state), steps[k], width)
        return asked.surviving(_answers(asked, back, n_buckets))

    def extended(k: int):
        def step(key, table, back):
            _, chunks = chunks_of(table)
            candidates = survivors(chunks, back, k - 1)
            return _Round(chunks, candidates, steps[k], width).sent(key[0].as_py(), n_buckets, _state(chunks, candidates, width))

        return step

    def last(key, table, back):
        table, chunks = chunks_of(table)
        n_words, n_removed, texts = [], [], []
        for c, at in zip(chunks, survivors(chunks, back, len(steps) - 1), strict=True):
            cover = np.zeros(len(c.hash) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + width, -1)
            gone = np.cumsum(cover)[:-1] > 0
            removed = np.bincount(c.doc[gone], minlength=c.n_docs)
            n_words.append(c.n_words)
            n_removed.append(removed)
            for d in range(c.n_docs):
                own = c.text(d).split()
                if removed[d]:
                    own = [w for w, x in zip(own, gone[c.bounds[d] : c.bounds[d + 1]].tolist(), strict=True) if not x]
                texts.append(b" ".join(own))
        cat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.Table.from_arrays([*(table.column(f.name) for f in rest), cat(n_words), cat(n_removed), pa.array(texts, pa.binary()).cast(pa.string())], names=[*(f.name for f in rest), *ADDED])

    sent = blocks.applyInArrow(first, _SENT)
    for k in range(1, len(steps) + 1):
        back = sent.groupBy("bucket").applyInArrow(_counted, _SENT).groupBy("block")
        if k < len(steps):
            sent = blocks.cogroup(back).applyInArrow(extended(k), _SENT)
    schema = T.StructType([*rest, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("clean_text", T.StringType())])
    return blocks.cogroup(back).applyInArrow(last, schema)
