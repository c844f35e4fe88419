"""SimHash near-duplicates through an inverted index of positional bytes, with count filtering.

Fingerprints of 64 bits that differ in at most `most` bits differ in at most that many of their 8 bytes, so they share at least
8 - most bytes at their own positions (four, where four bits may differ). The index has postings of such positional bytes. One
byte alone would bring every 256th fingerprint together, so a posting is an intersection of several: its key is a set of
positions and the bytes there, and the sets are chosen so that any four positions hold one of them (20 sets of three positions, or
all 70 of four for very many fingerprints). Whoever meets in a posting is tallied: pairs that share fewer positional bytes than the
guaranteed minimum are refuted, the others verified bit by bit.

Equal fingerprints are one class before anything meets, and a posting yields no pairs but the edges of a forest that connects
what its links connect, so groups of copies grow linearly. A posting of more than BLOCK fingerprints is dealt in blocks, each pair
of blocks a group of its own, so no task compares more than a bounded number at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard import components
from .store import left_join_small, spread, written

SEED = 42
WIDTH = 4
#: Fingerprints compared in a group at most (about).
BLOCK = 4096
#: Distinct fingerprints up to which postings of three bytes are short.
FEW = 1 << 26
#: Bytes of a text that are taken apart at once.
PIECE = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = re.compile(rb"[ \t-\r]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of the text, some at a time: each piece begins with the last words of the one before, as many as a shingle lacks."""
    at, carry = 0, []
    while at < len(text):
        found = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = found.start() if found else len(text)
        words = carry + text[at:end].translate(_LOWER).split()
        at, carry = end, words[1 - WIDTH :]
        yield words


def fingerprint(text: bytes) -> int:
    """The majority of each bit over the hashes of all shingles, repeats included; 0 without words."""
    ones, total, last = np.zeros(64, np.int64), 0, []
    for words in _pieces(text):
        last = words
        if len(words) >= WIDTH:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(WIDTH)), strict=False)), repeat(SEED)), np.uint64)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(hashes)
    if not total and last:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and print (the fingerprint's 64 bits as a long) for every row; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x) if x else 0 for x in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["key", "print"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, print bigint")


def position_sets(together: int) -> list[tuple[int, ...]]:
    """Sets of so many of the 8 positions (3 or 4) such that every four positions contain one: all sets of four, or for three the
    classic cover by three rings: a triple inside a ring, or two positions of one ring and one of the next."""
    if together == 4:
        return list(combinations(range(8), 4))
    ring = (0, 0, 0, 1, 1, 1, 2, 2)
    return [s for s in combinations(range(8), 3) if len({ring[p] for p in s}) == 1 or any(sorted((ring[p] - r) % 3 for p in s) == [0, 0, 1] for r in range(3))]


def _keys(together: int) -> Column:
    byte = [F.shiftrightunsigned("print", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = []
    for k, positions in enumerate(position_sets(together)):
        key = F.lit(k).cast("bigint")
        for p in positions:
            key = key * 256 + byte[p]
        keys.append(key)
    return F.explode(F.array(*keys))


def _close(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Whether pairs link: those with enough equal positional bytes are verified by their bits."""
    odd = x ^ y
    any_bit = odd | (odd >> np.uint64(4))
    any_bit |= any_bit >> np.uint64(2)
    any_bit |= any_bit >> np.uint64(1)
    shared = 8 - np.bitwise_count(any_bit & np.uint64(0x0101010101010101)).astype(np.int8)
    found = shared >= 8 - most
    found[found] = np.bitwise_count(odd[found]) <= most
    return found


def forest(values: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what links among the values connect: breadth first, what was reached meets only what was not."""
    edges, left = [], values
    while len(left) > 1:
        front, left = left[:1], left[1:]
        root = front[0]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for k in range(0, len(front), 256):
                rest = np.flatnonzero(~hit)
                hit[rest[_close(front[k : k + 256, None], left[None, rest], most).any(0)]] = True
            front, left = left[hit], left[~hit]
            if len(front):
                edges.append((np.full(len(front), root), front))
    return edges


def _meet(most: int):
    """Edges of each group, of rows that come sorted by group. Short groups are compared at a distance of one row, two rows and so
    on, all groups at once."""
    short = 8

    def of(group: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, len(group)))
        size = np.repeat(sizes, sizes)
        for d in range(1, min(short, int(sizes.max(initial=0)))):
            at = np.flatnonzero((group[d:] == group[:-d]) & (size[d:] <= short))
            if len(at):
                at = at[_close(value[at], value[at + d], most)]
                yield value[at], value[at + d]
        for k in np.flatnonzero(sizes > short).tolist():
            yield from forest(value[starts[k] : starts[k] + sizes[k]], most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            group = np.concatenate([group, b.column(0).to_numpy(zero_copy_only=False)])
            value = np.concatenate([value, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = int(np.searchsorted(group, group[-1])) if len(group) else 0
            yield from out(group[:whole], value[:whole])
            group, value = group[whole:], value[whole:]
        yield from out(group, value)

    def out(group: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(group):
            for a, b in of(group, value):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def links(prints: DataFrame, n: int, most: int = 4, together: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct values of print that connect all of them that links of at most `most` bits connect.
    n: their number, which sets the number of tasks."""
    if not 0 <= most <= 4:
        raise ValueError("position sets are guaranteed for up to four differing bits")
    postings = prints.select(_keys(together).alias("key"), "print")
    half = max(1, block // 2)
    hot = postings.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("key").alias("hot"), F.ceil(F.col("n") / half).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("own"))
    pairs = F.transform(others, lambda j: F.xxhash64("key", F.least(j, "own"), F.greatest(j, "own")))
    dealt = left_join_small(postings, hot, "key", "hot").withColumn("own", own)
    dealt = dealt.select(F.explode(F.when(F.col("blocks").isNull(), F.array(F.xxhash64("key"))).otherwise(pairs)).alias("group"), "print")
    return dealt.repartition(spread(n * len(position_sets(together)), 4_000_000, prints.sparkSession), "group").sortWithinPartitions("group").mapInArrow(_meet(most), "a bigint, b bigint")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 4) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id for every row of docs.

    A text's fingerprint is the bitwise majority over the XXH64 hashes (seed 42) of its runs of four words (A-Z lower-cased,
    repeats included, all words as one if there are fewer); null texts and texts without words have fingerprint zero, which links
    like any other. Rows link if at most `most` (up to 4) bits differ; component_id is the least key reachable by links, the row's
    own included. Repeated rows are linked; null keys take part but are a component_id only where a component has no other. An empty
    table gives an empty result. Other columns are not carried, so their names do not matter.
    """
    prints = written(fingerprints(docs, key, text), "prints")
    classes = written(prints.groupBy("print").agg(F.min("key").alias("least")), "classes")
    n = classes.count()
    roots = components(links(classes.select("print"), n, most, together=3 if n <= FEW else 4))
    linked = classes.join(roots, F.col("print") == F.col("id"))
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    of = roots.join(least, "root").select(F.col("id").alias("print"), "component")
    whole = written(classes.join(of, "print", "left").select("print", F.coalesce("component", "least").alias("component_id")), "components")
    hexed = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return prints.join(whole, "print").select(F.col("key").alias(key), hexed, "component_id")
