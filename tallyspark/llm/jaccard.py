"""N-gram Jaccard join by vertical partitioning.

The global order of all n-grams (their hash order) is cut into fragments; a text's set of n-grams falls into one segment a
fragment. Two sets of similarity t differ in at most d = (|x| + |y|) (1 - t) / (1 + t) n-grams, so of more than d segments one is
the same in both: equal segments are the keys under which sets meet, and no similar pair is missed (see Scheme). A meeting
pair is verified by counting its overlap fragment by fragment and summing the partial counts.

Groups of copies are never expanded into pairs. Equal sets are one class from the start. Each class is first compared with one
other class, one that meets many, and what these links connect is one component; then sets outside of the largest component at a
key with one of its sets there. Pairs are then sought only between components that are still apart, only where enough keys are shared, only where the sizes leave room for a link after the n-grams that at most RARE candidates have
(sets that share such n-grams are paired by them, and their count bounds the overlap), and only where the sets' sketches do not
differ in more bits than similar sets can differ in n-grams. All other pairs cannot link or are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import as_bytes, forget, is_small, spread, without, written
from .words import mix, scan, spaced, window_hashes

ADDED = ("n_shingles", "component_id")
#: Fragments in which overlaps are counted.
PARTS = 4
#: Sets that share an n-gram up to which it counts as rare.
RARE = 8
#: Bits of a set's sketch, and the columns that hold them.
BITS = 1024
_SKETCH = tuple(f"b{k}" for k in range(BITS // 64))
#: Times that sets which share too few keys are left out; a second time finds hardly any more.
PRUNED = 1
#: Keys that a task holds before it passes them on, which bounds its memory.
HELD_KEYS = 200_000
#: Bytes (as JSON) up to which a table of ids is broadcast.
SMALL = 32_000_000
_U = np.uint64


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk of texts the number of texts, and for all distinct n-grams, ordered by text and hash, text and hash."""
    for c in scan(column, spaced(lower=True)):
        at, h = c.windows(width)
        docs, hashes = [c.doc[at]], [h]
        for n in range(1, width):
            short = np.flatnonzero(c.n_words == n)
            if len(short):
                docs.append(short)
                hashes.append(mix(window_hashes(c.hash, n)[c.bounds[:-1][short]] + _U(n)))
        doc, h = np.concatenate(docs), np.concatenate(hashes)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        yield c.n_docs, doc[new], h[new]


def _set_ids(n_docs: int, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and id (a hash of the set) of each text's set."""
    n = np.bincount(doc, minlength=n_docs)
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(mix(h + _U(0x51ED270B)), out=total[1:])
    edge = np.zeros(n_docs + 1, np.int64)
    np.cumsum(n, out=edge[1:])
    return n, mix(total[edge[1:]] - total[edge[:-1]] + n.astype(_U)).view(np.int64)


class Scheme:
    """Which segments of a set are its keys. Sizes are cut into classes by a factor of at least 1 / t, so that similar sets are in
    the same class or in neighbouring ones; a set has keys for its own class and, if a similar set can be there, for the next.

    Of a set's non-empty segments, in order, the first d + k are keys: d is the most n-grams in which it can differ from a
    similar set, and k a number of the class. Similar sets then have at least k keys of the class in common: take the one whose
    keys end first; at most d of its segments are not the other's as well, and the rest are among the keys of both. A set with
    fewer segments has them all as keys, and the empty fragments as well, which the same count holds for. So no pair is lost,
    and sets that share fewer keys than k, by a common passage for example, need no look. The lowest bit of a key is that of the
    class's number."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.edges = np.cumprod([1, *[max(2, -(-q // p))] * 40], dtype=np.float64).clip(max=2.0**60).astype(np.int64)

    def differ(self, total: np.ndarray) -> np.ndarray:
        """The most n-grams that similar sets with so many together can differ in."""
        return total * (self.q - self.p) // (self.q + self.p)

    def least(self, top: np.ndarray) -> np.ndarray:
        """k of the class of sets up to a size."""
        return 1 + self.differ(2 * top) // 4

    def fragments(self, top: np.ndarray) -> np.ndarray:
        """Fragments of a class of sets up to a size; some to spare for empty ones."""
        n = self.differ(2 * top) + self.least(top)
        return n + n * 15 // 100 + 8

    def needed(self, n: Column, key: Column) -> Column:
        """k of the class that a key of a set of n n-grams belongs to."""
        own = F.size(F.filter(F.array(*(F.lit(int(e)) for e in self.edges[:-2])), lambda e: e <= n)) - 1
        level = own + (own + key) % 2
        return F.element_at(F.array(*(F.lit(int(x)) for x in self.least(self.edges[1:] - 1))), (level + 1).cast("int"))

    def keys(self, n_docs: int, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, key) of all texts; n-grams are ordered by text and hash."""
        n = np.bincount(doc, minlength=n_docs)
        own = np.maximum(np.searchsorted(self.edges, n, "right") - 1, 0)
        largest = n * self.q // self.p
        docs, keys = [], []
        for off in (0, 1):
            level, top = own + off, self.edges[own + off + 1] - 1
            # next class: only if a similar set can be in it
            most = np.where(largest >= self.edges[level], self.differ(n + np.minimum(top, largest)), 0)
            take = most + self.least(top)
            parts = self.fragments(top)
            odd = (level & 1).astype(_U)
            use = (most > 0)[doc]  # sets that can differ in nothing are equal
            d, x = doc[use], h[use]
            if not len(d):
                continue
            f = ((x >> _U(32)) * parts[d].astype(_U) >> _U(32)).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (f[1:] != f[:-1])]))
            segment = np.add.reduceat(mix(x), start)
            d, f = d[start], f[start]
            rank = np.arange(len(d)) - np.searchsorted(d, d)
            few = (np.bincount(d, minlength=n_docs) < take) & (most > 0)
            for k in np.flatnonzero(few).tolist():
                empty = np.setdiff1d(np.arange(parts[k]), f[d == k])
                docs.append(np.full(len(empty), k))
                keys.append(mix(mix((level[k] << 34).astype(_U) + empty.astype(_U))) & ~_U(1) | odd[k])
            first = rank < take[d]
            d, f, segment = d[first], f[first], segment[first]
            docs.append(d)
            keys.append(mix(segment + mix((level[d] << 34).astype(_U) + f.astype(_U))) & ~_U(1) | odd[d])
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        return np.concatenate(docs), np.concatenate(keys)


def _features(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n_docs, doc, h in shingle_sets(batch.column(1), width):
                n, i = _set_ids(n_docs, doc, h)
                sizes.append(n)
                ids.append(i)
            n = np.concatenate(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.concatenate(ids), pa.int64(), mask=n == 0)], names=["_doc", "n_shingles", "_id"])

    rows = docs.select(F.col(key).alias("_doc"), as_bytes(text).alias("_bytes"))
    return rows.mapInArrow(run, T.StructType([rows.schema["_doc"], T.StructField("n_shingles", T.LongType()), T.StructField("_id", T.LongType())]))


_PACKED = "bucket int, keys binary, ids binary"


def _packed(keys: np.ndarray, ids: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys with their ids, one row for each range of keys."""
    bucket = ((keys >> _U(32)) * _U(n_buckets) >> _U(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    rows = [(int(bucket[a]), keys[a:b].tobytes(), ids[a:b].tobytes()) for a, b in zip(edges, [*edges[1:], len(keys)], strict=False)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "ids"])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, ids = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", _U), ("ids", np.int64)))
    order = np.lexsort((ids, keys))
    return keys[order], ids[order]


def _shared(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted (key, id): the distinct ones, whether the key has another id, and whether the id is the key's least."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    at = np.flatnonzero(new)
    k = keys[at]
    first = np.ones(len(at), bool)
    first[1:] = k[1:] != k[:-1]
    group = np.cumsum(first) - 1
    return at, (np.bincount(group) > 1)[group] if len(at) else first, first


def _members(docs: DataFrame, text: str, width: int, scheme: Scheme, n_buckets: int) -> DataFrame:
    """(key, id) for all keys that several sets share. A task names the sets that share a key among its own texts itself (they
    go to any bucket under 0, which passes them through) and sends only the least id to the key's bucket, so that a key
    arrives there at most once from each block of HELD_KEYS."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_keys, all_ids, held = [], [], 0
            seen: set[int] = set()
            for n_docs, doc, h in shingle_sets(batch.column(0), width):
                _, ids = _set_ids(n_docs, doc, h)
                fresh = np.zeros(n_docs, bool)
                for d in np.unique(doc).tolist():
                    if int(ids[d]) not in seen:
                        seen.add(int(ids[d]))
                        fresh[d] = True
                use = fresh[doc]
                d, k = scheme.keys(n_docs, doc[use], h[use])
                all_keys.append(k)
                all_ids.append(ids[d])
                held += len(k)
                if held >= HELD_KEYS:
                    yield from sent_on(all_keys, all_ids)
                    all_keys, all_ids, held = [], [], 0
            if held:
                yield from sent_on(all_keys, all_ids)

    def sent_on(all_keys: list[np.ndarray], all_ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, ids = np.concatenate(all_keys), np.concatenate(all_ids)
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        at, several, first = _shared(keys, ids)
        keys, ids = keys[at], ids[at]
        yield from _packed(keys[first], ids[first], n_buckets)
        if several.any():
            any_bucket = -1 - int(keys[several][0] % _U(n_buckets))
            yield pa.RecordBatch.from_arrays([pa.array([any_bucket], pa.int32()), pa.array([keys[several].tobytes()], pa.binary()), pa.array([ids[several].tobytes()], pa.binary())], names=["bucket", "keys", "ids"])

    def meet(key, table):
        keys, ids = _unpacked(table)
        at, several, _ = _shared(keys, ids)
        if key[0].as_py() >= 0:
            at = at[several]
        return pa.table({"key": pa.array(keys[at].view(np.int64), pa.int64()), "id": pa.array(ids[at], pa.int64())})

    sent = docs.select(as_bytes(text).alias("_bytes")).mapInArrow(emit, _PACKED)
    return sent.groupBy("bucket").applyInArrow(meet, "key long, id long").distinct()


def _odd() -> Column:
    """The lowest bit of a key."""
    return F.col("key").bitwiseAND(F.lit(1))


def _worth_a_look(members: DataFrame, sizes: DataFrame, scheme: Scheme) -> DataFrame:
    """Members (key, id) without those of sets that share too few keys of a class with all others together, and without keys
    that a single set is left at. sizes: id, n."""
    counts = members.groupBy("id", _odd().alias("odd")).agg(F.count("*").alias("c")).join(sizes, "id")
    enough = counts.where(F.col("c") >= scheme.needed(F.col("n"), F.col("odd"))).select("id", "odd")
    left = members.withColumn("odd", _odd()).join(enough, ["id", "odd"], "left_semi").drop("odd")
    several = left.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return left.join(several, "key", "left_semi").select("key", "id")


def _segments(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """id, part, n, and seg: the hashes (sorted, packed) of each wanted set that fall into each of PARTS fragments, and as part -1
    its parity sketch (see _sketches). wanted has _doc and id: a text that has the set. Other rows may have that _doc too, and sets of rows without one have a null _doc, so
    each task names the sets of its rows again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(1).to_pylist()
            at = 0
            for n_docs, doc, h in shingle_sets(batch.column(0), width):
                edge = np.searchsorted(doc, np.arange(n_docs + 1))
                own_ids = _set_ids(n_docs, doc, h)[1].tolist()
                for k in range(n_docs):
                    if edge[k] == edge[k + 1] or ids[at + k] not in (None, own_ids[k]):
                        continue
                    own = h[edge[k] : edge[k + 1]]
                    cut = np.searchsorted((own >> _U(32)) * _U(PARTS) >> _U(32), np.arange(PARTS + 1, dtype=_U))
                    rows += [(own_ids[k], part, len(own), own[cut[part] : cut[part + 1]].tobytes()) for part in range(PARTS)]
                    rows.append((own_ids[k], -1, len(own), np.packbits(np.bincount((own % _U(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()))
                at += n_docs
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["id", "part", "n", "seg"])

    rows = docs.select(F.col(key).alias("_doc"), as_bytes(text).alias("_bytes"))
    wanted = written(wanted, "wanted")
    small = is_small(wanted, SMALL)
    schema = "id long, part int, n long, seg binary"
    found = rows.join(F.broadcast(wanted) if small else wanted, "_doc").select("_bytes", "id").mapInArrow(run, schema)
    unnamed = wanted.where("_doc is null").select("id")
    if not unnamed.isEmpty():
        others = rows.where("_doc is null").select("_bytes", F.lit(None).cast("long").alias("id")).mapInArrow(run, schema)
        found = found.unionByName(others.join(F.broadcast(unnamed) if small else unnamed, "id", "left_semi"))
    out = written(found.dropDuplicates(["id", "part"]), "segments")
    forget(wanted)
    return out


def _sketches(segments: DataFrame) -> DataFrame:
    """id and b0, b1, ...: BITS bits, of which each n-gram of the set flips one. An n-gram that two sets have flips the same bit
    in both, so their sketches differ in no more bits than they differ in n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, BITS // 64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x), pa.int64()) for x in bits.T)], names=["id", *_SKETCH])

    return segments.where("part = -1").select("id", "seg").mapInArrow(run, ", ".join(f"{c} long" for c in ("id", *_SKETCH)))


def _links(pairs: DataFrame, segments: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) that are similar: overlaps are counted in each fragment and summed."""

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = []
            for x, y in zip(batch.column("_x").to_pylist(), batch.column("_y").to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, _U), np.frombuffer(y, _U)])
                both.sort(kind="stable")
                shared.append(int(np.count_nonzero(both[1:] == both[:-1])))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("_total"), pa.array(shared, pa.int64())], names=["a", "b", "total", "shared"])

    left = segments.select(F.col("id").alias("a"), "part", F.col("n").alias("_n"), F.col("seg").alias("_x"))
    right = segments.select(F.col("id").alias("b"), "part", F.col("n").alias("_m"), F.col("seg").alias("_y"))
    cut = pairs.select("a", "b", F.explode(F.array(*(F.lit(k) for k in range(PARTS)))).alias("part"))
    both = cut.join(left, ["a", "part"]).join(right, ["b", "part"]).select("a", "b", (F.col("_n") + F.col("_m")).alias("_total"), "_x", "_y")
    sums = both.mapInArrow(overlap, "a long, b long, total long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("s"), F.first("total").alias("t"))
    return sums.where(q * F.col("s") >= p * (F.col("t") - F.col("s"))).select("a", "b")


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """id and root (the least id) of everything that the links (a, b) connect, by alternating large and small stars. Rounds are
    in the order of the logarithm of the longest chain; should so many not be enough, that is an error and no partial result."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, edges = edges, written(small, "edges")
        forget(last)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    roots = written(roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct(), "roots")
    forget(edges)
    return roots


def _rare(segments: DataFrame, n_buckets: int) -> DataFrame:
    """Rare n-grams, those of at most RARE of the sets: (a, null, how many a has) and (a, b, how many both have)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segs = batch.column("seg").to_pylist()
            if not segs:
                continue
            ids = np.repeat(np.array(batch.column("id").to_pylist(), np.int64), [len(s) // 8 for s in segs])
            keys = np.frombuffer(b"".join(segs), _U)
            order = np.argsort(keys, kind="stable")
            keys, ids = keys[order], ids[order]
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            group = np.cumsum(first) - 1
            often = (np.bincount(group) > RARE)[group] if len(keys) else first
            # an n-gram that is common here already goes on once, as nobody's
            yield from _packed(keys[~often | first], np.where(often, 0, ids)[~often | first], n_buckets)

    def count(key, table):
        keys, ids = _unpacked(table)
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(first) - 1
        rare = ((np.bincount(group) <= RARE) & ~np.bincount(group[ids == 0], minlength=group[-1] + 1 if len(group) else 0).astype(bool))[group] if len(keys) else first
        keys, ids = keys[rare], ids[rare]
        left, right = [ids], [ids]
        for off in range(1, RARE):
            same = np.flatnonzero(keys[off:] == keys[:-off]) if len(keys) > off else np.zeros(0, np.int64)
            left.append(ids[same + off])
            right.append(ids[same])
        pairs, n = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1, return_counts=True)
        return _dealt(pairs, n, n_buckets)

    def total(key, table):
        a, b, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("a", "b", "n"))
        pairs, at = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
        own = pairs[0] == pairs[1]
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64(), mask=own), "n": pa.array(np.bincount(at.ravel(), weights=n, minlength=len(own)).astype(np.int64), pa.int64())})

    found = segments.where("part >= 0").select("id", "seg").mapInArrow(emit, _PACKED).groupBy("bucket").applyInArrow(count, "bucket int, a binary, b binary, n binary")
    return written(found.groupBy("bucket").applyInArrow(total, "a long, b long, n long"), "rare")


def _dealt(pairs: np.ndarray, n: np.ndarray, n_buckets: int) -> pa.Table:
    """Counts of pairs, packed by the bucket that sums them."""
    bucket = (mix(pairs[0].astype(np.int64).view(_U)) % _U(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    a, b, n = pairs[0][order], pairs[1][order], n[order].astype(np.int64)
    rows = [(int(bucket[i]), a[i:j].tobytes(), b[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(edges, [*edges[1:], len(bucket)], strict=False)]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "a", "b", "n"])


def _room(n: Column, u: Column, p: int, q: int) -> tuple[Column, Column]:
    """The least and the largest size of a set that one of n n-grams can be similar to, if u of them are not in the other."""
    low = F.ceil(n * p / F.lit(float(q)) - 1e-9).cast("long")
    # overlap <= n - u, and similar sets have (p + q) overlap >= p (n + m)
    high = F.floor((n - u) * (p + q) / F.lit(float(p)) - n + 1e-9).cast("long")
    return low, high


def _fewer(members: DataFrame) -> DataFrame:
    """Members (key, id, root and more) at keys of several components that are not of the largest there, with _most, its root,
    and _of, one of its sets there."""
    counts = members.groupBy("key", "root").agg(F.count("*").alias("c"), F.max_by("id", F.xxhash64("id", "key")).alias("of"))
    largest = counts.groupBy("key").agg(F.max_by(F.struct("root", "of"), F.struct("c", -F.col("root"))).alias("m"), F.count("*").alias("_roots"))
    largest = largest.where("_roots > 1").select("key", F.col("m.root").alias("_most"), F.col("m.of").alias("_of"))
    return members.join(largest, "key").where("root <> _most")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, p: int = 90, q: int = 100) -> DataFrame:
    """key, n_shingles and component_id for every row of docs.

    A text's set holds its distinct runs of `width` words (A-Z lower-cased), or all its words as one if it has fewer. Rows link
    if q |x and y| >= p |x or y|; component_id is the least key reachable by links, the row's own included. Rows without words
    or text link with nothing; repeated rows and copies are linked; null keys take part but are never a component_id unless
    their component has no other. N-grams and sets are compared by hashes of 64 bits. Other columns are not carried.
    """
    spark = docs.sparkSession
    scheme = Scheme(p, q)
    features = written(_features(docs, key, text, width), "features")
    size = features.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    per_gram = 2 * (q / p + 1) * (q - p) / (q + p) * 16
    n_buckets = spread(size * per_gram, 6_000_000, spark)
    classes = features.where("_id is not null").groupBy(F.col("_id").alias("id")).agg(F.min("_doc").alias("_doc"), F.count("*").alias("_rows"), F.first("n_shingles").alias("n"))
    classes = written(classes, "classes")
    members = written(_members(docs, text, width, scheme, n_buckets), "members")
    for _ in range(PRUNED):
        before, members = members, written(_worth_a_look(members, classes.select("id", "n"), scheme), "members")
        forget(before)
    # one candidate for each class: of the sets at its keys the one that meets most others, which is what copies resemble
    meets = members.join(members.groupBy("key").agg((F.count("*") - 1).alias("c")), "key").groupBy("id").agg(F.sum("c").alias("met"))
    heads = members.join(meets, "id").groupBy("key").agg(F.max(F.struct("met", F.col("id").alias("head"))).alias("h")).select("key", "h.head")
    stars = members.join(heads, "key").where("id <> head").groupBy("id", "head", _odd().alias("odd")).agg(F.count("*").alias("c"))
    stars = stars.groupBy("id").agg(F.max_by("head", F.struct("c", "head")).alias("head"))
    stars = written(stars.select(F.col("id").alias("a"), F.col("head").alias("b")), "stars")
    candidates = members.select("id").distinct()
    segments = _segments(docs, key, text, width, classes.join(candidates, "id").select("_doc", "id"))
    first = written(_links(stars, segments, p, q), "links")
    roots = components(first)
    forget(stars, first)
    # keys shared by several components, and what can still link there
    own = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = classes.select("id", "n")
    open_keys = own.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    open_members = written(own.join(open_keys, "key", "left_semi").join(sizes, "id"), "open")
    forget(members)
    # n-grams that few others have leave a set little room; pairs that share such n-grams are looked at one by one
    rare = _rare(segments.join(open_members.select("id").distinct(), "id", "left_semi"), n_buckets)
    few = rare.where("b is null").select(F.col("a").alias("id"), F.col("n").alias("u"))
    bare = open_members.join(few, "id", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    low, high = _room(F.col("n"), F.col("u"), p, q)
    left = written(bare.withColumns({"low": low, "high": high}).where("high >= low").join(_sketches(segments), "id"), "room")
    each = bare.select("id", "root", "n", "u").distinct()
    one, two = (each.select(*(F.col(c).alias(f"{c}_{x}") for c in each.columns)) for x in "ab")
    close = rare.where("b is not null").withColumnRenamed("n", "s").join(one, F.col("a") == F.col("id_a")).join(two, F.col("b") == F.col("id_b"))
    most = F.least(F.col("n_a") - F.col("u_a"), F.col("n_b") - F.col("u_b")) + F.col("s")
    close = close.where((F.col("root_a") != F.col("root_b")) & ((p + q) * most >= p * (F.col("n_a") + F.col("n_b")))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    sides = ("id", "root", "n", "low", "high", *_SKETCH)
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in _SKETCH), F.lit(0))
    room = (F.col("root") != F.col("_root")) & F.col("_n").between(F.col("low"), F.col("high")) & F.col("n").between(F.col("_low"), F.col("_high")) & (apart <= F.expr(f"(n + _n) * {q - p} div {q + p}"))
    pair = (F.greatest("id", "_id").alias("a"), F.least("id", "_id").alias("b"))
    # a set outside of a key's largest component first meets one set of that component at each key, another one at each
    fewer = _fewer(left)
    others = left.select(*(F.col(c).alias(f"_{c}") for c in sides)).distinct()
    some = fewer.join(others, F.col("_of") == F.col("_id")).where(room).select(*pair).unionByName(close).distinct()
    second = written(_links(some, segments, p, q), "links")
    edge = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))  # links are given by their roots, so rounds work on few edges
    known, roots = roots, components(edge.unionByName(second))
    forget(known, second)
    # what is still apart meets all sets of other components at its keys
    moved = roots.select("id", F.col("root").alias("_now"))
    left, before = written(left.join(moved, "id", "left").withColumn("root", F.coalesce("_now", "root")).drop("_now"), "room"), left
    other = left.select("key", *(F.col(c).alias(f"_{c}") for c in sides))
    # a pair counts once at a key: from the one that is not of the largest component, or else from the larger id
    once = (F.col("_root") == F.col("_most")) | (F.col("id") > F.col("_id"))
    met = _fewer(left).join(other, "key").where(room & once).select(*pair, _odd().alias("odd"), "n")
    met = met.groupBy("a", "b", "odd").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= scheme.needed(F.col("n"), F.col("odd")))
    third = written(_links(met.select("a", "b").distinct(), segments, p, q), "links")
    forget(open_members, rare, before, left, segments)
    edge = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
    known, roots = roots, components(edge.unionByName(third))
    forget(known, third)
    named = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("_doc").alias("component_id"), F.sum("_rows").alias("_size")).where("_size > 1").drop("_size")
    final = written(named.join(least, "root").select(F.col("id").alias("_id"), "component_id"), "components")
    forget(roots)
    if is_small(final, SMALL):
        final = F.broadcast(final)
    out = features.join(final, "_id", "left").select("_doc", "n_shingles", F.coalesce("component_id", "_doc").alias("component_id"))
    return out.withColumnRenamed("_doc", key)
