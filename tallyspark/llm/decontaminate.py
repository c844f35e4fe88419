"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the normalised test items. Each document's words are streamed through it; the length
of the longest match that ends at a word says whether a window of `width` item words ends there. Only runs of words that occur
in the items at all are streamed; other words reset the match to nothing and are skipped in bulk.

Items are taken in blocks. The driver holds one block while its automaton is built, which takes some hundred bytes a word; what
is sent are sorted arrays of about twenty bytes a word, and all blocks are matched in one pass over the documents.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import as_bytes, without
from .words import alnum, scan

ADDED = ("n_words", "n_hit", "item_ids", "spans", "clean_text")


class Automaton:
    """A generalised suffix automaton over word hashes, with the items of every window."""

    def __init__(self, items: list[tuple[str, np.ndarray]], width: int):
        self.width = width
        self.names = [name for name, _ in items]
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = min((min(width, len(h)) for _, h in items), default=width)
        coded = [np.searchsorted(self.vocabulary, h).tolist() for _, h in items]
        for codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        self._own(coded)

    def _extend(self, last: int, code: int) -> int:
        to = self.next[last].get(code)
        if to is not None:
            if self.length[to] == self.length[last] + 1:
                return to
            return self._split(last, to, code)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and code not in self.next[p]:
            self.next[p][code] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][code]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, code)
        return new

    def _state(self, to: dict[int, int], length: int, link: int) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, code: int) -> int:
        twin = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(code) == q:
            self.next[p][code] = twin
            p = self.link[p]
        return twin

    def step(self, state: int, length: int, code: int) -> tuple[int, int]:
        """The longest match after one more word."""
        while state and code not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(code)
        return (0, 0) if to is None else (to, length + 1)

    def up(self, state: int, length: int) -> int:
        """The state of the suffix of so many words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _own(self, coded: list[list[int]]) -> None:
        """windows: items by the state of a whole window; shorts: by the state of a whole shorter item."""
        self.windows: dict[int, list[int]] = {}
        self.shorts: dict[int, list[tuple[int, int]]] = {}
        for item, codes in enumerate(coded):
            state = length = 0
            for code in codes:
                state, length = self.step(state, length, code)
                if length >= self.width:
                    state, length = self.up(state, self.width), self.width
                    own = self.windows.setdefault(state, [])
                    if not own or own[-1] != item:
                        own.append(item)
            if 0 < len(codes) < self.width:
                self.shorts.setdefault(state, []).append((len(codes), item))

    def packed(self) -> Packed:
        """The automaton as arrays."""
        keys, to = array("q"), array("i")
        for state, own in enumerate(self.next):
            for code in sorted(own):
                keys.append(state << 32 | code)
                to.append(own[code])
        own_windows = sorted(self.windows)
        lists = [self.windows[k] for k in own_windows]
        edges = array("i", [0, *np.cumsum([len(x) for x in lists]).tolist()])
        return Packed(self.width, self.shortest, self.names, self.vocabulary, keys, to, array("i", self.link), array("i", self.length), array("i", own_windows), edges, array("i", [i for x in lists for i in x]), self.shorts)


@dataclass
class Packed:
    """A finished automaton: transitions by state and code in order, and the items of the states that end a window."""

    width: int
    shortest: int
    names: list[str]
    vocabulary: np.ndarray
    keys: array
    to: array
    link: array
    length: array
    states: array
    edges: array
    items: array
    shorts: dict[int, list[tuple[int, int]]]

    def matches(self, codes: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, word after the last, items) of every window that occurs in a run of known words."""
        keys, n, link, lengths, width = self.keys, len(self.keys), self.link, self.length, self.width
        state = length = 0
        for k, code in enumerate(codes, 1):
            while True:
                at = bisect_left(keys, state << 32 | code)
                if at < n and keys[at] == state << 32 | code:
                    state, length = self.to[at], length + 1
                    break
                if not state:
                    length = 0
                    break
                state = link[state]
                length = lengths[state]
            if length >= width:
                own = state
                while lengths[link[own]] >= width:
                    own = link[own]
                at = bisect_left(self.states, own)
                yield k - width, k, self.items[self.edges[at] : self.edges[at + 1]]
            if self.shorts:
                at, reach = state, length
                while at > 0:
                    for words, item in self.shorts.get(at, ()):
                        if words <= reach:
                            yield k - words, k, [item]
                    at = link[at]
                    reach = lengths[at]


def _runs(known: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of known words within one document, of so many words at least."""
    if not len(known):
        return []
    cut = np.ones(len(known) + 1, bool)
    cut[1:-1] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
    edges = np.flatnonzero(cut)
    first, last = edges[:-1], edges[1:]
    keep = known[first] & (last - first >= least)
    return list(zip(first[keep].tolist(), last[keep].tolist(), strict=True))


def _matcher(automata, cut: bool):
    rule = alnum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[Packed] = cloudpickle.loads(automata.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            before = [batch.column(names.index(x)).to_pylist() for x in ("item_ids", "spans")] if "spans" in names else None
            found = _match(own, batch.column(names.index("_bytes")), rule, cut, before)
            rest = [k for k, name in enumerate(names) if name not in ("_bytes", *ADDED)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), *found], names=[*(names[k] for k in rest), *ADDED])

    return run


def _match(automata: list[Packed], column: pa.Array, rule, cut: bool, before: list | None) -> list[pa.Array]:
    """The added columns. before: item_ids and spans of automata that were matched already."""
    n_words, n_hit, items, spans, texts = [], [], [], [], []
    row = 0
    for chunk in scan(column, rule):
        hit = np.zeros(len(chunk.hash) + 1, np.int64)
        of: dict[int, set[str]] = {}
        if before:
            for k in range(chunk.n_docs):
                of[k] = set(before[0][row + k])
                for x in before[1][row + k]:
                    hit[chunk.bounds[k] + x["start"]] += 1
                    hit[chunk.bounds[k] + x["start"] + x["n"]] -= 1
        for own in automata:
            if not len(own.vocabulary) or not len(chunk.hash):
                continue
            at = np.minimum(np.searchsorted(own.vocabulary, chunk.hash), len(own.vocabulary) - 1)
            known = own.vocabulary[at] == chunk.hash
            for first, last in _runs(known, chunk.doc, own.shortest):
                for a, b, which in own.matches(at[first:last].tolist()):
                    hit[first + a] += 1
                    hit[first + b] -= 1
                    of.setdefault(int(chunk.doc[first]), set()).update(own.names[i] for i in which)
        covered = np.cumsum(hit)[:-1] > 0
        n_words.append(chunk.n_words)
        n_hit.append(np.bincount(chunk.doc[covered], minlength=chunk.n_docs))
        by_doc: dict[int, list[list[int]]] = {}
        for first, last in _runs(covered, chunk.doc, 1):
            by_doc.setdefault(int(chunk.doc[first]), []).append([first, last])
        for k in range(chunk.n_docs):
            items.append(sorted(of.get(k, ())))
            spans.append([{"start": a - int(chunk.bounds[k]), "n": b - a} for a, b in by_doc.get(k, ())])
            if cut and k in by_doc:
                keep, at_byte = [], chunk.offsets[k]
                for a, b in by_doc[k]:
                    keep.append(chunk.data[at_byte : chunk.start[a]].tobytes())
                    at_byte = chunk.end[b - 1]
                texts.append(b"".join([*keep, chunk.data[at_byte : chunk.offsets[k + 1]].tobytes()]).decode())
            else:
                texts.append(None)
        row += chunk.n_docs
    join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
    span = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))
    return [join(n_words), join(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, span), pa.array(texts, pa.string())]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("n", T.LongType())]))


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, cut: bool = False, block_bytes: int = 1_000_000, pass_bytes: int = 128_000_000
) -> DataFrame:
    """Every row of docs with n_words, n_hit (words inside an occurrence of a window), item_ids (of the items with occurring
    windows, as strings, sorted), spans (hit runs: first word, number of words) and, if cut, clean_text (the text without
    these runs; null where nothing is hit).

    A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window. The items are
    taken in blocks of about block_bytes, each made into an automaton and packed; as many as take pass_bytes together are sent
    to the executors and matched in one pass, in place, without a shuffle. Should there be more, further passes add their
    hits to the rows. Nulls and empty texts have no words; items without words match nothing; of an empty item table nothing
    is hit; repeated rows are judged each; columns of docs whose names clash with an added column are replaced. Items with
    equal ids count once.
    """
    spark = docs.sparkSession
    known = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("_id"), as_bytes(item_text).alias("_bytes"))
    total = known.agg(F.coalesce(F.sum(F.octet_length("_bytes")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // block_bytes))
    out = without(docs, *ADDED, "_bytes")
    schema = T.StructType([*out.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", _SPANS), T.StructField("clean_text", T.StringType())])
    rule, packed, size = alnum(), [], 0
    for block in range(n_blocks):
        part = known if n_blocks == 1 else known.where(F.pmod(F.xxhash64("_id", "_bytes"), F.lit(n_blocks)) == block)
        coded = [(str(name), np.concatenate([c.hash for c in scan(pa.array([bytes(body)], pa.binary()), rule)] or [np.zeros(0, np.uint64)])) for name, body in part.collect()]
        packed.append(cloudpickle.dumps(Automaton([x for x in coded if len(x[1])], width).packed()))  # with its class
        size += len(packed[-1])
        if size >= pass_bytes or block == n_blocks - 1:
            shared = spark.sparkContext.broadcast(cloudpickle.dumps([cloudpickle.loads(x) for x in packed]))
            out = out.withColumn("_bytes", as_bytes(text)).mapInArrow(_matcher(shared, cut), schema)
            packed, size = [], 0
    return out


def contaminated(share: float = 0.05):
    """The verdict on a row of decontaminate(): some word is hit, and hit words are at least this share of all words."""
    per = round(1 / share)
    return (F.col("n_hit") > 0) & (F.lit(per) * F.col("n_hit") >= F.col("n_words"))
