"""Toxicity behind obfuscation: a noisy channel.

A character language model (trigrams over letters, backed off to bigrams and letters) is counted over the whole corpus. Each
suspicious stretch of a text (leetspeak, letters set apart by spaces or points, letters repeated) is a lattice of readings,
and Viterbi search picks the reading with the highest probability of the letters times that of the obfuscation. The restored
text is then scored by a regularised logistic regression over its words and the beginnings of its longer words, each as there
once and as there twice, fitted to labelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import as_bytes, without, written
from .words import BYTE, Rule, buffers, mix, powers, scan, spaced

# Letters that a digit or sign stands for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
#: Log probabilities of the channel: a sign for a letter, a kept sign, a dropped gap, a dropped repetition.
AS_SIGN, KEPT_SIGN, NO_GAP, NO_REPEAT = -1.5, -3.0, -0.5, -0.5

_SYMBOLS = 1 + 26 + 128
_CODE = np.zeros(256, np.int64)  # 0 parts words
_CODE[65:91] = _CODE[97:123] = np.arange(1, 27)
_CODE[128:] = np.arange(27, 27 + 128)
_LETTER = {**{b: b - 96 for b in range(97, 123)}, **{b: b - 128 + 27 for b in range(128, 256)}}
_BYTE = {v: k for k, v in _LETTER.items()} | {0: 32}
_SIGNS = {ord(k): [ord(x) - 96 for x in v] for k, v in LEET.items()}


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """key (three letters' codes) and n over all texts of docs; each batch sends its own counts, which are then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for batch in batches:
            offsets, data = buffers(batch.column(0))
            for a in range(int(offsets[0]), int(offsets[-1]), 1 << 21):
                code = _CODE[data[a : min(a + (1 << 21) + 2, int(offsets[-1]))]]
                cut = offsets[(offsets > a) & (offsets < a + len(code))] - a
                code = np.insert(code, cut, 0)  # a text's end parts words
                if len(code) > 2:
                    total += np.bincount((code[:-2] * _SYMBOLS + code[1:-1]) * _SYMBOLS + code[2:], minlength=len(total))
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(total[keys], pa.int64())], names=["key", "n"])

    return docs.select(as_bytes(text).alias("_bytes")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Letters:
    """The language model: log P(letter | two letters before), as an array over the codes."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        c3 = np.zeros(_SYMBOLS**3, np.float64)
        c3[keys] = n
        c3 = c3.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
        c3[0, 0, 0] = 0  # runs of what is not a letter say nothing
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 0.5) / (c1 + 0.5).sum()
        p2 = self._backed(c2, p1[None, :])
        self.log = np.log(self._backed(c3, p2[None, :, :])).astype(np.float32)

    @staticmethod
    def _backed(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Witten-Bell: as many pseudo-counts of the shorter context's law as there are different letters after the longer."""
        kinds = (counts > 0).sum(-1, keepdims=True) + 1.0
        return (counts + kinds * lower) / (counts.sum(-1, keepdims=True) + kinds)


class Decoder:
    def __init__(self, log: np.ndarray, memo: int = 200_000):
        self.log, self.memo, self.known = log, memo, {}

    def restore(self, stretch: bytes) -> bytes:
        """The likeliest reading of a stretch of lower-case text."""
        found = self.known.get(stretch)
        if found is None:
            if len(self.known) >= self.memo:
                self.known.clear()
            found = self.known[stretch] = self._viterbi(stretch)
        return found

    def _viterbi(self, stretch: bytes) -> bytes:
        log = self.log
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        at, end = 0, len(stretch)
        while at < end:
            b = stretch[at]
            run = at + 1
            while run < end and stretch[run] == b:
                run += 1
            r = run - at
            at = run
            if b in _LETTER:
                x = _LETTER[b]
                options = [((x,) * r, 0.0)] if r < 3 else [((x,), NO_REPEAT), ((x, x), NO_REPEAT)]
                if r == 2:
                    options.append(((x,), 4 * NO_REPEAT))
            elif b in _SIGNS:
                options = [((0,), KEPT_SIGN)]
                for x in _SIGNS[b]:
                    options.append(((x,), AS_SIGN + (NO_REPEAT if r > 1 else 0)))
                    if r > 1:
                        options.append(((x, x), 2 * AS_SIGN))
            else:
                options = [((0,), 0.0), ((), NO_GAP)]
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (p, q), (score, path) in states.items():
                for letters, cost in options:
                    s, a, c = score + cost, p, q
                    for x in letters:
                        if not (x == 0 and c == 0):
                            s += log[a, c, x]
                        a, c = c, x
                    old = after.get((a, c))
                    if old is None or s > old[0]:
                        after[a, c] = (s, (path, letters))
            states = after
        best, path = max(((s + log[p, q, 0] if q else s), path) for (p, q), (s, path) in states.items())
        out: list[int] = []
        while path:
            path, letters = path
            out.extend(reversed(letters))
        return bytes(_BYTE[x] for x in reversed(out))


_EDGE = re.compile(rb"^(?:([^0-9a-z\x80-\xff@$|+(])\1+|([@$|+(])\2\2+)|(?:([^0-9a-z\x80-\xff@$|+(])\3+|([@$|+(])\4\4+)[.,;:]?$|[.,;:!?]+$")
_SPACED = re.compile(rb"(?:(?<=\s)|^)(?:[a-z0-9@$!|+](?:[ .\-_*]{1,2})){2,}[a-z0-9@$!|+](?=[\s.,;:!?]|$)")
_REPEAT = re.compile(rb"([a-z])\1")
_HAS_SIGN = re.compile(rb"[0-9@$!|+(]")
_HAS_LETTER = re.compile(rb"[a-z\x80-\xff]")
_INNER = re.compile(rb"[a-z][.\-_*][a-z][.\-_*][a-z]")

_is_sign = np.zeros(256, bool)
_is_sign[[*_SIGNS, *b".-_*"]] = True
_is_point = np.zeros(256, bool)  # punctuation, if it ends a word
_is_point[[*b".-_*!"]] = True


def restored(chunk, k: int, low: bytes, odd: list[tuple[int, int]], decoder: Decoder) -> bytes:
    """Text k of a chunk, lower-cased, with its suspicious stretches restored. odd: the words worth a look."""
    out, at = [], 0
    for a, b in odd:
        word = low[a:b]
        core = _EDGE.sub(b"", word)
        if not core or not _HAS_LETTER.search(core) or not (_HAS_SIGN.search(core) or _REPEAT.search(core) or _INNER.search(core)):
            continue
        out += [low[at:a], decoder.restore(core)]
        at = b
    low = b"".join([*out, low[at:]]) if out else low
    return _SPACED.sub(lambda m: decoder.restore(m[0]), low)


def _restored_texts(column: pa.Array, decoder: Decoder) -> Iterator[bytes]:
    rule = spaced()
    for c in scan(column, rule):
        data = c.data
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        sign = _is_sign[low]
        if len(low) > 1:
            sign[1:] |= (low[1:] == low[:-1]) & (low[1:] >= 97) & (low[1:] <= 122)
        total = np.zeros(len(low) + 1, np.int64)
        np.cumsum(sign, out=total[1:])
        # a single point at a word's end is punctuation; a digit or another sign there may be a letter
        last = _is_point[low[np.maximum(c.end - 1, 0)]].astype(np.int64) if len(c.end) else np.zeros(0, np.int64)
        odd = np.flatnonzero(total[c.end] - total[c.start] - last > 0)
        of = c.doc[odd]
        edges = np.searchsorted(of, np.arange(c.n_docs + 1))
        for k in range(c.n_docs):
            base = int(c.offsets[k])
            body = low[base : c.offsets[k + 1]].tobytes()
            words = odd[edges[k] : edges[k + 1]]
            yield restored(c, k, body, list(zip((c.start[words] - base).tolist(), (c.end[words] - base).tolist(), strict=True)), decoder)


#: Lengths in bytes of the beginnings that are features of longer words.
PREFIXES = range(5, 11)
_LETTERS = Rule(np.array([not (97 <= b <= 122 or b >= 128) for b in range(256)]), np.arange(256, dtype=np.uint8))
_BEGINNING, _TWICE = 0x5851F42D4C957F2D, np.uint64(0x14057B7EF767814F)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk of lower-case texts the number of texts, and for their distinct features text and hash."""
    for c in scan(column, _LETTERS):
        up, down = powers(len(c.data) + 1)
        total = np.zeros(len(c.data) + 1, np.uint64)
        np.cumsum(BYTE[c.data] * up[:-1], out=total[1:])
        docs, hashes = [c.doc], [c.hash]
        for k in PREFIXES:
            at = np.flatnonzero(c.end - c.start > k)
            start = c.start[at]
            docs.append(c.doc[at])
            hashes.append(mix((total[start + k] - total[start]) * down[start] + np.uint64(_BEGINNING * k % (1 << 64))))
        doc, h = np.concatenate(docs), np.concatenate(hashes)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        first = np.ones(len(h), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(first)
        twice = at[np.diff(np.append(at, len(h))) > 1]
        yield c.n_docs, np.concatenate([doc[at], doc[twice]]), np.concatenate([h[at], mix(h[twice] + _TWICE)])


@dataclass(frozen=True)
class Model:
    """A logistic regression: features (hashes, sorted), a weight for each, and the log odds of a text without any."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each lower-case text, and how many of the features it has."""
        sums, found = [np.zeros(0)], [np.zeros(0, np.int64)]
        for n_docs, doc, h in features(column):
            at, known = _among(self.hashes, h)
            sums.append(np.bincount(doc[known], weights=self.weights[at[known]], minlength=n_docs))
            found.append(np.bincount(doc[known], minlength=n_docs))
        return 1 / (1 + np.exp(-np.clip(self.bias + np.concatenate(sums), -60, 60))), np.concatenate(found)


def _among(values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x is in the sorted values, and which are there."""
    if not len(values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return at, values[at] == x


def fitted(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, n_features: int, ridge: float = 0.2, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression of y on 0/1 features (one entry a row and column), with a penalty of
    ridge / 2 on the squared weights, by Newton's steps until the gradient vanishes; if it does not after so many
    rounds, that is an error. A step is solved by conjugate gradients, so nothing larger than the entries is held."""
    penalty = np.append(np.full(n_features, ridge), 0.0)  # the intercept comes last
    times = lambda w: np.bincount(rows, weights=w[columns], minlength=len(y)) + w[-1]
    back = lambda r: np.append(np.bincount(columns, weights=r[rows], minlength=n_features), r.sum())
    loss = lambda w, at: float(np.logaddexp(0, at).sum() - y @ at + penalty @ (w * w) / 2)
    w = np.zeros(n_features + 1)
    for _ in range(rounds):
        at = times(w)
        p = 1 / (1 + np.exp(-np.clip(at, -60, 60)))
        g = back(p - y) + penalty * w
        if np.abs(g).max() < 1e-4:
            return w[:-1], float(w[-1])
        curve = p * (1 - p) + 1e-12
        scale = back(curve) + penalty  # of 0/1 features the diagonal
        step, left = np.zeros_like(w), -g
        ahead = left / scale
        size, goal = left @ ahead, min(0.1, float(np.linalg.norm(g)) ** 0.5) * float(np.linalg.norm(g))
        for _ in range(500):
            if np.linalg.norm(left) <= goal * 0.1:
                break
            bent = back(curve * times(ahead)) + penalty * ahead
            far = size / (ahead @ bent)
            step, left = step + far * ahead, left - far * bent
            other = left / scale
            size, last = left @ other, size
            ahead = other + size / last * ahead
        now, slope, far = loss(w, at), g @ step, 1.0
        while far > 1e-9 and loss(w + far * step, times(w + far * step)) > now + 1e-4 * far * slope + 1e-12 * abs(now):
            far /= 2
        w = w + far * step
    raise RuntimeError(f"the regression has not converged after {rounds} rounds")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def learn(docs: DataFrame, labels: DataFrame, letters, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 12_000, min_share: float = 0.01) -> Model:
    """The model of labelled texts.

    At most about max_rows labelled rows that are not held out are learned from, half of each label where there are enough,
    drawn by a hash of the id; of near copies one. Features are those that min_share of the toxic texts have, and a toxic text
    more than three times as often as another; each is in that share of at most max_rows texts, which bounds their number. The
    intercept is moved to the share of toxic texts among all labelled ones. Without a toxic text every score is that share
    (of one text more in two).
    """
    known = labels.where(~held_out(doc_id) & F.col(label).isNotNull()).select(doc_id, F.col(label).cast("int").alias("_y")).distinct()
    sizes = dict(known.groupBy("_y").count().collect())
    prior = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior)) if sizes.get(1) else -6.0))
    if not sizes.get(1) or not sizes.get(0):
        return none
    draw = F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) / F.lit(1 << 20)
    share = F.when(F.col("_y") == 1, min(1.0, max_rows / 2 / sizes[1])).otherwise(min(1.0, max_rows / 2 / sizes[0]))
    chosen = F.broadcast(known.where(draw < share))  # at most about max_rows pairs of numbers
    rows = docs.select(doc_id, as_bytes(text).alias("_bytes")).join(chosen, doc_id).select("_bytes", "_y")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, rule = Decoder(letters.value), spaced()
        for batch in batches:
            low = pa.array(list(_restored_texts(batch.column(0), decoder)), pa.binary())
            least = []
            for c in scan(low, rule):
                at, hashes = c.windows(3)
                edges = np.searchsorted(at, c.bounds)
                least += [int(hashes[a:b].min()) >> 1 if b > a else -1 - int(c.hash[c.bounds[k]] >> np.uint64(1)) if c.n_words[k] else -1 for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([low, batch.column(1), pa.array(least, pa.int64())], names=["_low", "_y", "_sig"])

    # of texts that share the least of their three-word shingles' hashes, near copies mostly, one is learned from
    rows = rows.mapInArrow(signed, "_low binary, _y int, _sig long").groupBy("_y", "_sig").agg(F.min("_low").alias("_low"))
    rows = written(rows.select("_low", "_y", F.monotonically_increasing_id().alias("_row")), "learned")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, base = batch.column(1).to_numpy(), 0
            for n_docs, doc, h in features(batch.column(0)):
                keys, at = np.unique(h, return_inverse=True)
                pos = np.bincount(at.ravel(), weights=y[base : base + n_docs][doc], minlength=len(keys)).astype(np.int64)
                base += n_docs
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64), pa.int64()), pa.array(pos, pa.int64()), pa.array(np.bincount(at.ravel(), minlength=len(keys)) - pos, pa.int64())], names=["term", "pos", "neg"])

    counts = rows.mapInArrow(counted, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = dict(rows.groupBy("_y").count().collect())
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    least = max(3, int(min_share * n_pos))
    strong = counts.where((F.col("pos") >= least) & (F.col("pos") / max(n_pos, 1) > 3 * F.col("neg") / max(n_neg, 1)))
    hashes = np.sort(np.array([r[0] for r in strong.select("term").collect()], np.int64).view(np.uint64))
    if not len(hashes) or not n_neg:
        return none

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, base = batch.column(1).to_numpy(), 0
            lows = []
            for low in batch.column(0).to_pylist():
                words = low.split()
                lows += [low, b" ".join(words[::2]), b" ".join(words[1::2])]
            for n_docs, doc, h in features(pa.array(lows, pa.binary())):
                at, there = _among(hashes, h)
                own = base + doc[there]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own // 3] * 3 + own % 3, pa.int64()), pa.array(at[there], pa.int32())], names=["_row", "feature"])
                base += n_docs

    # each text is learned from whole and by every other word, so that what marks it together with more also does alone; a
    # toxic text's part that has none of the features says nothing
    entries = rows.select("_low", "_row").mapInArrow(marked, "_row long, feature int").toPandas()
    texts = rows.select("_row", "_y").toPandas().sort_values("_row")
    ids = (texts["_row"].to_numpy()[:, None] * 3 + np.arange(3)).ravel()
    y = np.repeat(texts["_y"].to_numpy(np.float64), 3)
    use = (ids % 3 == 0) | (y == 0) | np.isin(ids, entries["_row"].to_numpy())
    ids, y = ids[use], y[use]
    weights, bias = fitted(np.searchsorted(ids, entries["_row"].to_numpy()), entries["feature"].to_numpy(np.int64), y, len(hashes))
    # the sample holds other parts of the toxic and the other texts
    bias += np.log(prior / (1 - prior)) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(hashes, weights, float(bias))


def score(docs: DataFrame, model: Model, letters, text: str = "text", keep_restored: bool = False) -> DataFrame:
    """docs (without the text) with score (0 to 1), n_terms (different features found) and, if asked for, restored: the text as
    it was scored, lower-cased, where it was obfuscated (else null).

    Null and empty texts get the score of a text without any feature; repeated rows are scored each; columns whose names clash
    are replaced.
    """
    added = ("score", "n_terms", "restored")
    base = without(docs, *(x for x in added if x != text), "_bytes")
    rest = [f for f in base.schema.fields if f.name.lower() != text.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(letters.value)
        for batch in batches:
            column = batch.column("_bytes")
            lows = list(_restored_texts(column, decoder))
            scores, found = model.scores(pa.array(lows, pa.binary()))
            texts = [low.decode("utf-8", "replace") if keep_restored and low != (column[k].as_py() or b"").lower() else None for k, low in enumerate(lows)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), pa.array(scores, pa.float64()), pa.array(found, pa.int64()), pa.array(texts, pa.string())], names=[*(f.name for f in rest), *added]
            )

    schema = T.StructType([*rest, T.StructField("score", T.DoubleType()), T.StructField("n_terms", T.LongType()), T.StructField("restored", T.StringType())])
    return base.select(*(f.name for f in rest), as_bytes(text).alias("_bytes")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 12_000, **more) -> DataFrame:
    """score() with a language model of all of docs and a regression learned from labels; adds held_out."""
    spark = docs.sparkSession
    counts = trigram_counts(docs, text).toPandas()  # bounded by the number of letters, cubed
    letters = spark.sparkContext.broadcast(Letters(counts["key"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)).log)
    model = learn(docs, labels, letters, doc_id, text, label, max_rows)
    return score(docs, model, letters, text, **more).withColumn("held_out", held_out(doc_id))
