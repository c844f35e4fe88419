"""Operators on documents against brute force, with awkward rows in every table."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm.decontaminate import Automaton, contaminated, decontaminate
from tallyspark.llm.jaccard import Scheme, components, similar_components
from tallyspark.llm.outliers import chi_squared, estimates, judged, statistics
from tallyspark.llm.store import written
from tallyspark.llm.substrings import lengths, remove_repeats
from tallyspark.llm.words import alnum, scan, spaced

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string"


def texts(n=60, seed=5):
    """Random texts with copies, near copies and shared passages, and the awkward ones."""
    r = np.random.default_rng(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(40)]
    passage = [str(x) for x in r.choice(vocabulary, 50)]
    out = [None, "", "   \n\t ", "one", "two words", "a b\x85c \x0b d\x0c\r\ne", " ".join(["again"] * 200), "line\nline\nline \n\nline"]
    for k in range(n):
        words = [str(x) for x in r.choice(vocabulary, int(r.integers(1, 150)))]
        if k % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        out.append(" ".join(words))
        if k % 4 == 0:
            out.append(out[-1])
        if k % 3 == 0:
            near = list(words)
            near[len(near) // 2] = "changed"
            out.append("\n".join([" ".join(near[:20]), " ".join(near[20:])]))
    out.append(" ".join(str(x) for x in r.choice(vocabulary, 30_000)))  # one very long text
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "fr"][i % 3], "src0" if i % 2 else None) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def test_words_are_those_of_the_rules():
    every = [t or "" for t in texts()] + ["x#y$z", "[]`{|}~\x7f", "Ünï-cöde 9A"]
    for rule, pattern, low in ((spaced(), SPACED, False), (alnum(), ALNUM, True)):
        got = []
        for c in scan(pa.array([t.encode() for t in every], pa.binary()), rule, 300):
            for d in range(c.n_docs):
                got.append([c.data[a:b].tobytes().decode().translate(LOW) if low else c.data[a:b].tobytes().decode() for a, b in zip(c.start[c.bounds[d] : c.bounds[d + 1]], c.end[c.bounds[d] : c.bounds[d + 1]], strict=True)])
        assert got == [pattern.findall(t.translate(LOW) if low else t) for t in every]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    seen = {}
    for t in (texts()[::-1], texts()):
        for c in scan(pa.array([(x or "").encode() for x in t], pa.binary()), spaced(), 5000):
            for a, b, h in zip(c.start, c.end, c.hash, strict=True):
                assert seen.setdefault(c.data[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_statistics_against_brute_force(docs):
    def brute(text):
        text = text or ""
        words = SPACED.findall(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        return (len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(repeated))

    got = {r[0]: tuple(r)[1:] for r in statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in docs.collect()}


def test_outliers_are_rejected_and_clean_texts_kept(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(400):
        words = ["".join(chr(97 + x) for x in r.integers(0, 26, int(r.integers(2, 9)))) for _ in range(int(r.integers(40, 200)))]
        if i % 20 == 0:
            words = [w + "###" for w in words]
        if i % 33 == 0:
            words = words[:10]
        rows.append((i, " ".join(words), None if i % 2 else "en", "src"))
    docs = spark.createDataFrame(rows, DOCS)
    counts = written(statistics(docs))
    out = {x["doc_id"]: x for x in judged(counts, estimates(counts)).collect()}
    assert all(out[i]["kept"] == (i % 20 != 0 and i % 33 != 0) for i in range(400))
    assert all(out[i]["base_failed"] == (i % 33 == 0) for i in range(400))


def test_outliers_without_enough_rows_have_no_estimate(spark):
    few = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(30)), "en", None), (2, None, None, None)], DOCS)
    counts = written(statistics(few))
    assert {r["doc_id"]: r["kept"] for r in judged(counts, estimates(counts)).collect()} == {1: True, 2: False}
    none = statistics(few.where("false"))
    assert judged(none, estimates(none)).count() == 0


def test_chi_squared_quantiles():
    assert chi_squared(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert chi_squared(0.999, 6) == pytest.approx(22.45774, abs=1e-4)


def brute_repeats(rows, width):
    starts = Counter()
    split = {k: SPACED.findall(t or "") for k, t in rows}
    for w in split.values():
        starts.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = {}
    for k, w in split.items():
        gone = {j for i in range(len(w) - width + 1) if starts[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out[k] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("width", [35, 8, 9, 3])
def test_repeats_against_brute_force(docs, width):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["clean_text"]) for r in remove_repeats(docs.select("doc_id", "text"), width=width, block_bytes=3000).collect()}
    assert got == brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], width)


def test_repeats_of_awkward_tables(spark):
    assert lengths(35) == [8, 16, 32, 35] and lengths(3) == [3]
    empty = spark.createDataFrame([], "doc_id long, text string, n_words string")
    assert remove_repeats(empty).columns == ["doc_id", "n_words", "n_removed", "clean_text"] and remove_repeats(empty).count() == 0
    body = " ".join(f"w{i}" for i in range(40))
    same = spark.createDataFrame([(None, body, "x"), (None, body, "y"), (3, None, "z")], "doc_id long, text string, n_removed string")
    assert sorted(r["n_removed"] for r in remove_repeats(same).collect()) == [0, 40, 40]


def brute_components(rows, width, p, q):
    def grams(t):
        w = [x.translate(LOW) for x in SPACED.findall(t or "")]
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [(k, grams(t)) for k, t in rows]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and q * len(x & y) >= p * len(x | y):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {k: (len(s), find(k)) for k, s in sets}


@pytest.mark.parametrize(("width", "p", "q"), [(3, 90, 100), (5, 80, 100)])
def test_components_against_brute_force(spark, width, p, q):
    r = np.random.default_rng(9)
    base = [f"v{x}" for x in r.integers(0, 500, 120)]
    rows = list(enumerate(texts(30)))
    for k in range(80):  # a graded group of near copies
        words = list(base)
        for _ in range(int(r.integers(0, 7))):
            words[int(r.integers(len(words)))] = f"x{r.integers(10_000)}"
        if k % 4 == 0:
            del words[int(r.integers(100)) :][: int(r.integers(8))]
        rows.append((1000 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in similar_components(docs, width=width, p=p, q=q).collect()}
    assert got == brute_components(rows, width, p, q)


def test_components_of_awkward_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similar_components(empty).count() == 0
    rows = spark.createDataFrame([(5, "a b c d"), (2, "A B C D"), (None, "a b c d"), (9, None), (9, "")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in similar_components(rows).collect())
    assert got == [(-1, 2, 2), (2, 2, 2), (5, 2, 2), (9, 0, 9), (9, 0, 9)]


def test_fragments_leave_an_equal_segment():
    """Sets at the threshold always share a key."""
    r = np.random.default_rng(3)
    scheme = Scheme(90, 100)
    for _ in range(300):
        n = int(r.integers(20, 400))
        x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(r.integers(0, len(x) // 10 + 1))
        y = np.delete(x, r.choice(len(x), drop, replace=False))
        if 100 * len(y) < 90 * len(x):
            continue
        both = [set(scheme.keys(1, np.zeros(len(s), np.int64), s)[1].tolist()) for s in (x, y)]
        assert len(x) == len(y) or both[0] & both[1]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 103: 100}


def brute_hits(text, items, width=13):
    words = ALNUM.findall((text or "").translate(LOW))
    hit, own = set(), set()
    for k, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        n = min(width, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                own.add(str(k))
    return len(words), len(hit), ",".join(sorted(own))


def test_decontamination_against_brute_force(spark, docs):
    body = texts()
    items = [(1, " ".join((body[9] or "").split()[:30])), (2, "two words"), (10, None), (11, ""), (12, body[20]), (13, " ".join((body[20] or "").split()[3:18])), (7, "again again again again"), (8, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, items) for i, t in enumerate(body)}
    for block, most in ((16_000_000, 16_000_000), (150, 16_000_000), (150, 1)):  # one automaton, several, and several passes
        rows = decontaminate(docs, bench, cut=True, block_bytes=block, pass_bytes=most).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], ",".join(r["item_ids"])) for r in rows} == want
        for r in rows:
            if r["n_hit"]:
                assert len(ALNUM.findall(r["clean_text"])) == r["n_words"] - r["n_hit"]
                assert sum(s["n"] for s in r["spans"]) == r["n_hit"]
    assert decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate(docs.where("false"), bench).count() == 0
    flags = {r["doc_id"]: r["c"] for r in decontaminate(docs, bench).select("doc_id", contaminated().alias("c")).collect()}
    assert flags == {i: w[1] > 0 and 20 * w[1] >= w[0] for i, w in want.items()}


def test_automaton_holds_every_run():
    r = np.random.default_rng(2)
    items = [(str(i), r.integers(0, 4, int(r.integers(1, 30))).astype(np.uint64)) for i in range(6)]
    own = Automaton(items, 5)
    for _ in range(50):
        text = r.integers(0, 4, 40)
        want = set()
        for name, w in items:
            n = min(5, len(w))
            grams = {tuple(w[i : i + n].tolist()) for i in range(len(w) - n + 1)}
            want |= {(i, i + n, name) for i in range(len(text) - n + 1) if tuple(text[i : i + n].tolist()) in grams}
        codes = np.searchsorted(own.vocabulary, text).tolist()
        assert {(a, b, own.names[k]) for a, b, ks in own.packed().matches(codes) for k in ks} == want


def test_digest_of_kept_words(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r[0]: r[1] for r in remove_repeats(docs).select("doc_id", F.sha2(F.col("clean_text").cast("binary"), 256)).collect()}
    assert got == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
