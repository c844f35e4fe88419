"""SimHash: fingerprints and components against brute force, postings that are dealt in blocks, awkward rows."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import simhash
from tallyspark.llm.simhash import fingerprint, forest, links, position_sets, simhash_components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, most=4):
    of = {v: v for v in values}

    def find(v):
        while of[v] != v:
            v = of[v]
        return v

    for a, b in combinations(set(values), 2):
        if (a ^ b).bit_count() <= most:
            x, y = sorted((find(a), find(b)))
            of[y] = x
    return {v: find(v) for v in of}


def test_any_four_positions_hold_a_set():
    for together in (3, 4):
        assert all(any(set(s) <= set(four) for s in position_sets(together)) for four in combinations(range(8), 4))


@pytest.mark.parametrize("text", ["", None, "one", "One  two\tthree", "a b c d", "É Ä ß\x0bx\x1cy z " * 9, " lead and trail ", "\x85x y\xa0z w v", "same " * 50])
def test_fingerprint_is_the_contract(text):
    assert fingerprint((text or "").encode()) == plain(text)


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abC", k=rng.randint(1, 40))) for _ in range(500)) + "\n\n"
    whole = plain(text)
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert fingerprint(text.encode()) == whole


def test_forest_connects_what_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    values = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 3)).astype(np.uint64), axis=1) for b in base]))
    edges = [(int(a), int(b)) for x, y in forest(values, 4) for a, b in zip(x, y, strict=True)]
    assert len(edges) == len(values) - len(set(roots(values.tolist()).values()))


@pytest.mark.parametrize("together, block", [(3, 4096), (3, 16), (4, 8)])
def test_links_are_whole_in_blocks_too(spark, together, block):
    rng = random.Random(together + block)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):  # chains of near fingerprints
        v = rng.choice(values)
        for _ in range(rng.randint(1, 6)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    found = links(spark.createDataFrame([(v,) for v in signed], "print bigint"), len(signed), together=together, block=block).collect()
    of = roots([v & (1 << 64) - 1 for v in signed])
    merged = {v: v for v in of}

    def find(v):
        while merged[v] != v:
            v = merged[v]
        return v

    for a, b in found:
        a, b = a & (1 << 64) - 1, b & (1 << 64) - 1
        assert of[a] == of[b]
        merged[find(a)] = find(b)
    assert len({find(v) for v in of}) == len(set(of.values()))


def test_components_with_awkward_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from all the noise of the town " * 4
    rows = [(1, base), (2, base + "indeed"), (3, None), (4, ""), (5, "\n \t"), (6, base.upper()), (7, "one two"), (8, "ONE\ttwo"), (None, base), (None, "alone here"), (9, "x" * 3_000_000), (7, "one two")]
    docs = spark.createDataFrame([(i, t, "p", 0) for i, t in rows], "doc_id bigint, text string, print string, component_id int")
    got = sorted(map(tuple, simhash_components(docs).collect()), key=str)
    prints = [plain(t) for _, t in rows]
    of = roots(prints)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[of[p]] = min(least.get(of[p], i), i)
    want = sorted([(i, f"{p:016x}", least.get(of[p])) for (i, _), p in zip(rows, prints, strict=True)], key=str)
    assert got == want
    assert simhash_components(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from tallyspark.llm.queries import op11_simhash

    rows = op11_simhash(spark, "/root/testdata/sf0.01").collect()
    texts = dict(map(tuple, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()))
    prints = {i: plain(t) for i, t in texts.items()}
    of = roots(list(prints.values()))
    least = {}
    for i, p in prints.items():
        least[of[p]] = min(least.get(of[p], i), i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{p:016x}", least[of[p]]) for i, p in prints.items()}
    assert len(rows) == len(texts)
