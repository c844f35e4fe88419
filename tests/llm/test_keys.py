"""Words and sets by their hashes: what must meet meets, what differs differs."""

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm.jaccard import Scheme
from tallyspark.llm.words import scan, spaced


@pytest.mark.parametrize("p, q, sizes", [(80, 100, (1, 120)), (90, 100, (1, 300)), (80, 100, (200, 900)), (50, 100, (1, 40))])
def test_similar_sets_share_a_key(p, q, sizes):
    rng = np.random.default_rng(p + sizes[1])
    scheme = Scheme(p, q)
    for _ in range(400):
        n = int(rng.integers(*sizes))
        x = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
        most = int(n * (q - p) / p) + 1
        y = np.concatenate([x[: n - int(rng.integers(0, most + 1))], rng.integers(0, 2**63, int(rng.integers(0, most + 1)), dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if not len(y) or q * both < p * (len(x) + len(y) - both) or np.array_equal(x, y):
            continue
        doc = np.repeat([0, 1], [len(x), len(y)])
        d, k = scheme.keys(2, doc, np.concatenate([x, y]))
        shared = np.intersect1d(k[d == 0], k[d == 1])
        tops = scheme.edges[np.searchsorted(scheme.edges, max(len(x), len(y)), "right")] - 1
        assert np.count_nonzero(shared & np.uint64(1) == np.uint64((np.searchsorted(scheme.edges, max(len(x), len(y)), "right") - 1) & 1)) >= scheme.least(tops), (len(x), len(y), both)


def test_long_words_that_differ_hash_apart():
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    (chunk,) = scan(pa.array([f"{word} {other} {word.upper()}"]), spaced(lower=True))
    assert chunk.hash[0] != chunk.hash[1] and chunk.hash[0] == chunk.hash[2]
