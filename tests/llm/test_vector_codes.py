"""Vector codes: the screen against exact distances, the whole query against plain integers, awkward rows."""

import hashlib
import random

import numpy as np
import pytest

from tallyspark.llm.vector_codes import _assign, compress, vector_codes


def plain(rows, parts=8, entries=16, rounds=6):
    """{row index: (code, error)}, the codebooks: Python integers only."""
    kept = [(k, i, [int(np.floor(4096.0 * float(x))) for x in v]) for k, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    w = len(kept[0][2]) // parts
    seeds = sorted(((i is None, i or 0, v) for _, i, v in kept))[:entries]
    books = [[v[j * w : (j + 1) * w] for _, _, v in seeds] for j in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda j, p: min(range(len(books[j])), key=lambda e: (dist(p, books[j][e]), e))
    for _ in range(rounds):
        for j in range(parts):
            of = {}
            for _, _, v in kept:
                p = v[j * w : (j + 1) * w]
                of.setdefault(near(j, p), []).append(p)
            for e, ps in of.items():
                books[j][e] = [sum(c) // len(ps) for c in zip(*ps, strict=True)]
    out = {}
    for k, _, v in kept:
        ps = [v[j * w : (j + 1) * w] for j in range(parts)]
        es = [near(j, p) for j, p in enumerate(ps)]
        out[k] = ("".join(f"{e:02x}" for e in es), sum(dist(p, books[j][e]) for j, (p, e) in enumerate(zip(ps, es, strict=True))))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("top, m", [(3, 8), (5000, 8), (1 << 26, 16), (1 << 26, 3), (1 << 20, 128)])
def test_assignment_is_exact(top, m):
    rng = np.random.default_rng(m)
    book = rng.integers(-top, top + 1, (16, m))
    book[5] = book[2]  # ties
    x = np.concatenate([rng.integers(-top, top + 1, (500, m)), book + rng.integers(-1, 2, (16, m)), (book[:8] + book[8:]) // 2])
    x = np.clip(x, -top, top)
    exact = [min(range(16), key=lambda e: (sum((int(a) - int(b)) ** 2 for a, b in zip(p, book[e], strict=True)), e)) for p in x]
    assert _assign(x, book).tolist() == exact


def test_whole_query_with_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 0.01 * (1 + i % 3) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(3, rows[3][1], 2), (None, rows[5][1], None), (700, None, 1), (701, [0.1] * 15 + [None], 1), (702, [float("nan")] * 16, 2), (703, [float("-inf")] + [0.0] * 15, 2), (704, [0.25] * 16, 9), (-1, [0.0] * 16, None)]
    want, sha = plain(rows)
    df = spark.createDataFrame([(i, v, label, 0, "x") for i, v, label in rows], "vec_id long, embedding array<double>, label int, code int, v string")
    got = vector_codes(df).collect()
    sums = {}
    for k, (_, error) in want.items():
        sums[rows[k][2]] = sums.get(rows[k][2], 0) + error
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=str) == sorted([(rows[k][0], c, e, sums[rows[k][2]]) for k, (c, e) in want.items()], key=str)
    assert {r.codebooks_sha256 for r in got} == {sha}


def test_few_rows_other_lengths_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>, label string"
    assert vector_codes(spark.createDataFrame([], kind)).count() == 0
    got = vector_codes(spark.createDataFrame([(2, [0.5] * 8, None), (1, [0.25] * 8, "a"), (3, [1.0] * 16, "a"), (4, [], "a"), (1, [0.5] * 8, "a")], kind)).collect()
    assert {(r.vec_id, r.code, r.error) for r in got} == {(1, "00" * 8, 0), (1, "01" * 8, 0), (2, "01" * 8, 0)}  # of equal entries the first
    assert all(r.error == 0 for r in vector_codes(spark.createDataFrame([(1, [0.5] * 9, None)], kind)).collect())
    assert [(r.code, r.error) for r in vector_codes(spark.createDataFrame([(1, [], None)], kind)).collect()] == [("00" * 8, 0)]
    with pytest.raises(Exception, match="too large"):
        compress(spark.createDataFrame([(1, [1e9] * 8, None)], kind))
