"""The decoder against all readings of short lattices, the regression against its own optimum, and innocent texts."""

import itertools

import numpy as np
import pyarrow as pa

from tallyspark.llm import toxicity as X


def readings(stretch):
    """All readings of a stretch of letters, signs and gaps, with the channel's part of the score."""
    options = []
    for b, run in ((k, len(list(g))) for k, g in itertools.groupby(stretch)):
        if b in X._LETTER:
            x = X._LETTER[b]
            own = [((x,) * run, 0.0)] if run < 3 else [((x,), X.NO_REPEAT), ((x, x), X.NO_REPEAT)]
            options.append(own + ([((x,), 4 * X.NO_REPEAT)] if run == 2 else []))
        elif b in X._SIGNS:
            own = [((0,), X.KEPT_SIGN)]
            for x in X._SIGNS[b]:
                own.append(((x,), X.AS_SIGN + (X.NO_REPEAT if run > 1 else 0)))
                own += [((x, x), 2 * X.AS_SIGN)] if run > 1 else []
            options.append(own)
        else:
            options.append([((0,), 0.0), ((), X.NO_GAP)])
    for choice in itertools.product(*options):
        yield tuple(x for letters, _ in choice for x in letters), sum(cost for _, cost in choice)


def test_viterbi_finds_the_best_of_all_readings():
    r = np.random.default_rng(1)
    log = np.log(r.dirichlet(np.ones(X._SYMBOLS) * 0.1, (X._SYMBOLS, X._SYMBOLS)) + 1e-9).astype(np.float32)
    decoder = X.Decoder(log)
    for _ in range(200):
        stretch = bytes(r.choice(list(b"aabcst13$0. "), int(r.integers(2, 8))).tolist())

        def value(letters):
            total, p, q = 0.0, 0, 0
            for x in letters:
                if not (x == 0 and q == 0):
                    total += log[p, q, x]
                p, q = q, x
            return total + (log[p, q, 0] if q else 0.0)

        best = max(value(letters) + cost for letters, cost in readings(stretch))
        got = decoder.restore(stretch)
        own = max((value(letters) + cost for letters, cost in readings(stretch) if bytes(X._BYTE[x] for x in letters) == got), default=-np.inf)
        assert abs(own - best) < 1e-3, (stretch, got)


def test_the_regression_is_at_its_optimum():
    r = np.random.default_rng(2)
    x = (r.random((300, 12)) < 0.2).astype(float)
    y = (r.random(300) < 1 / (1 + np.exp(-(x @ r.normal(0, 2, 12) - 1)))).astype(float)
    rows, columns = np.nonzero(x)
    w, b = X.fitted(rows, columns, y, 12, ridge=0.5)
    off = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ off + 0.5 * w).max() < 1e-3 and abs(off.sum()) < 1e-3


def test_features_are_words_and_beginnings():
    texts = ["stupidly stupidly x", "stupid", "", "é stupidly"]
    ((n, doc, h),) = X.features(pa.array([t.encode() for t in texts], pa.binary()))
    own = [set(h[doc == k].tolist()) for k in range(n)]
    assert len(own[0]) == 2 * 4 + 1 and len(own[1]) == 2 and not own[2]  # the word, three beginnings, both twice, and x; the word and one beginning
    assert len(own[0] & own[1]) == 1 and len(own[3]) == 5


def test_innocent_beginnings_mark_nothing(spark):
    r = np.random.default_rng(3)
    plain = ["morning", "train", "market", "people", "travel", "close", "path", "distant", "clear", "the", "to"]
    rows = [(i, " ".join(r.choice(plain, 30)) + (" moron trash clown" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(600)]
    probes = ["the morning train to the market", "more people travel close to the path", "a clear distant morning"]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000 + k, p) for k, p in enumerate(probes)], "doc_id long, text string")
    out = {x["doc_id"]: x["score"] for x in X.toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()}
    assert all(out[9000 + k] < 0.7 for k in range(3)) and all((out[i] >= 0.7) == (y == 1) for i, _, y in rows)
    none = X.toxicity(docs.where("false"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.count() == 0
