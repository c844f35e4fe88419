"""The covariance estimate against brute force, and that language and source decide."""

import numpy as np

from tallyspark.llm.outliers import _RIDGE, VECTOR, _chi_squared_below, chi_squared, estimates, judged, judged_texts, statistics
from tallyspark.llm.store import written

DOCS = "doc_id long, text string, lang string, source string, spread string"
Z = list(VECTOR)


def habits(r, n, upper, length):
    words = ["".join(chr(97 + x) for x in r.integers(0, 26, max(1, int(r.normal(length, 1))))) for _ in range(n)]
    return " ".join(w.upper() if r.random() < upper else w for w in words) + "."


def brute(x, part=0.75):
    """Concentration to the least determinant from many random starts, with exact halves."""
    d = x.shape[1]
    best = (np.inf, None, None)
    r = np.random.default_rng(0)
    for _ in range(60):
        own = x[r.choice(len(x), 12, replace=False)]
        mean, cov, last = own.mean(0), np.cov(own.T) + np.eye(d) * 1e-4, np.inf
        for _ in range(60):
            off = x - mean
            far = np.einsum("ij,ij->i", off, np.linalg.solve(cov, off.T).T)
            near = x[np.argsort(far, kind="stable")[: int(part * len(x)) + 1]]
            mean = near.mean(0)
            cov = np.cov(near.T, bias=True) * part / _chi_squared_below(chi_squared(part, d), d + 2) + np.eye(d) * _RIDGE
            det = np.linalg.slogdet(cov)[1]
            if det >= last - 1e-9:
                break
            last = det
        if det < best[0]:
            best = (det, mean, cov)
    return best


def test_estimates_against_brute_force_and_by_source(spark):
    r = np.random.default_rng(4)
    rows = [(i, habits(r, 120, 0.02, 5) if i % 15 else habits(r, 120, 0.02, 5) + " ###" * 30, "en", "quiet", "clash") for i in range(240)]
    rows += [(1000 + i, habits(r, 120, 0.5, 5), "en", "loud", None) for i in range(240)]
    same = habits(r, 120, 0.5, 5)
    rows += [(5000, same, "en", "quiet", ""), (5001, same, "en", "loud", ""), (5002, None, None, None, None), (5003, "", "en", "quiet", None)]
    counts = written(statistics(spark.createDataFrame(rows, DOCS)))
    found = {e["_s"]: e for e in estimates(counts).collect()}
    vectors = counts.where("n_words >= 20").select("source", *Z).toPandas()
    for source in ("quiet", "loud"):
        det, mean, cov = brute(vectors[vectors.source == source][Z].to_numpy())
        got = np.array(found[source]["spread"]).reshape(len(Z), -1)
        assert np.linalg.slogdet(got)[1] <= det + 0.15
        scale = np.sqrt(np.diag(cov)) + 0.005
        assert (np.abs(np.array(found[source]["centre"]) - mean) <= 0.5 * scale).all()
    docs = spark.createDataFrame(rows, DOCS)
    out = {x["doc_id"]: x for x in judged(counts, estimates(counts)).collect()}
    assert {x["doc_id"]: (x["text"], x["kept"]) for x in judged_texts(docs, estimates(counts)).collect()} == {r[0]: (r[1], out[r[0]]["kept"]) for r in rows}
    assert not out[5000]["kept"] and out[5001]["kept"]  # one text, two sources
    assert all(out[i]["kept"] == (i % 15 != 0) for i in range(240)) and all(out[1000 + i]["kept"] for i in range(240))
    assert out[5002]["base_failed"] and out[5003]["base_failed"] and "spread" not in out[0].asDict()
