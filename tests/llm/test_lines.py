"""Outliers by duplicated lines."""

import numpy as np

from tallyspark.llm.outliers import estimates, judged, statistics
from tallyspark.llm.store import written


def test_texts_that_are_bad_only_by_their_lines_are_rejected(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(300):
        lines = [" ".join("".join(chr(97 + x) for x in r.integers(0, 26, int(r.integers(2, 9)))) for _ in range(3)) for _ in range(60)]
        if i % 30 == 0:  # short lines in shuffled order, so hardly a run of eight words comes again
            lines = [x for _ in range(3) for x in r.permutation(lines[:20]).tolist()]
        rows.append((i, "\n".join(lines), "en", "src"))
    counts = written(statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    out = {x["doc_id"]: x for x in judged(counts, estimates(counts)).collect()}
    assert not any(x["base_failed"] for x in out.values())
    assert all(out[i]["kept"] == (i % 30 != 0) for i in range(300))
