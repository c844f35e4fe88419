"""Raking in one row and as a table is the same, and both report targets that cannot be met."""

import numpy as np
import pytest

from tallyspark.llm.mixing import rake


@pytest.mark.parametrize("gathered", [0, 1000])
def test_both_ways_meet_the_targets(spark, gathered):
    r = np.random.default_rng(3)
    tokens = r.integers(0, 9, (3, 4)).astype(float)
    cells = spark.createDataFrame([(f"a{i}", f"b{j}", float(tokens[i, j])) for i, j in np.ndindex(3, 4)], "a string, b string, tokens double")
    targets = {"a": [0.5, 0.3, 0.2], "b": [0.1, 0.2, 0.3, 0.4]}
    frames = {m: spark.createDataFrame([(f"{m}{k}", x) for k, x in enumerate(t)], f"{m} string, target double") for m, t in targets.items()}
    got = rake(cells, frames, gathered=gathered, tolerance=1e-7, rounds=40).toPandas()
    assert len(got) == np.count_nonzero(tokens) and abs(got.weight.sum() - 1) < 1e-6
    for m, t in targets.items():
        assert np.allclose(got.groupby(m).weight.sum().to_numpy(), t, atol=1e-6)
    assert rake(cells.where("false"), frames, gathered=gathered).count() == 0


def test_targets_that_cannot_be_met_are_reported(spark):
    cells = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0)], "x string, y string, tokens double")
    frames = {m: spark.createDataFrame([(v[0], 0.9), (v[1], 0.1)] if m == "x" else [(v[0], 0.1), (v[1], 0.9)], f"{m} string, target double") for m, v in {"x": "ac", "y": "bd"}.items()}
    with pytest.warns(UserWarning, match="still off"):
        rake(cells, frames, rounds=5)
