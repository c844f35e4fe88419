"""Equal results whatever their columns are called, against all permutations; cells as they are shown."""

import datetime
import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import results
from tallyspark.operators.results import Rounding, same_rows, shown, text_table


def _plain(want, got):
    """Whether some choice of got's columns gives want's rows."""
    return any(Counter(tuple(r[j] for j in p) for r in got) == Counter(want) for p in permutations(range(len(got[0])), len(want[0])))


@pytest.mark.parametrize("seed", range(8))
def test_mappings_are_found(spark, seed):
    rng = random.Random(seed)
    want = [tuple(rng.choice([1, 2, None]) for _ in range(3)) for _ in range(5)]
    order = rng.sample(range(3), 3)
    got = [tuple([r[k] for k in order] + [rng.choice([1, 2, None])]) for r in rng.sample(want, 5)]
    if seed % 2:  # the columns alone still agree
        k = rng.randrange(3)
        column = rng.sample([r[k] for r in got], 5)
        got = [(*r[:k], column[i], *r[k + 1 :]) for i, r in enumerate(got)]
    a, b = spark.createDataFrame(want, "a int, b int, c int"), spark.createDataFrame(got, "w int, x int, y int, z int").repartition(3)
    found = same_rows(a, b)
    assert (found.mapping is not None) == _plain(want, got), (want, got, found)
    if found.mapping:
        assert Counter(map(tuple, b.select(*(found.mapping[c] for c in "abc")).collect())) == Counter(want)


def test_rounding_order_and_reasons(spark):
    a = spark.createDataFrame([(1, 0.4761, "x"), (2, 0.5, "y")], "n int, share double, s string")
    b = spark.createDataFrame([("y", 2.0, 0.50001), ("x", 1.0, 0.47612)], "name string, k double, v double")
    assert same_rows(a, b).mapping is None
    assert same_rows(a, b, {"n": None, "share": Rounding(1, percent=True), "s": None}).mapping == {"n": "k", "share": "v", "s": "name"}
    assert same_rows(a, b, {"s": None}).mapping == {"s": "name"}
    assert same_rows(a, b.limit(1)).reason == "1 rows, not 2" and same_rows(a.limit(0), b.limit(0)).mapping == {}
    one, two = (df.withColumn("at", F.lit(0) + F.when(F.col(c) == "x", k).otherwise(1 - k)) for df, c, k in ((a, "s", 0), (b, "name", 1)))
    assert "in this order" in same_rows(one, two, {"s": None}, ("at", "at")).reason
    assert same_rows(one, two.withColumn("at", 1 - F.col("at")), {"s": None}, ("at", "at")).mapping == {"s": "name"}


def test_too_many_mappings(spark, monkeypatch):
    monkeypatch.setattr(results, "MOST_MAPPINGS", 3)
    monkeypatch.setattr(results, "AT_ONCE", 2)
    cross = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (1, 0, 0)], "a int, b int, c int")
    other = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (0, 0, 0)], "a int, b int, c int")
    assert same_rows(cross, other).mapping is None


def test_cells_as_shown(spark):
    row = (7, 1234567.5, 0.4765, 27.25, 12345, -9999, 3.0, 2.25, True, None, datetime.date(2026, 4, 12), "é")
    df = spark.createDataFrame([row, (None,) * 12], "player_id int, pts double, fg double, ppg double, n long, m int, x double, y double, b boolean, z string, d date, s string")
    metrics = {"pts": Rounding(0, label="Points"), "fg": Rounding(1, percent=True), "ppg": Rounding(1)}
    one, none = (tuple(r) for r in shown(df, metrics).collect())
    assert one == ("1,234,568", "47.7%", "27.3", "12,345", "-9999", "3", "2.3", "yes", "n/a", "2026-04-12", "é") and set(none) == {"n/a"}
    table = text_table(df.select("pts", "ppg", "b"), metrics).split("\n")
    assert table[0] == "Points    | ppg  | b  " and table[1] == "----------+------+----" and table[2].startswith("1,234,568 | 27.3 | yes")
    assert text_table(df.limit(0), metrics) == "No rows."
