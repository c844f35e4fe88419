"""Numbers in texts, statements against evidence, drafts that are verified."""

import pytest

from tallyspark.functions.numbers import extract_numbers, half_up, with_digits
from tallyspark.operators.verifier import check, finalized, numbers_match, problems, statable


def said(text):
    return [x["text"] for x in extract_numbers(text)]


@pytest.mark.parametrize(
    "text, value, decimals, percent",
    [("1,408", "1408", 0, False), ("27.3", "27.3", 1, False), (".476", "0.476", 3, False), ("47.6%", "47.6", 1, True), ("-3", "-3", 0, False), ("+12", "12", 0, False), ("27.3 million", "27300000", 0, False), ("1.2k", "1200", 0, False), ("33.5ppg", "33.5", 1, False), ("99th", "99", 0, False), ("-0.0", "0", 1, False), ("0.50", "0.5", 2, False)],
)
def test_one_number(text, value, decimals, percent):
    (x,) = extract_numbers(text)
    assert (x["value"], x["decimals"], x["percent"], x["token"], x["exotic"]) == (value, decimals, percent, False, False)


def test_tokens_names_and_scripts():
    assert said("SGA hit 3PT shots in 2025-26, 31.1 a game, on 2026-04-12") == ["2025-26", "31.1", "2026-04-12"]
    assert said("His 3-point percentage is 47.8% with 16 40-point games.") == ["47.8%", "16"]
    assert said("99½") == ["991", "2"] and said("２７.３") == ["27.3"] and said("") == [] and extract_numbers(None) == []
    assert [(x["text"], x["exotic"]) for x in extract_numbers("٣ and 4")] == [("٣", False), ("٣", True), ("4", False)]  # read as 3, and told to be exotic
    assert [x["text"] for x in extract_numbers("team23 a-3 1,2345 1.2.3")] == ["3", "1", "2345", "1.2"]
    assert with_digits("Thirty-one of them, one of the best, twenty two and seven") == "31 of them, one of the best, 22 and 7"
    assert str(half_up(1.005, 2)) == "1.01" and str(half_up(0.285, 2)) == "0.29"


NAMES = [("points per game", "ppg"), ("PPG", "ppg"), ("points", "ppg"), ("points", "pts"), ("assists", "ast"), ("assists per game", "apg"), ("3P%", "fg3"), ("from the field", "fg"), ("games", "gp"), ("TO", "tov")]
VALUES = [("a", 32.65, "number", 1, "ppg"), ("a", 0.476, "percent", 1, "fg"), ("a", 1408.0, "number", 0, "pts"), ("a", 68.0, "number", 0, "gp"), ("a", float("nan"), "number", 0, "gp"), ("a", None, "number", 0, "gp"), ("a", 12.0, "number", 0, None)]


@pytest.fixture(scope="module")
def frames(spark):
    values = spark.createDataFrame([("x" + str(k), *v[1:]) for k in range(40) for v in VALUES], "key string, value double, display string, decimals int, column string")
    names = spark.createDataFrame(NAMES, "phrase string, column string")
    literals = spark.createDataFrame([("x" + str(k), t) for k in range(40) for t in ("2025-26", "top 5", None)], "key string, text string")
    return values, literals, names


CASES = [
    ("He had 32.7 points per game in 2025-26.", [], []),
    ("He had 32.6 points per game.", ["32.6"], []),
    ("He shot 47.6% from the field, .476 in all.", [], []),
    ("He shot 48% from the field.", ["48%"], []),
    ("1,408 points in 68 games", [], []),
    ("32.7 assists for him", [], ["32.7 assists"]),
    ("Assists: 32.7; points: 1,408", [], ["Assists: 32.7"]),
    ("32.70 points", ["32.70"], []),
    ("in 2024-25 he was top 5", ["2024-25"], []),
    ("a dozen games and hundreds of points, five times", ["dozen", "hundreds"], []),
    ("Sixty-eight games, one of the best", [], []),
    ("12 assists", [], []),  # a value without a name fits any
    ("68 to lead, 68 TO", [], ["68 TO"]),
    ("٣ points", ["٣", "٣"], []),
    ("", [], []),
    (None, [], []),
    ("-5 and 5.0 and +5", [], []),
    ("27.3 million", ["27.3 million"], []),
]


def test_drafts(spark, frames):
    values, literals, names = frames
    drafts = spark.createDataFrame([(f"x{k}", t) for k, (t, _, _) in enumerate(CASES)], "key string, draft string")
    got = {r.key: r for r in check(drafts, values, literals, names).collect()}
    assert {k: (r.unmatched, r.mislabelled) for k, r in got.items()} == {f"x{k}": (no, wrong) for k, (_, no, wrong) in enumerate(CASES)}
    assert all(r.ok == (not r.unmatched and not r.mislabelled) for r in got.values())
    assert got["x0"].numbers == 2 and got["x14"].numbers == 0 and len(got) == len(CASES)
    rows = problems(check(drafts, values, literals, names)).collect()
    assert ("x5", "mislabelled", "32.7 assists") in set(map(tuple, rows)) and len(rows) == sum(len(a) + len(b) for _, a, b in CASES)
    empty = check(drafts, values.limit(0), literals.limit(0), names.limit(0)).where("key = 'x4'").first()
    assert empty.unmatched == ["1,408", "68"]


def test_finalized(spark, frames):
    values, literals, names = frames
    first = spark.createDataFrame([("x1", "68 games"), ("x2", "69 games"), ("x3", "70 games")], "key string, draft string")
    retry = spark.createDataFrame([("x1", "99 games"), ("x2", "68 games"), ("x3", "71 games")], "key string, draft string")
    fallback = spark.createDataFrame([(f"x{k}", "table") for k in range(4)], "key string, text string")
    got = sorted(map(tuple, finalized(first, retry, fallback, values, literals, names).collect()))
    assert got == [("x1", "68 games", "verified"), ("x2", "68 games", "regenerated"), ("x3", "table", "fallback")]


def test_every_rounding_is_an_exact_key(spark):
    values = [(0.285, 2), (1.005, 2), (2.5, 0), (-2.5, 0), (1e15 + 0.5, 1), (0.1 + 0.2, 4), (100.0, 0), (0.0, 3), (1e-7, 4)]
    df = spark.createDataFrame([(k, v, "number", d) for k, (v, d) in enumerate(values)], "key int, value double, display string, decimals int")
    got = {r.key: r.number for r in statable(df, "key").collect()}
    from tallyspark.functions.numbers import canonical

    assert got == {k: canonical(half_up(v, d)) for k, (v, d) in enumerate(values)}
    stated = spark.createDataFrame([(2, "3", 0, 1), (2, "2", 0, 2), (0, "0.29", 2, 3), (0, "0.29", 3, 4)], "key int, value string, decimals int, n int")
    assert {r.n: r.matched for r in numbers_match(stated, df, "key", ["n"]).collect()} == {1: True, 2: False, 3: True, 4: False}
