"""Reconciliation, checks in one pass and on writing, cards, intervals, strata: small frames and plain recounts."""

import hashlib
import math
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import checks as C
from tallyspark.operators.cards import column_cards, least_distinct, tool_cards
from tallyspark.operators.reconcile import gap_notes, multiset_difference, reconcile
from tallyspark.operators.resampling import POISSON, difference_interval, family_interval, held_out_strata, replicates


def test_multisets(spark):
    a = [(1, "x"), (1, "x"), (2, None), (3, "y")]
    b = [(1, "x"), (2, None), (2, None), (3, "y"), (4, "z")]
    got = multiset_difference(*(spark.createDataFrame(r, "k int, v string") for r in (a, b)), ["k", "v"]).collect()
    want = Counter(a)
    want.subtract(b)
    assert {(r.k, r.v): r.n for r in got} == {k: n for k, n in want.items() if n}


def test_both_directions(spark):
    kind = "player int, season string, season_type string"
    logs = spark.createDataFrame([(1, "a", "R"), (1, "a", "R"), (1, "b", "R"), (2, "a", "R"), (3, "a", None), (5, "a", "R")], kind)
    totals = spark.createDataFrame([(1, "a", "R"), (4, "a", "R"), (5, "a", "R"), (3, "c", "P")], kind)
    known = spark.createDataFrame([(2, None, None), (5, "a", "R"), (3, "c", "P"), (1, "b", "P")], kind)
    got = {(r.player, r.season, r.season_type, r.kind) for r in reconcile(logs, totals, ["player", "season", "season_type"], "player", known).collect()}
    assert got == {(1, "b", "R", "unexplained"), (2, "a", "R", "listed_gap"), (3, "a", None, "unexplained"), (4, "a", "R", "no_log"), (5, "a", "R", "listed_with_rows"), (3, "c", "P", "no_log"), (3, "c", "P", "listed_with_rows")}
    gaps = spark.createDataFrame([(1, "part", "2001-02", "Playoffs"), (1, "part", "2000-01", "Regular Season"), (2, "part", "", "x"), (3, "whole", "2000-01", "x"), (4, "part", "1999-00", None)], "player int, class string, season string, season_type string")
    notes = {r.player: r.note for r in gap_notes(gaps, "player", ["part"]).collect()}
    assert set(notes) == {1, 4} and "for: 2000-01 regular season, 2001-02 playoffs. The" in notes[1]


def test_checked_while_written(spark, tmp_path):
    rows = spark.range(100).withColumn("v", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id")))
    checks = {"small": F.col("id") < 100, "here": F.col("v").isNotNull()}
    assert {r.check: r.violations for r in C.in_one_pass(rows, checks).collect()} == {"small": 0, "here": 10}
    assert {r.violations for r in C.in_one_pass(rows.limit(0), checks).collect()} == {0}
    with pytest.raises(ValueError, match="here: 10"):
        C.write_checked(rows, str(tmp_path / "bad"), checks)
    assert list(Path(tmp_path).iterdir()) == []
    assert C.write_checked(rows, str(tmp_path / "good"), {"small": F.col("id") < 100}) == {"_rows": 100, "small": 0}
    assert spark.read.parquet(str(tmp_path / "good")).count() == 100 and [p.name for p in tmp_path.iterdir()] == ["good"]
    with pytest.raises(FileExistsError):
        C.write_checked(rows, str(tmp_path / "good"), checks)


MANIFEST = {"as_of": "2026-04-12", "latest": "2026-04-11", "season": "2025-26", "season_type": "R", "first_conference": "East", "registry": "1", "registry_here": "1"}


def _snapshot(spark, **off):
    games = [(1, "2026-04-11"), (2, "2026-04-01")] + off.get("games", [])
    box = off.get("box", [(1, 10), (1, 10), (1, 11), (2, 10)])
    teams = off.get("teams", [("2025-26", "R", "East" if k < 15 else "West", 40 + k % 2, 41 - k % 2 if k != 29 else 39, 81) for k in range(30)])
    players = off.get("players", [("2025-26", "R", 27.5)])
    shots = off.get("shots", [("2026-04-11",)])
    date = lambda df: df.withColumn("date", F.col("date").cast("date"))
    return (
        date(spark.createDataFrame(games, "game int, date string")), spark.createDataFrame(box, "game int, team int"), spark.createDataFrame(teams, "season string, season_type string, conference string, wins int, losses int, gp int"),
        spark.createDataFrame(players, "season string, season_type string, points_per_game double"), date(spark.createDataFrame(shots, "date string")),
    )


@pytest.mark.parametrize(
    "off, manifest, failing",
    [
        ({}, {}, {"F05"}),
        ({"teams": [("2025-26", "R", "East" if k < 15 else "West", 41, 41, 82) for k in range(30)]}, {}, set()),
        ({"games": [(3, "2026-04-20")]}, {}, {"F02", "F05", "F07"}),
        ({"box": [(1, 10)]}, {"as_of": "2026-05-01"}, {"F01", "F03", "F05"}),
        ({"teams": [("2025-26", "R", "East", 1, 1, 60 + k) for k in range(9)], "players": [("2025-26", "R", None)], "shots": [("2026-04-10",)]}, {"registry_here": "2"}, {"F04", "F06", "F08", "F09", "F10"}),
    ],
)
def test_freshness(spark, off, manifest, failing):
    got = C.freshness(*_snapshot(spark, **off), MANIFEST | manifest).collect()
    assert [r.id for r in got] == [f"F{k:02d}" for k in range(1, 11)] and {r.id for r in got if not r.ok} == failing
    assert {r.id for r in C.freshness(*_snapshot(spark, **off), MANIFEST | manifest, in_season=False).collect()} == {"F02", "F03", "F07", "F10"}


def test_cards(spark):
    rows = spark.createDataFrame([(3, 2.5, "b" * 60, True, [1]), (1, float("nan"), "a", None, None), (2, -1.0, None, False, [2]), (1, 7.0, "c", True, []), (None, 9.0, "d", True, None)], "n int, x double, s string, b boolean, l array<int>")
    one = least_distinct(rows.repartition(3)).first()
    assert (list(one.n), list(one.x), list(one.s), list(one.b)) == ([1, 2, 3], [-1.0, 2.5, 7.0], ["a", "b" * 60, "c"], [False, True])
    cards = {r.column: r for r in column_cards(rows, "v", {"n": "A number."}).collect()}
    assert cards["n"].card == "Column n (int) of view v. A number. Examples: 1, 2, 3" and cards["s"].examples == f"a, {'b' * 40}, c" and cards["l"].examples == ""
    assert cards[None].card == "View v (5 columns): n, x, s, b, l"
    assert {r.examples for r in column_cards(rows.limit(0), "v").collect()} == {""}
    ((name, card),) = tool_cards({"t": {"description": "D.", "properties": {"a": {"type": "string", "description": "x"}, "b": {"enum": [1, 2]}, "c": {"items": {"enum": list(range(9))}}}, "required": ["b"]}}, {"t": ["q1", "q2"]})
    assert name == "tool:t" and card == "Tool t: D.\nArguments:\n- a: string - x\n- b (required): one of 1, 2\n- c: one of 9 values\nExample questions: q1 | q2"


def _plain(rows, n, seed):
    groups = {}
    for f, ok in rows:
        groups.setdefault(f, []).append(bool(ok))
    out = {}
    for r in range(n):
        w = {f: sum(int(hashlib.md5(f"{f}:{r}:{seed}".encode()).hexdigest()[:8], 16) >= t for t in POISSON) for f in groups}
        if any(w.values()):
            out[r] = sum(w[f] * sum(g) for f, g in groups.items()) / sum(w[f] * len(g) for f, g in groups.items())
    return out


def test_intervals(spark):
    assert abs(sum(1 - t / 2**32 for t in POISSON) - 1) < 1e-6 and POISSON[0] == round(2**32 / math.e)
    rows = [(f"f{k % 7}", k % 3 == 0) for k in range(60)] + [("g", None)]
    other = [(f"f{k % 5}", k % 2 == 0) for k in range(40)]
    a, b = (spark.createDataFrame(r, "f string, ok boolean") for r in (rows, other))
    shares = _plain(rows, 100, 5)
    assert {r.replicate: pytest.approx(r.share) for r in replicates(a, "f", "ok", 100, 5).collect()} == shares
    v = sorted(shares.values())
    assert tuple(family_interval(a, "f", "ok", 100, 5, 0.9).first()) == (pytest.approx(v[int((1 - 0.9) / 2 * len(v))]), pytest.approx(v[int((1 + 0.9) / 2 * len(v)) - 1]))
    x, y = _plain(rows, 80, 1), _plain(other, 80, 2)
    d = sorted(x[r] - y[r] for r in x.keys() & y.keys())
    assert tuple(difference_interval(a, b, "f", "ok", 80, 1).first()) == (pytest.approx(d[int((1 - 0.95) / 2 * len(d))]), pytest.approx(d[int((1 + 0.95) / 2 * len(d)) - 1]))
    assert family_interval(a.limit(0), "f", "ok", 10).first().low is None


def test_strata(spark):
    rows = [(f"f{k}", "abc"[k % 3], 1 + k * k % 7) for k in range(50)] + [("big", "d", 90), ("s1", "d", 3), ("s2", "d", 2)]
    got = {r.f: r.held_out for r in held_out_strata(spark.createDataFrame(rows, "f string, s string, w int"), "f", "s", "w", "salt").collect()}
    for s in "abcd":
        own = sorted((x for x in rows if x[1] == s), key=lambda x: hashlib.sha256(f"salt:{x[0]}".encode()).hexdigest())
        target, held = 0.3 * sum(x[2] for x in own), 0
        for f, _, w in own:
            closer = abs(held + w - target) < abs(held - target)
            held += w * closer
            assert got[f] == closer
