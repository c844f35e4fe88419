"""The dataflow and the typed questions on a made-up league, against plain Python."""

import pytest
from league import BOX, PEOPLE, SWAP, frames
from pyspark.sql import functions as F

from tallyspark.operators import quality as Q
from tallyspark.operators.marts import build, semantic
from tallyspark.operators.metrics import Metric, Registry
from tallyspark.operators.registry import METRICS, rule_for
from tallyspark.operators.tools import AnswerCache, ArgumentError, Store, canonical, checked, not_tracked, run_tool


@pytest.fixture(scope="module")
def league(spark, tmp_path_factory):
    landing, seeds, facts = frames(spark)
    root = str(tmp_path_factory.mktemp("marts"))

    def keep(name, df):
        df.coalesce(1).write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    f = build(landing, seeds, keep=keep)
    views = {n: keep(n, df) for n, df in semantic(f).items()}
    store = Store(views, f["_first"], "2024-06-01")
    return f, views, store, facts


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_games_are_paired(league):
    f, _, _, facts = league
    got = {r["game_id"]: r for r in rows(f["games"])}
    assert set(got) == set(facts["games"])  # the unplayed game is gone
    for g, (home, away, hp, ap) in facts["games"].items():
        r = got[g]
        if not r["is_neutral"]:
            assert (r["home_team_id"], r["away_team_id"], r["home_pts"], r["away_pts"]) == (home, away, hp, ap)
        assert r["winner_team_id"] == (home if hp > ap else away) and r["margin"] == abs(hp - ap)
    assert sum(r["is_neutral"] for r in got.values()) == 2
    assert {r["periods"] for r in got.values() if r["overtime"]} == {5} and [g for g, r in got.items() if r["is_cup_final"]] == [facts["cup"]]


def test_newest_fetch_and_right_team_win(league):
    f, _, _, facts = league
    stale = rows(f["stg_team_game"].where(F.col("game_id") == facts["stale"]))
    assert all(r["pts"] > 1 for r in stale)
    game, player, team = facts["twice"]
    assert [r["team_id"] for r in rows(f["stg_player_game"].where((F.col("game_id") == game) & (F.col("player_id") == player)))] == [team]


def test_season_totals_and_stints(league):
    f, _, _, facts = league
    got = {(r["player_id"], r["season_start"], r["season_type"]): r for r in rows(f["player_season"])}
    want: dict = {}
    for (p, y, kind, _), xs in facts["player"].items():
        want.setdefault((p, y, kind), []).extend(xs)
    assert set(got) == set(want)
    for k, xs in want.items():
        assert (got[k]["gp"], got[k]["pts"]) == (len(xs), sum(x["PTS"] for x in xs))
        assert got[k]["stl"] == (sum(x["STL"] for x in xs) if k[1] >= 2023 else None)  # not tracked before
    swapped = got[SWAP, 2023, "Regular Season"]
    assert swapped["team_count"] == 2 and swapped["last_team_id"] == 3
    assert f["player_season_stint"].where(F.col("player_id") == SWAP).where("season_start = 2023 and season_type = 'Regular Season'").count() == 2


def test_team_seasons(league):
    f, _, _, facts = league
    got = {(r["team_id"], r["season"], r["season_type"]): r for r in rows(f["team_season"])}
    for (t, season, kind), r in got.items():
        code = {"Regular Season": "002", "Playoffs": "004", "Cup Final": "006"}[kind]
        mine = [(h, a, hp, ap) for g, (h, a, hp, ap) in facts["games"].items() if g[:5] == code + season[2:4] and t in (h, a)]
        assert r["gp"] == len(mine) and r["wins"] == sum(hp != ap and (hp > ap) == (t == h) for h, a, hp, ap in mine)
        assert r["losses"] == sum(hp != ap and (hp > ap) != (t == h) for h, a, hp, ap in mine)
        assert r["home_wins"] + r["road_wins"] + r["neutral_games"] >= r["wins"] and r["pts"] == sum(hp if t == h else ap for h, a, hp, ap in mine)
    assert got[4, "2023-24", "Regular Season"]["conference_rank"] == 4  # from the yearly table, as the standings have none


def test_titles_awards_eras_and_names(league):
    f, *_ = league
    assert {(r["season"], r["team_id"], r["opponent_team_id"]) for r in rows(f["team_titles"])} == {("2022-23", 1, 2), ("2023-24", 3, 2)}
    assert {r["player_id"] for r in rows(f["player_titles"].where("season = '2023-24'"))} == {31, 32, 33, SWAP}
    assert f["awards"].count() == 4
    eras = {(r["team_id"], r["name"]): (r["first_season_start"], r["last_season_start"], r["is_current"]) for r in rows(f["teams"])}
    assert eras[4, "Old Owls"] == (2022, 2022, False) and eras[4, "Owls"] == (2023, 2023, True) and eras[1, "Gulls"] == (2022, 2023, True)
    alias = {(r["alias_norm"], r["kind"]): r["player_id"] for r in rows(f["player_aliases"])}
    assert alias["ana novak", "full name"] == 11 and alias["the net", "nickname"] == 11 and ("moss", "last name") not in alias
    assert {k for _, k in alias} <= {"full name", "accent-free", "no periods", "last name", *(r["kind"] for r in rows(f["player_alias_seed"]))}
    team_alias = {(r["team_id"], r["alias_norm"]): r["kind"] for r in rows(f["team_aliases"])}
    assert (4, "old owls") not in team_alias and team_alias[4, "owls"] == "name"  # today's names only
    assert {r["season_type"] for r in rows(f["records"].where("record_kind = 'single_game'"))} == {"Regular Season"}
    assert {r["player_id"] for r in rows(f["players"])} == set(PEOPLE)
    assert {r["franchise_id"]: r["defunct"] for r in rows(f["franchises"])} == {1: False, 2: False, 3: False, 4: False, 50: True}
    assert rows(f["records"].where("record = 'career_triple_doubles'"))[0]["player_id"] == 11
    best = max(r["pts"] for r in rows(f["player_game"]) if r["season_type"] == "Regular Season")
    assert f["records"].where("stat = 'pts'").agg(F.max("value")).first()[0] == best


def facts_of(league):
    return league[3]["player"]


def test_every_metric_is_computed_as_stated(league):
    """Each metric of the player grains against a plain recomputation from the marts."""
    f, views, _, _ = league
    season = {(r["player_id"], r["season"], r["season_type"]): r for r in rows(views["sem_player_season_stats"])}
    totals = {(r["player_id"], r["season"], r["season_type"]): r for r in rows(f["player_season"])}
    logs: dict = {}
    for r in rows(f["player_game"]):
        logs.setdefault((r["player_id"], r["season"], r["season_type"]), []).append(r)
    for k, r in season.items():
        t = totals[k]
        assert r["points"] == t["pts"] and r["points_per_game"] == pytest.approx(t["pts"] / t["gp"]) and r["steals"] == t["stl"]
        assert r["true_shooting_pct"] == pytest.approx(t["pts"] / (2 * (t["fga"] + 0.44 * t["fta"]))) and r["effective_fg_pct"] == pytest.approx((t["fgm"] + 0.5 * t["fg3m"]) / t["fga"])
        tens = [sum((g[c] or 0) >= 10 for c in ("pts", "reb", "ast", "stl", "blk")) for g in logs[k]]
        assert (r["double_doubles"], r["triple_doubles"]) == (sum(x >= 2 for x in tens), sum(x >= 3 for x in tens))
        assert r["forty_point_games"] == sum(g["pts"] >= 40 for g in logs[k])
    shot = season[11, "2022-23", "Regular Season"]
    mine = [s for s in rows(f["shots"]) if s["player_id"] == 11]
    corner = [s for s in mine if s["zone"] == "Left Corner 3"]
    assert shot["shot_attempts"] == len(mine) and shot["corner_threes_made"] == (sum(s["made"] for s in corner) if corner else None)
    assert season[31, "2022-23", "Regular Season"]["corner_threes_made"] is None  # no attempts: unknown, not none made
    career = {(r["player_id"], r["season_type"]): r for r in rows(views["sem_player_career_stats"])}
    assert career[11, "Regular Season"]["mvp_awards"] == 2 and career[11, "Playoffs"]["mvp_awards"] is None
    assert career[31, "Regular Season"]["player_championships"] == 1 and career[21, "Regular Season"]["all_star_selections"] == 1
    teams = {(r["franchise_id"], r["season_type"]): r for r in rows(views["sem_team_all_time_stats"])}
    assert teams[1, "Regular Season"]["championships"] == teams[1, "Playoffs"]["championships"] == 1
    assert len(views) == 20 and [r["metric_count"] for r in rows(views["sem_registry_info"])] == [len(METRICS.metrics)] == [54]


def test_checks_pass_and_each_plant_trips_its_own(league):
    f, *_ = league
    team, player = f["stg_team_game"], f["stg_player_game"]
    keys = ["game_id", "team_id"]
    played = team.where("minutes > 0")
    check = lambda p: Q.sums_differ(p, played, keys, F.col("pts"), F.col("pts"))
    assert check(player).isEmpty()
    plant = player.withColumn("pts", F.when((F.col("game_id") == league[3]["cup"]) & (F.col("player_id") == 11), F.col("pts") + 7).otherwise(F.col("pts")))
    assert check(plant).count() == 1
    totals = f["player_season"].groupBy("player_id", "season_type").agg(*(F.sum(c).cast("int").alias(c) for c in ("gp", "pts", "ast")))
    career = f["stg_player_career_totals"]
    assert Q.differs(totals, career, ["player_id", "season_type"], ["gp", "pts", "ast"]).isEmpty()
    assert Q.differs(totals.withColumn("pts", F.col("pts") + 1), career, ["player_id", "season_type"], ["pts"]).count() == career.count()
    assert Q.untracked_values(f["player_season"], "season_start", f["_first"]).isEmpty()
    assert rows(Q.untracked_values(f["player_season"], "season_start", {"pts": 2030}))[0]["stat"] == "pts"
    for name, key in (("games", ["game_id"]), ("player_game", ["game_id", "player_id"]), ("player_season", ["player_id", "season", "season_type"]), ("team_season", ["team_id", "season", "season_type"])):
        assert Q.not_unique(f[name], key).isEmpty()
    with pytest.raises(ValueError, match="unique games"):
        Q.require_empty("unique games", Q.not_unique(f["games"], ["season"]))


def test_cutoffs(spark, league):
    landing, seeds, _ = frames(spark)
    from tallyspark.operators.marts import games, int_season_type_status

    with pytest.raises(ValueError, match="Regular Season 2023-24"):
        build(landing, seeds, as_of="2023-12-01")
    f = dict(league[0])
    f["int_season_type_status"] = int_season_type_status(f, "2023-06-01")
    assert {r["season"] for r in rows(games(f).select("season").distinct())} == {"2022-23"}


def test_questions(league):
    f, views, store, _ = league
    season = rows(views["sem_player_season_stats"].where("season = '2023-24' and season_type = 'Regular Season'"))
    got = rows(run_tool("get_leaders", {"metric": "points", "season": "2023-24", "limit": 4}, store).rows)
    assert [(r["rank"], r["player_id"]) for r in got] == [(i, r["player_id"]) for i, r in enumerate(sorted(season, key=lambda r: (-r["points"], r["player_id"]))[:4], 1)]
    got = rows(run_tool("get_leaders", {"metric": "points_per_game", "season": "2023-24", "limit": 25}, store).rows)
    need = {r["player_id"]: -(-7 * r["team_gp"] // 10) for r in season}
    best = max(r["points_per_game"] for r in season if r["gp"] >= need[r["player_id"]])
    want = [r for r in season if r["gp"] >= need[r["player_id"]] or r["points"] / max(r["gp"], need[r["player_id"]]) >= best]
    assert {r["player_id"] for r in got} == {r["player_id"] for r in want}
    got = rows(run_tool("compare", {"ids": [21, 11], "metrics": ["points"]}, store).rows)
    assert [r["player_id"] for r in got] == [21, 11]
    assert len(rows(run_tool("compare", {"ids": [21, 11], "scope": "first_n", "n": 1, "metrics": ["points"]}, store).rows)) == 2
    assert rows(run_tool("get_player_stats", {"player_id": 11, "season": "2022-23", "metrics": ["points", "steals"]}, store).rows)[0].keys() == {"player_id", "season", "points"}
    assert run_tool("get_player_stats", {"player_id": 11, "season": "2022-23", "metrics": ["steals"]}, store).not_tracked == ["steals"]
    zones = rows(run_tool("get_player_stats", {"player_id": 11, "season": "2022-23", "zones": True}, store).rows)
    assert sum(z["share"] for z in zones) == pytest.approx(1) and [z["attempts"] for z in zones] == sorted((z["attempts"] for z in zones), reverse=True)
    table = rows(run_tool("get_standings", {"season": "2023-24"}, store).rows)
    assert [r["team_id"] for r in table] == [1, 2, 3, 4] and [r["league_position"] for r in table] == [1, 2, 3, 4]
    assert all(1 in (r["home_team_id"], r["away_team_id"]) and 2 in (r["home_team_id"], r["away_team_id"]) for r in rows(run_tool("get_games", {"team_id": 1, "opponent_id": 2}, store).rows))
    mine = [r["winner_team_id"] == 1 for r in sorted(rows(f["games"]), key=lambda r: (r["game_date"], r["game_id"])) if 1 in (r["home_team_id"], r["away_team_id"])]
    run = most = 0
    for w in mine:
        run = run + 1 if w else 0
        most = max(most, run)
    assert rows(run_tool("get_games", {"team_id": 1, "streak": "W"}, store).rows)[0]["length"] == most
    assert rows(run_tool("get_record", {"record": "triple_doubles"}, store).rows)[0]["value"] == 40
    assert rows(run_tool("get_record", {"record": "championships", "limit": 2}, store).rows)[0]["championships"] == 1
    assert [r["season"] for r in rows(run_tool("get_trend", {"metric": "league_points_per_game"}, store).rows)] == ["2022-23", "2023-24"]
    assert rows(run_tool("get_awards", {"count_by_player": True}, store).rows)[0] == {"player_id": 11, "n": 2, "first": "2022-23", "last": "2023-24"}
    assert rows(run_tool("get_career", {"player_id": 11, "metrics": ["points"]}, store).rows) and rows(run_tool("get_team_stats", {"team_id": 1, "season": "2023-24"}, store).rows)
    assert "data through 2024-06-01" in run_tool("get_career", {"player_id": 11}, store).source
    with pytest.raises(ValueError, match="2013-14"):
        rule_for("per_game_leader", "2012-13")


@pytest.mark.parametrize(
    ("name", "args"),
    [("get_leaders", {}), ("get_leaders", {"metric": "points", "limit": 26}), ("get_leaders", {"metric": "points", "limit": True}), ("compare", {"ids": [1]}), ("get_record", {"record": "x"}), ("none", {}), ("get_career", {"player_id": "11"}), ("get_career", {"player_id": 1, "y": 2})],
)
def test_bad_arguments(name, args):
    with pytest.raises(ArgumentError):
        checked(name, args)


def test_cache_and_registry(league):
    calls = []
    cache = AnswerCache(2)
    make = lambda: calls.append(1) or [1]
    a = {"metric": "points", "season": "2023-24"}
    cache.get("s1", "get_leaders", a, make)
    cache.get("s1", "get_leaders", a | {"limit": 5}, make)
    assert len(calls) == 1 and canonical("get_leaders", a) == canonical("get_leaders", a | {"limit": 5})
    cache.get("s2", "get_leaders", a, make)
    assert len(calls) == 2
    assert not_tracked(league[2], ["steals"], ["2022-23", "2023-24"]) == []
    with pytest.raises(ValueError):
        Registry([Metric("a", "b", "sum(x)"), Metric("a", "b", "sum(y)")])
    with pytest.raises(ValueError):
        Registry([Metric("a", "b", "x + 1")])
    assert len(BOX) == 16
