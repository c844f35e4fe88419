"""The typed questions: arguments are checked and completed, a frame is built, and the rows come with what a reader needs to state them."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .leaders import leaders, qualifies
from .registry import METRICS, rule_for
from .series import edge_n, in_requested_order, longest, share_of_total, streaks

LINE = ("games_played", "points_per_game", "rebounds_per_game", "assists_per_game", "steals_per_game", "blocks_per_game", "minutes_per_game", "field_goal_pct", "three_point_pct", "free_throw_pct")


class ArgumentError(ValueError):
    """An argument that the question does not take."""


@dataclass(frozen=True)
class Argument:
    kind: type | tuple[type, ...]
    default: Any = None
    required: bool = False
    choices: tuple = ()
    least: int | None = None
    most: int | None = None


@dataclass
class Result:
    rows: DataFrame
    metrics: list[str] = field(default_factory=list)
    not_tracked: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    source: str = ""

    def values(self) -> DataFrame:
        """Numbers that an answer may state: column, value. Ids are never among them."""
        shown = [c for c, t in self.rows.dtypes if t in ("int", "bigint", "double", "float") and not c.endswith("_id")]
        return self.rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in shown))).alias("v")).select("v.*")


_KINDS = ("Regular Season", "Playoffs", "PlayIn")
SCHEMAS: dict[str, dict[str, Argument]] = {
    "get_player_stats": {"player_id": Argument(int, required=True), "season": Argument(str, required=True), "season_type": Argument(str, "Regular Season", choices=_KINDS), "metrics": Argument(list, ("stat_line",)), "team_id": Argument(int), "zones": Argument(bool, False)},
    "get_leaders": {"metric": Argument(str, required=True), "season": Argument(str), "season_type": Argument(str, "Regular Season", choices=_KINDS), "limit": Argument(int, 5, least=1, most=25), "qualified": Argument(bool, True), "ascending": Argument(bool), "rookies": Argument(bool, False)},
    "compare": {"ids": Argument(list, required=True), "metrics": Argument(list, ("stat_line",)), "scope": Argument(str, "career", choices=("season", "career", "first_n", "last_n")), "season": Argument(str), "n": Argument(int, 3, least=1, most=25), "season_type": Argument(str, "Regular Season", choices=_KINDS)},
    "get_team_stats": {"team_id": Argument(int, required=True), "season": Argument(str, required=True), "season_type": Argument(str, "Regular Season", choices=_KINDS), "metrics": Argument(list, ("wins", "losses", "win_pct"))},
    "get_standings": {"season": Argument(str, required=True), "conference": Argument(str)},
    "get_games": {"team_id": Argument(int), "opponent_id": Argument(int), "season": Argument(str), "season_type": Argument(str, choices=_KINDS), "date": Argument(str), "overtime": Argument(bool), "sort": Argument(str, "date", choices=("date", "margin")), "last_n": Argument(int, 100, least=1, most=100), "streak": Argument(str, choices=("W", "L"))},
    "get_career": {"player_id": Argument(int, required=True), "season_type": Argument(str, "Regular Season", choices=_KINDS), "metrics": Argument(list, ("stat_line",))},
    "get_record": {"record": Argument(str, required=True, choices=("points", "threes", "rebounds", "assists", "triple_doubles", "best_record", "championships")), "limit": Argument(int, 1, least=1, most=10)},
    "get_trend": {"metric": Argument(str, required=True), "player_id": Argument(int), "team_id": Argument(int), "from_season": Argument(str), "to_season": Argument(str), "season_type": Argument(str, "Regular Season", choices=_KINDS)},
    "get_awards": {"award": Argument(str), "season": Argument(str), "player_id": Argument(int), "count_by_player": Argument(bool, False)},
}


def checked(name: str, args: dict) -> dict:
    """The arguments with defaults; stat_line becomes its metrics. Raises ArgumentError."""
    if name not in SCHEMAS:
        raise ArgumentError(f"no question {name}")
    known = SCHEMAS[name]
    if extra := set(args) - set(known):
        raise ArgumentError(f"{name} does not take {', '.join(sorted(extra))}")
    out = {}
    for k, a in known.items():
        v = args.get(k, a.default)
        if v is None:
            if a.required:
                raise ArgumentError(f"{name} needs {k}")
        elif not isinstance(v, tuple if isinstance(v, tuple) else a.kind) or (isinstance(v, bool) and a.kind is int):
            raise ArgumentError(f"{k} is not of the right kind")
        elif a.choices and v not in a.choices:
            raise ArgumentError(f"{k} is one of {', '.join(map(str, a.choices))}")
        elif a.least is not None and not a.least <= v <= a.most:
            raise ArgumentError(f"{k} is from {a.least} to {a.most}")
        if k == "metrics" and v is not None:
            v = tuple(m for x in v for m in (LINE if x == "stat_line" else (METRICS[x].name,)))
        out[k] = v
    if name == "compare" and not 2 <= len(out["ids"]) <= 4:
        raise ArgumentError("two to four ids can be compared")
    return out


def canonical(name: str, args: dict) -> str:
    return json.dumps([name, {k: v for k, v in sorted(checked(name, args).items())}], default=list)


class Store:
    """The semantic frames by name (sem_player_season_stats and so on), and first tracked seasons by statistic."""

    def __init__(self, frames: dict[str, DataFrame], first: dict[str, int] | None = None, through: str = ""):
        self.frames, self.first, self.through = frames, first or {}, through

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]


def not_tracked(store: Store, metrics, seasons: list[str]) -> list[str]:
    """Metrics of which all the seasons come before the first season of a statistic that they need."""
    newest = max((int(s[:4]) for s in seasons), default=None)
    return [m for m in metrics if newest is not None and any(newest < store.first.get(r, 0) for r in METRICS[m].requires)]


def _where(rows: DataFrame, **equal) -> DataFrame:
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == v)
    return rows


def _player(store: Store, a: dict) -> Result:
    if a["zones"]:
        rows = _where(store["sem_shots"], player_id=a["player_id"], season=a["season"], season_type=a["season_type"])
        made = rows.groupBy("zone").agg(F.count("*").alias("attempts"), F.count_if("made").alias("made"))
        shares = share_of_total(rows, ["zone"], F.lit(1)).select("zone", "share")
        return Result(made.join(shares, "zone").withColumn("pct", F.col("made") / F.col("attempts")).orderBy(F.desc("attempts"), "zone"))
    missing = not_tracked(store, a["metrics"], [a["season"]])
    view = "sem_player_stint_stats" if a["team_id"] is not None else "sem_player_season_stats"
    rows = _where(store[view], player_id=a["player_id"], season=a["season"], season_type=a["season_type"], team_id=a["team_id"])
    return Result(rows.select("player_id", "season", *(m for m in a["metrics"] if m not in missing and m in rows.columns)), list(a["metrics"]), missing)


def _leaders(store: Store, a: dict) -> Result:
    m = METRICS[a["metric"]]
    career = a["season"] is None
    rows = _where(store["sem_player_career_stats" if career else "sem_player_season_stats"], season=a["season"], season_type=a["season_type"])
    if a["rookies"]:
        rows = rows.join(store["sem_players"].select("player_id", F.col("rookie_season").alias("season")), ["player_id", "season"], "left_semi")
    qualified: Column | None = None
    still: Column | None = None
    if a["qualified"] and m.qualification:
        # over careers there is a rule for means per game alone, in playoffs one for those that have the games' rule
        if career:
            name = "career_per_game" if m.unit == "per_game" else None
        elif a["season_type"] == "Playoffs":
            name = "playoffs" if m.qualification == "per_game_leader" else None
        else:
            name = m.qualification
        if name:
            rule = rule_for(name, a["season"] or "9999")
            qualified = qualifies(rule)
            if rule.would_still_lead:
                needed = F.ceil(F.col("team_gp") * F.lit(rule.games_part) - 1e-9)
                still = F.col(m.name) * F.col("gp") / F.greatest(F.col("gp"), needed)
    descending = m.higher_is_better if a["ascending"] is None else not a["ascending"]
    top = leaders(rows, m.name, "player_id", a["limit"], qualified, still, descending)
    return Result(top.select("rank", "player_id", m.name).orderBy("rank"), [m.name], not_tracked(store, [m.name], [a["season"]] if a["season"] else []))


def _compare(store: Store, a: dict) -> Result:
    metrics = [*a["metrics"]]
    if a["scope"] == "career":
        rows = _where(store["sem_player_career_stats"], season_type=a["season_type"])
    else:
        rows = _where(store["sem_player_season_stats"], season_type=a["season_type"], season=a["season"] if a["scope"] == "season" else None)
        if a["scope"] != "season":
            rows = edge_n(rows.where(F.col("player_id").isin(list(a["ids"]))), ["player_id"], ["season"], a["n"], last=a["scope"] == "last_n")
    own = in_requested_order(rows, "player_id", list(a["ids"]))
    cols = [c for c in ("position", "player_id", "season") if c in own.columns]
    return Result(own.select(*cols, *(m for m in metrics if m in own.columns)).orderBy(*cols), metrics)


def _team(store: Store, a: dict) -> Result:
    rows = _where(store["sem_team_season_stats"], team_id=a["team_id"], season=a["season"], season_type=a["season_type"])
    return Result(rows.select("team_id", "season", *a["metrics"]), list(a["metrics"]), not_tracked(store, a["metrics"], [a["season"]]))


def _standings(store: Store, a: dict) -> Result:
    rows = _where(store["sem_team_season_stats"], season=a["season"], season_type="Regular Season", conference=a["conference"])
    w = Window.orderBy(F.col("conference_rank").asc_nulls_last(), F.col("win_pct").desc_nulls_last(), F.col("wins").desc_nulls_last(), "team_id")
    return Result(rows.withColumn("league_position", F.row_number().over(w)).select("league_position", "team_id", "conference", "conference_rank", "wins", "losses", "win_pct").orderBy("league_position"))


def _games(store: Store, a: dict) -> Result:
    rows = _where(store["sem_games"], season=a["season"], season_type=a["season_type"], overtime=a["overtime"])
    if a["date"] is not None:
        rows = rows.where(F.col("game_date") == F.lit(a["date"]).cast("date"))
    for t in (a["team_id"], a["opponent_id"]):
        if t is not None:
            rows = rows.where(F.lit(t).isin(F.col("home_team_id"), F.col("away_team_id")))
    if a["streak"]:
        if a["team_id"] is None:
            raise ArgumentError("a streak is a team's")
        won = F.col("winner_team_id") == a["team_id"]
        runs = streaks(rows.withColumn("team_id", F.lit(a["team_id"])), ["team_id"], ["game_date", "game_id"], won if a["streak"] == "W" else ~won)
        return Result(longest(runs, ["team_id"]))
    order = [F.desc("game_date"), F.desc("game_id")] if a["sort"] == "date" else [F.desc("margin"), F.desc("game_id")]
    return Result(rows.orderBy(*order).limit(a["last_n"]))


def _career(store: Store, a: dict) -> Result:
    rows = _where(store["sem_player_career_stats"], player_id=a["player_id"], season_type=a["season_type"])
    return Result(rows.select("player_id", *(m for m in a["metrics"] if m in rows.columns)), list(a["metrics"]))


def _record(store: Store, a: dict) -> Result:
    single = {"points": "pts", "threes": "fg3m", "rebounds": "reb", "assists": "ast"}
    if a["record"] in single:
        rows = store["sem_records"].where((F.col("stat") == single[a["record"]]) & (F.col("record_kind") == "single_game"))
        return Result(rows.orderBy(F.desc("value"), "game_date", "player_id").limit(a["limit"]))
    if a["record"] == "triple_doubles":
        curated = store["sem_records"].where("record = 'career_triple_doubles'")
        if not curated.isEmpty():
            return Result(curated.orderBy(F.desc("value"), "player_id").limit(a["limit"]))
        rows = _where(store["sem_player_career_stats"], season_type="Regular Season").select("player_id", F.col("triple_doubles").cast("double").alias("value"))
        return Result(rows.orderBy(F.desc_nulls_last("value"), "player_id").limit(a["limit"]), notes=["computed from game logs"])
    if a["record"] == "best_record":
        rows = _where(store["sem_team_season_stats"], season_type="Regular Season").select("team_id", "season", "wins", "losses", "win_pct")
        return Result(rows.orderBy(F.desc_nulls_last("win_pct"), F.desc("wins"), "season", "team_id").limit(a["limit"]))
    rows = _where(store["sem_team_all_time_stats"], season_type="Regular Season").select("franchise_id", "team_name", "championships")
    return Result(rows.orderBy(F.desc_nulls_last("championships"), "franchise_id").limit(a["limit"]))


def _trend(store: Store, a: dict) -> Result:
    m = METRICS[a["metric"]]
    view = "sem_player_season_stats" if a["player_id"] is not None else "sem_team_season_stats" if a["team_id"] is not None else "sem_league_season_stats"
    rows = _where(store[view], player_id=a["player_id"], team_id=a["team_id"], season_type=a["season_type"])
    rows = rows.where(F.col("season").between(a["from_season"] or "0", a["to_season"] or "9"))
    return Result(rows.select("season", m.name).orderBy("season"), [m.name])


def _awards(store: Store, a: dict) -> Result:
    rows = _where(store["sem_awards"], award=a["award"], season=a["season"], player_id=a["player_id"])
    if a["count_by_player"]:
        return Result(rows.groupBy("player_id").agg(F.count("*").alias("n"), F.min("season").alias("first"), F.max("season").alias("last")).orderBy(F.desc("n"), "player_id").limit(10))
    line = store["sem_player_season_stats"].where("season_type = 'Regular Season'").select("player_id", "season", *(m for m in LINE if m in store["sem_player_season_stats"].columns))
    return Result(rows.join(line, ["player_id", "season"], "left").orderBy("season", "award", "player_id"))


RUN: dict[str, Callable[[Store, dict], Result]] = {
    "get_player_stats": _player, "get_leaders": _leaders, "compare": _compare, "get_team_stats": _team, "get_standings": _standings, "get_games": _games, "get_career": _career, "get_record": _record, "get_trend": _trend, "get_awards": _awards,
}


def run_tool(name: str, args: dict, store: Store) -> Result:
    """Answers a typed question."""
    a = checked(name, args)
    out = RUN[name](store, a)
    parts = [*out.metrics, *(f"{k}={v}" for k, v in a.items() if k in ("season", "season_type") and v is not None), f"data through {store.through}" if store.through else ""]
    out.source = " · ".join(x for x in parts if x)
    return out


class AnswerCache:
    """The last answers by question and snapshot; a new snapshot empties it."""

    def __init__(self, size: int = 2000):
        self.size, self.snapshot, self.known = size, None, OrderedDict()

    def get(self, snapshot: str, name: str, args: dict, make: Callable[[], list]) -> list:
        if snapshot != self.snapshot:
            self.known.clear()
            self.snapshot = snapshot
        key = canonical(name, args)
        if key not in self.known:
            self.known[key] = make()
            if len(self.known) > self.size:
                self.known.popitem(last=False)
        self.known.move_to_end(key)
        return self.known[key]
