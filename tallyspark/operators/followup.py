"""What a follow-up question means: the players, teams, season and kind of season that earlier turns left standing.

Whatever stands after a turn is the newest thing that a turn named, or that a pronoun took from the answer before it, so in batch
the whole conversation is a few running windows. In a stream the same is kept as a conversation's state by transformWithState; both give the same rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Pronouns, words for several, and how follow-up questions begin.
PLAYER_PRONOUNS = ("he", "him", "his", "he's", "himself")
TEAM_PRONOUNS = ("they", "them", "their", "they're")
SEVERAL = ("both", "each", "either", "the two", "those two", "them")
FOLLOW_UPS = ("and", "what about", "how about", "and what about", "compare that", "over", "in the", "what's their", "what is their", "how many has", "how many did")
#: Words up to which any question counts as a follow-up.
SHORT = 5

_LISTS = ("players", "teams", "result_players", "result_teams")
TURN = "turn int, question string, players array<string>, teams array<string>, ambiguous boolean, season string, several_seasons boolean, season_type string, phrase boolean, arg_season string, arg_season_type string, metric string, result_players array<string>, result_teams array<string>"
CONTEXT = "turn int, players array<string>, teams array<string>, season string, season_type string, metric string, carried array<string>, unclear string, candidates array<string>"


def _any(words: tuple[str, ...], start: bool = False) -> str:
    return (r"^\s*" if start else r"\b") + f"({'|'.join(words)})" + r"\b"


def _has(text: Column, words: tuple[str, ...], start: bool = False) -> Column:
    return F.coalesce(text.rlike("(?iU)" + _any(words, start)), F.lit(False))


def carry_over(turns: DataFrame, conversation: str) -> DataFrame:
    """conversation and CONTEXT for every turn (conversation and TURN; turns of a conversation have numbers of their own).

    players and teams of a turn are those it names, else those carried over: by a pronoun, from the last answer or else from the state;
    by a follow-up of few words, from the state. A pronoun that several players fit is unclear, unless it says that several are meant. Nothing is carried
    where a name is ambiguous. season is carried where the turn names none, season_type where it has no phrase of time. Null lists are empty, null flags false.
    """
    w = Window.partitionBy(conversation).orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<string>")
    rows = turns.withColumns({c: F.coalesce(c, none) for c in _LISTS} | {c: F.coalesce(c, F.lit(False)) for c in ("ambiguous", "several_seasons", "phrase")})
    q = F.coalesce("question", F.lit(""))
    rows = rows.withColumns(
        {
            "_he": _has(q, PLAYER_PRONOUNS), "_they": _has(q, TEAM_PRONOUNS), "_several": _has(q, SEVERAL), "_follows": _has(q, FOLLOW_UPS, start=True) | (F.size(F.regexp_extract_all(q, F.lit(r"\S+"), F.lit(0))) <= SHORT),
            "_last_players": F.coalesce(F.lag("result_players").over(w), none), "_last_teams": F.coalesce(F.lag("result_teams").over(w), none),
        }
    )
    named = lambda c: F.size(c) > 0
    one = (F.size("_last_players") == 1) | ((F.size("_last_players") > 1) & F.col("_several"))
    left = {
        "_players": F.when(named("players"), F.col("players")).when(~F.col("ambiguous") & F.col("_he") & one, F.col("_last_players")),
        "_teams": F.when(named("teams"), F.col("teams")).when(~F.col("ambiguous") & F.col("_they") & named("_last_teams"), F.col("_last_teams")),
        "_season": F.coalesce("arg_season", "season"), "_type": F.coalesce("arg_season_type", "season_type"),
    }
    rows = rows.withColumns(left)
    rows = rows.withColumns({f"_state{c}": F.last(c, ignorenulls=True).over(before) for c in left} | {"metric": F.last("metric", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    players, teams = F.coalesce("_state_players", none), F.coalesce("_state_teams", none)
    pool = F.when(named("_last_players"), F.col("_last_players")).otherwise(players)
    open_ = ~F.col("ambiguous") & ~named("players")
    by_pronoun = open_ & F.col("_he") & ((F.size(pool) == 1) | ((F.size(pool) > 1) & F.col("_several")))
    unclear = open_ & F.col("_he") & (F.size(pool) > 1) & ~F.col("_several")
    by_follow = open_ & ~F.col("_he") & ~named("teams") & (F.size(players) > 0) & F.col("_follows")
    rows = rows.withColumn("_own", F.when(by_pronoun, pool).when(by_follow, players).otherwise(F.col("players")))
    team_pool = F.when(named("_last_teams"), F.col("_last_teams")).otherwise(teams)
    open_teams = ~F.col("ambiguous") & ~named("teams")
    team_pronoun = open_teams & F.col("_they") & (F.size(team_pool) > 0)
    team_follow = open_teams & ~team_pronoun & ~named("_own") & (F.size(teams) > 0) & F.col("_follows")
    season = F.col("season").isNull() & ~F.col("several_seasons") & F.col("_state_season").isNotNull()
    kind = F.col("season_type").isNull() & ~F.col("phrase") & F.col("_state_type").isNotNull()
    carried = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in (("players", by_pronoun | by_follow), ("teams", team_pronoun | team_follow), ("season", season), ("season_type", kind)))))
    return rows.select(
        conversation, "turn", F.col("_own").alias("players"), F.when(team_pronoun, team_pool).when(team_follow, teams).otherwise(F.col("teams")).alias("teams"), F.when(season, F.col("_state_season")).otherwise(F.col("season")).alias("season"),
        F.when(kind, F.col("_state_type")).otherwise(F.col("season_type")).alias("season_type"), "metric", carried.alias("carried"), F.when(unclear, F.lower(F.regexp_extract(q, "(?iU)" + _any(PLAYER_PRONOUNS), 1))).alias("unclear"), F.when(unclear, pool).alias("candidates"),
    )


def step(state: dict, turn: dict) -> dict:
    """A turn's CONTEXT; state is brought up to date."""
    said = turn["question"] or ""
    has = lambda words, start=False: re.search(_any(words, start), said, re.I)
    players, teams = list(turn["players"] or ()), list(turn["teams"] or ())
    follows = bool(has(FOLLOW_UPS, True)) or len(said.split()) <= SHORT
    carried, unclear, candidates = [], None, None
    if not turn["ambiguous"]:
        if not players:
            he, pool = has(PLAYER_PRONOUNS), state.get("result_players") or state.get("players") or []
            if he and len(pool) > 1 and not has(SEVERAL):
                unclear, candidates = he[1].lower(), pool
            elif he or (follows and not teams):
                players = pool if he else state.get("players") or []
                carried += ["players"] * bool(players)
        if not teams:
            they, pool = has(TEAM_PRONOUNS), state.get("result_teams") or state.get("teams") or []
            if (they and pool) or (not players and follows):
                teams = pool if they and pool else state.get("teams") or []
                carried += ["teams"] * bool(teams)
    season, kind = turn["season"], turn["season_type"]
    if season is None and not turn["several_seasons"] and state.get("season") is not None:
        season = state["season"]
        carried.append("season")
    if kind is None and not turn["phrase"] and state.get("season_type") is not None:
        kind = state["season_type"]
        carried.append("season_type")
    first = lambda *found: next((x for x in found if x), None)
    state |= {"players": players or state.get("players"), "teams": teams or state.get("teams"), "result_players": list(turn["result_players"] or ()), "result_teams": list(turn["result_teams"] or ())}
    state |= {"season": first(turn["arg_season"], season, state.get("season")), "season_type": first(turn["arg_season_type"], kind, state.get("season_type")), "metric": first(turn["metric"], state.get("metric"))}
    return {"turn": turn["turn"], "players": players, "teams": teams, "season": season, "season_type": kind, "metric": state["metric"], "carried": carried, "unclear": unclear, "candidates": candidates}


class Conversation(StatefulProcessor):
    """A conversation's state; turns of a batch are taken in their order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "kept string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        each = (t for r in rows for t in r.astype(object).where(r.notna(), None).to_dict("records"))
        turns = sorted(({k: list(v) if k in _LISTS and v is not None else v for k, v in t.items()} for t in each), key=lambda t: t["turn"])
        found = pd.DataFrame([step(state, t) for t in turns])
        self.state.update((json.dumps(state),))
        found.insert(0, "conversation", key[0])
        yield found

    def close(self) -> None:
        pass


def carry_over_stream(turns: DataFrame, conversation: str) -> DataFrame:
    """carry_over() of a stream of turns; those of a conversation come in their order, several in a batch or not. The session needs the RocksDB state store."""
    kind = turns.schema[conversation].dataType.simpleString()
    columns = [c.split()[0] for c in TURN.split(", ")]
    found = turns.select(conversation, *columns).groupBy(conversation).transformWithStateInPandas(Conversation(), f"conversation {kind}, {CONTEXT}", "Append", "None")
    return found.withColumnRenamed("conversation", conversation)
