"""The governed metrics, qualification rules and first tracked seasons."""

from __future__ import annotations

from dataclasses import dataclass

from .metrics import Metric, Registry

#: Version of the definitions.
VERSION = "0.4.0"
_SCT = ("season", "career", "stint")
_SC = ("season", "career")
_T = ("team_season", "team_all_time")
_DOUBLES = " + ".join(f"cast(coalesce({x}, 0) >= 10 as int)" for x in ("pts", "reb", "ast", "stl", "blk"))

# What each metric is.
_TOTALS = (
    ("games_played", "gp", ()), ("games_started", "gs", ("gs",)), ("points", "pts", ()), ("rebounds", "reb", ("reb",)), ("assists", "ast", ()), ("steals", "stl", ("stl",)), ("blocks", "blk", ("blk",)), ("turnovers", "tov", ("tov",)),
    ("field_goals_made", "fgm", ()), ("threes_made", "fg3m", ("fg3m",)), ("threes_attempted", "fg3a", ("fg3a",)), ("free_throws_made", "ftm", ()),
)
_PER_GAME = (("points", "pts", ()), ("rebounds", "reb", ("reb",)), ("assists", "ast", ()), ("steals", "stl", ("stl",)), ("blocks", "blk", ("blk",)), ("minutes", "minutes", ("minutes",)))
METRICS = Registry(
    [
        *(Metric(n, "player_season", f"sum({c})", _SCT, requires=r) for n, c, r in _TOTALS),
        Metric("minutes", "player_season", "sum(minutes)", _SCT, "minutes", 0, requires=("minutes",)),
        *(Metric(f"{n}_per_game", "player_season", f"sum({c}) / nullif(sum(gp), 0)", _SCT, "per_game", 1, qualification="per_game_leader", requires=r) for n, c, r in _PER_GAME),
        Metric("field_goal_pct", "player_season", "sum(fgm) / nullif(sum(fga), 0)", _SCT, "percent", 1, qualification="fg_pct_leader"),
        Metric("three_point_pct", "player_season", "sum(fg3m) / nullif(sum(fg3a), 0)", _SCT, "percent", 1, qualification="fg3_pct_leader", requires=("fg3m", "fg3a")),
        Metric("free_throw_pct", "player_season", "sum(ftm) / nullif(sum(fta), 0)", _SCT, "percent", 1, qualification="ft_pct_leader"),
        Metric("true_shooting_pct", "player_season", "sum(pts) / nullif(2 * (sum(fga) + 0.44D * sum(fta)), 0)", _SCT, "percent", 1, qualification="ts_pct_leader"),
        Metric("effective_fg_pct", "player_season", "(sum(fgm) + 0.5D * sum(fg3m)) / nullif(sum(fga), 0)", _SCT, "percent", 1, qualification="fg_pct_leader", requires=("fg3m",)),
        Metric("usage_rate", "player_advanced", "max(usg_pct)", ("season",), "percent", 1, qualification="per_game_leader", requires=("advanced",)),
        Metric("triple_doubles", "player_game", f"count_if(({_DOUBLES}) >= 3)", _SC),
        Metric("double_doubles", "player_game", f"count_if(({_DOUBLES}) >= 2)", _SC),
        Metric("forty_point_games", "player_game", "count_if(pts >= 40)", _SC),
        Metric("plus_minus", "player_game", "sum(plus_minus)", _SC, requires=("plus_minus",)),
        Metric("game_points", "player_game", "sum(pts)", ("game",)),
        Metric("wins", "team_season", "sum(wins)", _T),
        Metric("losses", "team_season", "sum(losses)", _T, higher_is_better=False),
        Metric("win_pct", "team_season", "sum(wins) / nullif(sum(gp), 0)", _T, "rate", 3),
        Metric("team_points_per_game", "team_season", "sum(pts) / nullif(sum(gp), 0)", _T, "per_game", 1),
        Metric("opponent_points_per_game", "team_season", "sum(opp_pts) / nullif(sum(gp), 0)", _T, "per_game", 1, higher_is_better=False),
        Metric("offensive_rating", "team_season", "max(off_rating)", ("team_season",), "rating", 1, requires=("advanced",)),
        Metric("defensive_rating", "team_season", "max(def_rating)", ("team_season",), "rating", 1, requires=("advanced",), higher_is_better=False),
        Metric("net_rating", "team_season", "max(net_rating)", ("team_season",), "rating", 1, requires=("advanced",)),
        Metric("pace", "team_season", "max(pace)", ("team_season",), "rating", 1, requires=("advanced",)),
        Metric("home_wins", "team_season", "sum(home_wins)", ("team_season",)),
        Metric("home_losses", "team_season", "sum(home_losses)", ("team_season",), higher_is_better=False),
        Metric("road_wins", "team_season", "sum(road_wins)", ("team_season",)),
        Metric("road_losses", "team_season", "sum(road_losses)", ("team_season",), higher_is_better=False),
        Metric("championships", "team_titles", "count(*)", ("team_all_time",)),
        Metric("league_points_per_game", "league_season", "sum(pts) / nullif(sum(gp), 0)", ("league_season",), "per_game", 1),
        Metric("league_three_point_attempt_rate", "league_season", "sum(fg3a) / nullif(sum(fga), 0)", ("league_season",), "percent", 1, requires=("fg3a",)),
        Metric("shot_attempts", "shots", "count(*)", _SC, requires=("shots",)),
        Metric("shot_fg_pct", "shots", "count_if(made) / nullif(count(*), 0)", _SC, "percent", 1, requires=("shots",)),
        Metric("restricted_area_fg_pct", "shots", "count_if(made) / nullif(count(*), 0)", _SC, "percent", 1, "zone = 'Restricted Area'", requires=("shots",)),
        Metric("corner_threes_made", "shots", "count_if(made)", _SC, where="zone in ('Left Corner 3', 'Right Corner 3')", requires=("shots",)),
        Metric("step_back_three_pct", "shots", "count_if(made) / nullif(count(*), 0)", _SC, "percent", 1, "shot_type = '3PT Field Goal' and action_type ilike 'step back%'", requires=("shots",)),
        Metric("mvp_awards", "awards", "count(*)", ("career",), where="award = 'NBA Most Valuable Player'"),
        Metric("all_star_selections", "awards", "count(*)", ("career",), where="award = 'NBA All-Star'"),
        Metric("player_championships", "player_titles", "count(*)", ("career",)),
    ]
)


@dataclass(frozen=True)
class Rule:
    """Who may lead: a part of the team's games, least sums of columns, or either of two sums over a career."""

    name: str
    from_season: str | None = None
    games_part: float | None = None
    at_least: tuple[tuple[str, int], ...] = ()
    any_of: tuple[tuple[str, int], ...] = ()
    would_still_lead: bool = False


# The qualification rules.
RULES = {
    r.name: r
    for r in (
        Rule("per_game_leader", "2013-14", 0.70, would_still_lead=True),
        Rule("playoffs", None, 0.70),
        Rule("fg3_pct_leader", "2013-14", at_least=(("threes_made", 82),)),
        Rule("ts_pct_leader", "2013-14", 0.70, (("field_goals_made", 300),)),
        Rule("fg_pct_leader", "2013-14", at_least=(("field_goals_made", 300),)),
        Rule("ft_pct_leader", "2013-14", at_least=(("free_throws_made", 125),)),
        Rule("career_per_game", None, any_of=(("games_played", 400), ("points", 10_000))),
    )
}


def rule_for(name: str, season: str) -> Rule:
    """The rule in force in a season; an error before its first."""
    rule = RULES[name]
    if rule.from_season and season < rule.from_season:
        raise ValueError(f"{name} is not defined before {rule.from_season}")
    return rule
