"""Leader lists: qualification, the would-still-lead rule, ties, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import Rule


def qualifies(rule: Rule, games: str = "gp", team_games: str = "team_gp") -> Column:
    """Whether a row meets the rule: games of its team's (rounded up), least sums, and any of the career sums."""
    ok = F.lit(True)
    if rule.games_part is not None:
        ok = ok & (F.col(games) >= F.ceil(F.col(team_games) * F.lit(rule.games_part) - 1e-9))
    for column, least in rule.at_least:
        ok = ok & (F.col(column) >= least)
    if rule.any_of:
        any_ok = F.lit(False)
        for column, least in rule.any_of:
            any_ok = any_ok | (F.col(column) >= least)
        ok = ok & any_ok
    return F.coalesce(ok, F.lit(False))


def leaders(rows: DataFrame, value: str, key: str, n: int = 5, qualified: Column | None = None, still: Column | None = None, descending: bool = True, ties: str = "cut") -> DataFrame:
    """The n best rows by value, with rank; null values never lead.

    qualified says who may lead. still is the value that a row would have with the games it lacks to qualify: a row that does
    not qualify leads too if even that beats the best qualified value. ties="cut" ranks by value and key and gives n
    rows; "keep" gives every row whose rank by value is at most n.
    """
    rows = rows.where(F.col(value).isNotNull())
    if qualified is not None:
        rows = rows.withColumn("_ok", qualified)
        if still is not None:
            best = rows.where("_ok").agg((F.max if descending else F.min)(value).alias("_best"))
            beats = F.coalesce(still > F.col("_best") if descending else still < F.col("_best"), F.lit(False))
            rows = rows.join(F.broadcast(best)).where(F.col("_ok") | beats).drop("_best")  # one row
        else:
            rows = rows.where("_ok")
        rows = rows.drop("_ok")
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    if ties == "keep":
        # the cut is the n-th value: found by a bounded sort, so no window sees all rows
        cut = rows.orderBy(*order, F.col(key)).limit(n).agg((F.min if descending else F.max)(value).alias("_cut"))
        rows = rows.join(F.broadcast(cut)).where(F.col(value) >= F.col("_cut") if descending else F.col(value) <= F.col("_cut")).drop("_cut")
        return rows.withColumn("rank", F.rank().over(Window.orderBy(*order)))
    top = rows.orderBy(*order, F.col(key)).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order, F.col(key))))


def group_leaders(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """In each group the rows with the greatest value, all of equal ones."""
    best = rows.groupBy(*group).agg(F.max(value).alias("_best"))
    return rows.join(best, group).where(F.col(value) == F.col("_best")).drop("_best")


def standings(teams: DataFrame, rank: str, pct: str, wins: str, key: str, within: list[str]) -> DataFrame:
    """Table order: given rank (nulls last), share of wins, wins, key; with the position."""
    w = Window.partitionBy(*within).orderBy(F.col(rank).asc_nulls_last(), F.col(pct).desc_nulls_last(), F.col(wins).desc_nulls_last(), F.col(key))
    return teams.withColumn("position", F.row_number().over(w))
