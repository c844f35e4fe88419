"""Metric and leader queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.casts import masked, season_label
from ..operators.leaders import group_leaders, leaders, qualifies, standings
from ..operators.metrics import Base, Metric, compile_metrics
from ..operators.registry import Rule
from ..operators.series import change, edge_n, eras, in_requested_order, longest, pooled_ratio, share_of_total, streaks
from .base import TS, G, PS, games, player_seasons, query, team_seasons, teams_of

POINTS = Metric("points", "player_season", "round(sum(pts), 4)")
PLAYED = Metric("games_played", "player_season", "sum(gp)")
PER_GAME = Metric("points_per_game", "player_season", "round(sum(pts) / nullif(sum(gp), 0), 6)", decimals=1, unit="per_game")
URGENT_PCT = Metric("urgent_pct", "player_season", "round(sum(urgent) / nullif(sum(gp), 0), 6)", decimals=1, unit="percent")
BIG = Metric("big_games", "player_game", "count_if(pts >= 250000)")
URGENT_BIG = Metric("urgent_big_games", "player_game", "count_if(pts >= 250000)", where="urgent = 1")
MADE_PCT = Metric("flag_r_pct", "shots", "round(count_if(made) / nullif(count(*), 0), 6)", where="zone = 'R'")
SHOTS = Metric("shot_attempts", "shots", "count(*)")


@query(f"WITH {PS} SELECT player, season, season_type, round(sum(pts), 4) points, CAST(sum(gp) AS BIGINT) games_played, round(sum(pts) / sum(gp), 6) points_per_game, round(sum(urgent) / sum(gp), 6) urgent_pct FROM ps GROUP BY 1, 2, 3")
def metric_season(t):
    rows = player_seasons(t)
    keys = ("player", "season", "season_type")
    return compile_metrics(rows.select(*keys).distinct(), {"player_season": Base(rows, keys)}, [POINTS, PLAYED, PER_GAME, URGENT_PCT])


@query(f"WITH {PS} SELECT player, season_type, round(sum(pts), 4) points, CAST(sum(gp) AS BIGINT) games_played, round(sum(pts) / sum(gp), 6) points_per_game FROM ps GROUP BY 1, 2")
def metric_career(t):
    rows = player_seasons(t)
    keys = ("player", "season_type")
    return compile_metrics(rows.select(*keys).distinct(), {"player_season": Base(rows, keys)}, [POINTS, PLAYED, PER_GAME])


@query(f"WITH {G} SELECT player, season, c_nationkey team, round(sum(pts), 4) points, count(*) games_played FROM g JOIN customer ON c_custkey = player GROUP BY 1, 2, 3")
def metric_stint(t):
    rows = games(t).join(teams_of(t), "player").withColumn("gp", F.lit(1).cast("long"))
    keys = ("player", "season", "team")
    return compile_metrics(rows.select(*keys).distinct(), {"player_season": Base(rows, keys)}, [POINTS, PLAYED])


@query(f"WITH {TS} SELECT n_regionkey league, season, round(sum(pts) / sum(gp), 6) points_per_game, CAST(sum(gp) AS BIGINT) games_played FROM ts JOIN nation ON n_nationkey = team GROUP BY 1, 2")
def metric_league(t):
    rows = team_seasons(t).join(F.broadcast(t("nation").select(F.col("n_nationkey").alias("team"), F.col("n_regionkey").alias("league"))), "team")
    keys = ("league", "season")
    return compile_metrics(rows.select(*keys).distinct(), {"player_season": Base(rows, keys)}, [PER_GAME, PLAYED])


@query(
    f"""WITH {PS}, s AS (SELECT o_custkey player, l_returnflag zone, l_linestatus = 'F' made FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
spine AS (SELECT c_custkey player FROM customer), a AS (SELECT player, round(sum(pts), 4) points, CAST(sum(gp) AS BIGINT) games_played, round(sum(pts) / sum(gp), 6) points_per_game FROM ps GROUP BY 1),
b AS (SELECT player, count(*) FILTER (pts >= 250000) big_games, CASE WHEN count(*) FILTER (urgent = 1) > 0 THEN count(*) FILTER (urgent = 1 AND pts >= 250000) END urgent_big_games FROM g GROUP BY 1),
c AS (SELECT player, CASE WHEN count(*) FILTER (zone = 'R') > 0 THEN round(count(*) FILTER (zone = 'R' AND made) / count(*) FILTER (zone = 'R'), 6) END flag_r_pct, count(*) shot_attempts FROM s GROUP BY 1)
SELECT spine.player, points, games_played, points_per_game, big_games, urgent_big_games, flag_r_pct, shot_attempts FROM spine LEFT JOIN a USING (player) LEFT JOIN b USING (player) LEFT JOIN c USING (player)"""
)
def metric_career_fused(t):
    log = games(t)
    shots = t("lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_returnflag").alias("zone"), (F.col("l_linestatus") == "F").alias("made")).join(log.select("game", "player"), "game")
    bases = {"player_season": Base(player_seasons(t), ("player",)), "player_game": Base(log, ("player",)), "shots": Base(shots, ("player",))}
    return compile_metrics(t("customer").select(F.col("c_custkey").alias("player")), bases, [POINTS, PLAYED, PER_GAME, BIG, URGENT_BIG, MADE_PCT, SHOTS])


@query(f"WITH {G}, a AS (SELECT player, count(*) n, CAST(sum(urgent) AS BIGINT) titles FROM g GROUP BY 1) SELECT player, season_type, CASE WHEN season_type = 'F' THEN titles END titles FROM (SELECT DISTINCT player, season_type FROM g) LEFT JOIN a USING (player)")
def metric_only_regular(t):
    """Awards hang on one row of the career only."""
    titles = Metric("titles", "awards", "sum(urgent)")
    return compile_metrics(games(t).select("player", "season_type").distinct(), {"awards": Base(games(t), ("player",), "season_type = 'F'")}, [titles])


_SEASON = f"WITH {G}, p AS (SELECT player, season, c_nationkey team, count(*) gp, sum(pts) pts, CAST(sum(urgent) AS BIGINT) urgent FROM g JOIN customer ON c_custkey = player GROUP BY 1, 2, 3), m AS (SELECT team, season, max(gp) team_gp FROM p GROUP BY 1, 2), q AS (SELECT p.*, team_gp, round(pts / gp, 6) ppg FROM p JOIN m USING (team, season) WHERE season = 1997)"


def _season(t):
    rows = games(t).join(teams_of(t), "player").groupBy("player", "season", "team").agg(F.count("*").alias("gp"), F.sum("pts").alias("pts"), F.sum("urgent").alias("urgent"))
    most = rows.groupBy("team", "season").agg(F.max("gp").alias("team_gp"))
    return rows.join(most, ["team", "season"]).where("season = 1997").withColumn("ppg", F.round(F.col("pts") / F.col("gp"), 6))


PER_GAME_RULE = Rule("part of games", games_part=0.70, would_still_lead=True)


@query(_SEASON + " SELECT player, ppg, CAST(row_number() OVER (ORDER BY ppg DESC, player) AS INTEGER) rank FROM q WHERE gp >= ceil(0.7 * team_gp - 1e-9) QUALIFY rank <= 10")
def leaders_qualified(t):
    return leaders(_season(t), "ppg", "player", 10, qualifies(PER_GAME_RULE)).select("player", "ppg", "rank")


@query(
    _SEASON + ", b AS (SELECT max(ppg) best FROM q WHERE gp >= ceil(0.7 * team_gp - 1e-9)) SELECT player, ppg, CAST(row_number() OVER (ORDER BY ppg DESC, player) AS INTEGER) rank FROM q, b"
    " WHERE gp >= ceil(0.7 * team_gp - 1e-9) OR round(pts / greatest(gp, ceil(0.7 * team_gp - 1e-9)), 6) > best QUALIFY rank <= 10"
)
def leaders_would_still_lead(t):
    needed = F.ceil(F.col("team_gp") * F.lit(0.70) - 1e-9)
    return leaders(_season(t), "ppg", "player", 10, qualifies(PER_GAME_RULE), F.round(F.col("pts") / F.greatest("gp", needed), 6)).select("player", "ppg", "rank")


@query(_SEASON + " SELECT player, ppg, CAST(row_number() OVER (ORDER BY ppg DESC, player) AS INTEGER) rank FROM q WHERE urgent >= 2 QUALIFY rank <= 10")
def leaders_min_made(t):
    return leaders(_season(t), "ppg", "player", 10, qualifies(Rule("made", at_least=(("urgent", 2),)))).select("player", "ppg", "rank")


@query(f"WITH {PS}, c AS (SELECT player, sum(gp) gp, sum(pts) pts, round(sum(pts) / sum(gp), 6) ppg FROM ps GROUP BY 1) SELECT player, ppg, CAST(row_number() OVER (ORDER BY ppg DESC, player) AS INTEGER) rank FROM c WHERE gp >= 15 OR pts >= 3000000 QUALIFY rank <= 10")
def leaders_career_or_rule(t):
    rows = player_seasons(t).groupBy("player").agg(F.sum("gp").alias("gp"), F.sum("pts").alias("pts")).withColumn("ppg", F.round(F.col("pts") / F.col("gp"), 6))
    return leaders(rows, "ppg", "player", 10, qualifies(Rule("career", any_of=(("gp", 15), ("pts", 3_000_000))))).select("player", "ppg", "rank")


@query(f"WITH {TS}, a AS (SELECT team, round(sum(pts) / sum(gp), 6) ppg FROM ts GROUP BY 1) SELECT team, ppg, CAST(row_number() OVER (ORDER BY ppg, team) AS INTEGER) rank FROM a QUALIFY rank <= 5")
def leaders_asc(t):
    """A metric of which less is better."""
    rows = team_seasons(t).groupBy("team").agg(F.round(F.sum("pts") / F.sum("gp"), 6).alias("ppg"))
    return leaders(rows, "ppg", "team", 5, descending=False).select("team", "ppg", "rank")


@query(f"WITH {PS}, a AS (SELECT player, CAST(sum(gp) AS BIGINT) gp FROM ps GROUP BY 1) SELECT player, gp, CAST(rank() OVER (ORDER BY gp DESC) AS INTEGER) rank FROM a QUALIFY rank <= 10")
def leaders_ties_kept(t):
    return leaders(player_seasons(t).groupBy("player").agg(F.sum("gp").alias("gp")), "gp", "player", 10, ties="keep").select("player", "gp", "rank")


@query(f"WITH {PS}, a AS (SELECT player, CAST(sum(gp) AS BIGINT) gp FROM ps GROUP BY 1) SELECT player, gp, CAST(row_number() OVER (ORDER BY gp DESC, player) AS INTEGER) rank FROM a QUALIFY rank <= 10")
def leaders_ties_cut(t):
    return leaders(player_seasons(t).groupBy("player").agg(F.sum("gp").alias("gp")), "gp", "player", 10).select("player", "gp", "rank")


@query(f"WITH {PS}, f AS (SELECT player, min(season) season FROM ps GROUP BY 1) SELECT player, season, round(sum(pts), 4) pts FROM ps JOIN f USING (player, season) WHERE season > 1995 GROUP BY 1, 2")
def rookies_only(t):
    rows = player_seasons(t)
    first = rows.groupBy("player").agg(F.min("season").alias("season"))
    return rows.join(first, ["player", "season"], "left_semi").where("season > 1995").groupBy("player", "season").agg(F.round(F.sum("pts"), 4).alias("pts"))


_YEARS = f"WITH {PS}, y AS (SELECT player, season, round(sum(pts), 4) pts, CAST(sum(gp) AS BIGINT) gp FROM ps GROUP BY 1, 2)"


def _years(t):
    return player_seasons(t).groupBy("player", "season").agg(F.round(F.sum("pts"), 4).alias("pts"), F.sum("gp").alias("gp"))


@query(_YEARS + " SELECT player, season, pts FROM y QUALIFY row_number() OVER (PARTITION BY player ORDER BY season) <= 2")
def compare_first_n(t):
    return edge_n(_years(t), ["player"], ["season"], 2).select("player", "season", "pts")


@query(_YEARS + " SELECT player, season, pts FROM y QUALIFY row_number() OVER (PARTITION BY player ORDER BY season DESC) <= 3")
def compare_last_n(t):
    return edge_n(_years(t), ["player"], ["season"], 3, last=True).select("player", "season", "pts")


@query(_YEARS + ", w AS (SELECT unnest([7, 3, 11]) player, unnest([0, 1, 2]) AS \"position\") SELECT y.player, season, pts, CAST(\"position\" AS INTEGER) \"position\" FROM y JOIN w ON w.player = y.player")
def compare_requested_order(t):
    return in_requested_order(_years(t), "player", [7, 3, 11]).select("player", "season", "pts", "position")


@query(
    f"WITH {TS}, a AS (SELECT team, CAST(sum(wins) AS BIGINT) wins, round(sum(wins) / sum(gp), 6) win_pct FROM ts GROUP BY 1) SELECT n_regionkey league, team, wins, win_pct, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY nullif(team % 7, 0) NULLS LAST, win_pct DESC, wins DESC, team) AS INTEGER) \"position\" FROM a JOIN nation ON n_nationkey = team",
    "standings",
)
def table_of_standings(t):
    rows = team_seasons(t).groupBy("team").agg(F.sum("wins").alias("wins"), F.round(F.sum("wins") / F.sum("gp"), 6).alias("win_pct"))
    rows = rows.join(F.broadcast(t("nation").select(F.col("n_nationkey").alias("team"), F.col("n_regionkey").alias("league"))), "team").withColumn("given", F.expr("nullif(team % 7, 0)"))
    return standings(rows, "given", "win_pct", "wins", "team", ["league"]).select("league", "team", "wins", "win_pct", "position")


@query(_YEARS + " SELECT season, pts, pts - lag(pts) OVER (ORDER BY season) delta FROM (SELECT season, pts FROM y WHERE player = 7)".replace("pts - lag(pts) OVER (ORDER BY season)", "round(pts - lag(pts) OVER (ORDER BY season), 4)"))
def trend_entity(t):
    return change(_years(t).where("player = 7"), ["player"], "season", "pts").select("season", "pts", F.round("delta", 4).alias("delta"))


@query(f"WITH {G} SELECT season, round(sum(pts) / count(*), 6) ppg, season || '-' || lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0') label FROM g GROUP BY season")
def trend_league(t):
    return games(t).groupBy("season").agg(F.round(F.sum("pts") / F.count("*"), 6).alias("ppg")).withColumn("label", season_label("season"))


@query(_YEARS + ", d AS (SELECT player, gp - lag(gp) OVER (PARTITION BY player ORDER BY season) delta FROM y) SELECT player, bool_and(delta >= 0) rising FROM d WHERE delta IS NOT NULL GROUP BY 1")
def trend_delta(t):
    return change(_years(t), ["player"], "season", "gp").where("delta is not null").groupBy("player").agg(F.bool_and(F.col("delta") >= 0).alias("rising"))


@query(
    """WITH r AS (SELECT user_id, ts, event_id, value > 20 w FROM events), b AS (SELECT *, sum(CASE WHEN w THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) k FROM r),
s AS (SELECT user_id, min(ts) "first", max(ts) "last", count(*) length FROM b WHERE w GROUP BY user_id, k) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, "first") = 1"""
)
def streak_longest(t):
    return longest(streaks(t("events"), ["user_id"], ["ts", "event_id"], F.col("value") > 20), ["user_id"])


@query(f"WITH {G}, y AS (SELECT DISTINCT player, season FROM g), i AS (SELECT *, season - row_number() OVER (PARTITION BY player ORDER BY season) k FROM y) SELECT player, min(season) first_step, max(season) last_step FROM i GROUP BY player, k", "eras")
def eras_of_players(t):
    return eras(games(t), ["player"], "season", [])


@query(
    "WITH d AS (SELECT CAST(ts AS DATE) \"day\", event_type, user_id, round(sum(value), 1) v FROM events GROUP BY ALL), m AS (SELECT \"day\", event_type, max(v) v FROM d GROUP BY 1, 2) SELECT \"day\", event_type, v, string_agg(CAST(user_id AS VARCHAR), ' / ' ORDER BY user_id) holders FROM d JOIN m USING (\"day\", event_type, v) GROUP BY 1, 2, 3"
)
def box_leaders_ties(t):
    rows = t("events").groupBy(F.to_date("ts").alias("day"), "event_type", "user_id").agg(F.round(F.sum("value"), 1).alias("v"))
    best = group_leaders(rows, ["day", "event_type"], "v")
    return best.groupBy("day", "event_type", "v").agg(F.array_join(F.transform(F.array_sort(F.collect_list("user_id")), lambda x: x.cast("string")), " / ").alias("holders"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) \"value\", round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) share FROM lineitem GROUP BY 1, 2", "share_of_total")
def shares(t):
    return share_of_total(t("lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity")).select("l_returnflag", "l_linestatus", F.round("value", 4).alias("value"), F.round("share", 6).alias("share"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) ratio FROM lineitem GROUP BY 1", "pooled_ratio")
def pooled(t):
    rows = t("lineitem").withColumn("off", F.col("l_extendedprice") * F.col("l_discount"))
    return pooled_ratio(rows, ["l_returnflag"], "off", "l_extendedprice").select("l_returnflag", F.round("ratio", 6).alias("ratio"))


@query("SELECT l_shipdate, n, all_days FROM (SELECT l_shipdate, count(*) n, count(*) OVER () all_days FROM lineitem GROUP BY 1) WHERE n >= 30")
def count_over_all(t):
    days = t("lineitem").groupBy("l_shipdate").agg(F.count("*").alias("n"))
    return days.join(F.broadcast(days.agg(F.count("*").alias("all_days")))).where("n >= 30")  # one row


@query("SELECT l_returnflag, year(l_shipdate) season, round(sum(CASE WHEN year(l_shipdate) >= 1997 THEN l_tax END), 6) tax, round(sum(l_quantity), 4) quantity FROM lineitem GROUP BY 1, 2".replace("year(l_shipdate) season", "CAST(year(l_shipdate) AS INTEGER) season"))
def masked_untracked(t):
    rows = t("lineitem").withColumn("season", F.year("l_shipdate"))
    rows = rows.withColumns({"tax": masked("l_tax", "season", 1997), "quantity": masked("l_quantity", "season", None)})
    return rows.groupBy("l_returnflag", "season").agg(F.round(F.sum("tax"), 6).alias("tax"), F.round(F.sum("quantity"), 4).alias("quantity"))


@query("SELECT stat, first_season_start FROM (VALUES ('tax', 1997), ('discount', 1999), ('quantity', 1990)) v(stat, first_season_start) WHERE first_season_start > (SELECT max(year(o_orderdate)) FROM orders WHERE o_orderstatus = 'F')")
def not_tracked_scope(t):
    """Statistics that none of the seasons asked for had yet."""
    seasons = t("orders").where("o_orderstatus = 'F'").agg(F.max(F.year("o_orderdate")).alias("newest"))
    seed = seasons.select("newest", F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.lit(y).alias("first_season_start")) for s, y in (("tax", 1997), ("discount", 1999), ("quantity", 1990))))).alias("s"))
    return seed.where("s.first_season_start > newest").select("s.*")
