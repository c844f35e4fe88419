"""Reconciliation both ways, checks in one pass, freshness, cards and intervals over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators.cards import column_cards
from ..operators.reconcile import gap_notes, multiset_difference, reconcile
from ..operators.resampling import POISSON, difference_interval, family_interval, held_out_strata
from .base import TS, G, games, query, team_seasons

_LOGS = G + """, logs AS (SELECT DISTINCT player, season, season_type FROM g WHERE game % 5 <> 0), totals AS (SELECT DISTINCT player, season, season_type FROM g JOIN lineitem ON l_orderkey = game WHERE l_linenumber = 2),
whole AS (SELECT c_custkey player FROM customer WHERE c_custkey % 10 = 0), exact AS (SELECT DISTINCT player, season, season_type FROM g WHERE game % 13 = 0)"""


def _sides(t):
    g = games(t)
    keys = ["player", "season", "season_type"]
    logs = g.where("game % 5 <> 0").select(*keys)
    totals = g.join(t("lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("game")), "game").select(*keys)
    whole = t("customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("player"), F.lit(None).cast("int").alias("season"), F.lit(None).cast("string").alias("season_type"))
    return logs, totals, keys, whole.unionByName(g.where("game % 13 = 0").select(*keys))


@query(
    f"""WITH {_LOGS}, m AS (SELECT * FROM logs EXCEPT SELECT * FROM totals), listed AS (SELECT * FROM (SELECT * FROM logs UNION SELECT * FROM totals) WHERE player IN (SELECT player FROM whole) OR (player, season, season_type) IN (SELECT player, season, season_type FROM exact))
SELECT *, 'unexplained' kind FROM (SELECT * FROM m EXCEPT SELECT * FROM listed) UNION ALL SELECT *, 'listed_gap' FROM (SELECT * FROM m INTERSECT SELECT * FROM listed)
UNION ALL SELECT *, 'no_log' FROM (SELECT * FROM totals EXCEPT SELECT * FROM logs) UNION ALL SELECT *, 'listed_with_rows' FROM (SELECT * FROM totals INTERSECT SELECT * FROM listed)"""
)
def reconcile_seasons(t):
    """Seasons in the game log against season totals, both ways, less an allow-list."""
    logs, totals, keys, known = _sides(t)
    return reconcile(logs, totals, keys, "player", known)


@query(
    """WITH a AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT *, CAST(count(*) AS BIGINT) n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL UNION ALL SELECT *, CAST(-count(*) AS BIGINT) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL"""
)
def rows_differ(t):
    """How often rows of one half of the shots are in the other."""
    rows = t("lineitem")
    return multiset_difference(rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1"), ["l_partkey", "l_returnflag"])


@query(
    f"""WITH {_LOGS}, e AS (SELECT DISTINCT player, season, lower(season_type) kind FROM exact WHERE player % 3 <> 1) SELECT player, 'The source is missing season totals for this player for: ' || string_agg(season || ' ' || kind, ', ' ORDER BY season, kind) || '. The totals here exclude those seasons.' note FROM e GROUP BY player"""
)
def career_gap_notes(t):
    known = _sides(t)[3].where("season is not null").distinct().withColumns({"class": F.concat(F.lit("class"), F.col("player") % 3), "season": F.col("season").cast("string")})
    return gap_notes(known, "player", ["class0", "class2"])


_CHECKS = {
    "positive": "l_quantity > 0",
    "cheap": "l_discount < 0.1",
    "returned": "l_returnflag in ('R', 'N')",
    "shipped": "l_shipdate is not null",
    "line": "l_linenumber between 1 and 5",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS \"check\", CAST(count(*) FILTER (NOT coalesce({v}, false)) AS BIGINT) violations FROM lineitem" for k, v in _CHECKS.items()))
def checks_in_one_pass(t):
    """Rows of line items that violate each of several conditions, in one aggregation."""
    return C.in_one_pass(t("lineitem"), {k: F.expr(v) for k, v in _CHECKS.items()})


_DAY, _LATEST, _SEASON = "1998-08-03", "1998-08-01", 1997


def _frames(t):
    seasons = team_seasons(t).join(t("nation").select(F.col("n_nationkey").alias("team"), F.col("n_regionkey").cast("string").alias("conference")), "team")
    seasons = seasons.select("team", "season", F.lit("R").alias("season_type"), "conference", "wins", (F.col("gp") - F.col("wins")).alias("losses"), "gp")
    players = games(t).groupBy("player", "season").agg(F.avg("pts").alias("points_per_game")).withColumn("season_type", F.lit("R"))
    box = t("lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("team"))
    return games(t).select("game", "date"), box, seasons, players, t("lineitem").select(F.to_date("l_shipdate").alias("date"))


@query(
    f"""WITH {TS}, n AS (SELECT ts.*, n_regionkey FROM ts JOIN nation ON n_nationkey = team WHERE season = {_SEASON})
SELECT 'F01' id, max(date) >= DATE '{_DAY}' - INTERVAL 3 DAY ok FROM g UNION ALL SELECT 'F02', max(date) = DATE '{_LATEST}' FROM g
UNION ALL SELECT 'F03', count(*) = 0 FROM g WHERE date = DATE '{_LATEST}' AND (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = game) < 2
UNION ALL SELECT 'F04', count(*) = 30 AND count(*) FILTER (n_regionkey = 1) = 15 FROM n UNION ALL SELECT 'F05', sum(wins) = sum(gp - wins) FROM n UNION ALL SELECT 'F06', count(*) > 0 FROM g WHERE season = {_SEASON}
UNION ALL SELECT 'F07', count(*) = 0 FROM g WHERE date > DATE '{_DAY}' UNION ALL SELECT 'F08', count(*) > 0 FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '{_LATEST}'
UNION ALL SELECT 'F09', max(abs(gp - m)) <= 3 FROM n, (SELECT median(gp) m FROM n) UNION ALL SELECT 'F10', true"""
)
def freshness_cases(t):
    """What a fresh snapshot must be like, each table aggregated once."""
    manifest = {"as_of": _DAY, "latest": _LATEST, "season": _SEASON, "season_type": "R", "first_conference": "1", "registry": "1", "registry_here": "1"}
    return C.freshness(*_frames(t), manifest)


@query(
    f"""WITH {G}, r AS (SELECT game record, 'player ' || player p, player, pts, date FROM g WHERE game % 7 = 0) SELECT CAST(record AS VARCHAR) record, p player, CAST(CASE WHEN record % 3 = 0 THEN pts + 1 ELSE pts END AS VARCHAR) "value" FROM r
WHERE date - CAST(record % 2 AS INTEGER) >= DATE '1996-10-01' AND NOT EXISTS (SELECT 1 FROM g x WHERE x.player = r.player AND x.date <= r.date - CAST(record % 2 AS INTEGER) AND x.pts = CASE WHEN record % 3 = 0 THEN r.pts + 1 ELSE r.pts END)"""
)
def records_without_game(t):
    """Records that no game of the named player proves, some with another value or an earlier day."""
    g = games(t)
    name = F.concat(F.lit("player "), F.col("player"))
    value = F.when(F.col("game") % 3 == 0, F.col("pts") + 1).otherwise(F.col("pts")).cast("string")
    records = g.where("game % 7 = 0").select(F.col("game").cast("string").alias("record"), F.lit("single_game").alias("record_kind"), name.alias("player"), F.lit("pts").alias("stat"), value.alias("value"), F.date_sub("date", (F.col("game") % 2).cast("int")).alias("valid_from"))
    players = g.select(F.col("player").alias("player_id"), name.alias("name")).distinct()
    return C.records_without_game(records, players, g.select(F.col("player").alias("player_id"), F.col("date").alias("game_date"), "pts"), ["pts"])


@query("SELECT count(*) n, count(DISTINCT n_name) names FROM nation WHERE n_regionkey <> 2 HAVING count(*) <> 30 OR count(DISTINCT n_name) <> 30")
def current_teams(t):
    return C.current_teams(t("nation").select((F.col("n_regionkey") != 2).alias("is_current"), F.col("n_name").alias("full_name")))


_SCHEDULES = "sc AS (SELECT CAST(1992 + i AS INTEGER) season_start, CAST(10 * (i + 1) AS BIGINT) max_games FROM range(4) t(i))"


@query(f"WITH {TS}, {_SCHEDULES} SELECT team, season season_start, gp, coalesce(max_games, 82) max_games FROM ts LEFT JOIN sc ON season_start = season WHERE gp > coalesce(max_games, 82)")
def over_schedule(t):
    rows = team_seasons(t).select("team", F.col("season").alias("season_start"), "gp", F.lit("R").alias("season_type"))
    schedule = t("orders").select(F.year("o_orderdate").alias("season_start")).distinct().where("season_start < 1996").withColumn("max_games", F.col("season_start").cast("bigint") * 10 - 19910)
    return C.over_schedule(rows, schedule, "R")


@query(
    f"""WITH {TS}, src AS (SELECT team, season, gp + team % 3 gp, wins + CASE WHEN (team + season) % 4 = 0 THEN team % 3 + (season % 2) ELSE 0 END wins, gp - wins losses FROM ts), known AS (SELECT team, season, CAST(1 AS BIGINT) miss FROM ts WHERE team % 2 = 1)
SELECT ts.team, ts.season season_start, ts.wins, ts.gp - ts.wins losses, src.wins source_wins, src.losses source_losses FROM ts JOIN src ON src.team = ts.team AND src.season = ts.season LEFT JOIN known k ON k.team = ts.team AND k.season = ts.season
WHERE (ts.wins <> src.wins OR ts.gp - ts.wins <> src.losses) AND NOT (miss IS NOT NULL AND src.gp - ts.gp = miss)"""
)
def team_records_off(t):
    rows = team_seasons(t).select("team", F.col("season").alias("season_start"), "gp", "wins", (F.col("gp") - F.col("wins")).alias("losses"), F.lit("R").alias("season_type"))
    more = F.when((F.col("team") + F.col("season_start")) % 4 == 0, F.col("team") % 3 + F.col("season_start") % 2).otherwise(0)
    source = rows.select("team", "season_start", (F.col("gp") + F.col("team") % 3).alias("gp"), (F.col("wins") + more).alias("wins"), "losses")
    known = rows.where("team % 2 = 1").select("team", "season_start", F.lit(1).cast("bigint").alias("games_missing"))
    return C.team_records_off(rows, source, known, "R")


def _card_sql(table: str, columns: dict[str, str]) -> str:
    each = [
        f"SELECT '{c}' AS \"column\", '{kind}' AS type, (SELECT string_agg(left(CAST(x AS VARCHAR), 40), ', ' ORDER BY x) FROM (SELECT DISTINCT {c} x FROM {table} WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 3)) examples"
        for c, kind in columns.items()
    ]
    return " UNION ALL ".join(each)


_ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string"}
_ITEMS = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_quantity": "double", "l_returnflag": "string", "l_discount": "double"}
_CARDS = f"WITH c AS (SELECT 'orders' AS \"view\", * FROM ({_card_sql('orders', _ORDERS)}) UNION ALL SELECT 'lineitem', * FROM ({_card_sql('lineitem', _ITEMS)}))"


@query(
    _CARDS
    + """ SELECT "view", "column", 'Column ' || "column" || ' (' || type || ') of view ' || "view" || '.' || CASE WHEN "column" = 'o_totalprice' THEN ' Points of a game.' ELSE '' END || ' Examples: ' || examples card FROM c
UNION ALL SELECT "view", NULL, 'View ' || "view" || ' (' || count(*) || ' columns): ' || CASE "view" WHEN 'orders' THEN 'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority' ELSE 'l_orderkey, l_partkey, l_quantity, l_returnflag, l_discount' END FROM c GROUP BY "view" """
)
def schema_cards(t):
    """Cards of two tables, their least distinct values found in one scan each."""
    orders = column_cards(t("orders").select(*_ORDERS), "orders", {"o_totalprice": "Points of a game."}).withColumn("view", F.lit("orders"))
    items = column_cards(t("lineitem").select(*_ITEMS), "lineitem").withColumn("view", F.lit("lineitem"))
    return orders.unionByName(items).select("view", "column", "card")


def _shares(rows: str, seed: int, name: str, n: int) -> str:
    h = f"CAST('0x' || substr(md5(f || ':' || r || ':{seed}'), 1, 8) AS BIGINT)"
    w = " + ".join(f"CAST(h >= {x} AS INTEGER)" for x in POISSON)
    return f"""{name} AS (SELECT r, sum(w * p) / sum(w * n) share FROM (SELECT r, p, n, {w} w FROM (SELECT *, {h} h FROM (SELECT f, count(*) FILTER (ok) p, count(*) n FROM {rows} GROUP BY f), range({n}) t(r))) WHERE w > 0 GROUP BY r)"""


_ENDS = "SELECT max(v) FILTER (k - 1 = floor((1 - 0.95) / 2 * n)) low, max(v) FILTER (k - 1 = floor((1 + 0.95) / 2 * n) - 1) high FROM (SELECT v, row_number() OVER (ORDER BY v) k, count(*) OVER () n FROM x)"
_OUT = "o AS (SELECT o_custkey f, o_orderpriority IN ('1-URGENT', '2-HIGH') ok, o_orderstatus s FROM orders)"


def _outcomes(t, status=None):
    rows = t("orders").select(F.col("o_custkey").alias("f"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("ok"), F.col("o_orderstatus").alias("s"))
    return rows if status is None else rows.where(F.col("s") == status)


@query(f"WITH {_OUT}, {_shares('o', 3, 'b', 400)}, x AS (SELECT share v FROM b) SELECT round(low, 9) low, round(high, 9) high FROM ({_ENDS})")
def family_interval_of_shares(t):
    """The share of high priorities, with whole customers resampled."""
    return family_interval(_outcomes(t), "f", "ok", 400, 3).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(
    f"WITH {_OUT}, {_shares("(SELECT * FROM o WHERE s = 'F')", 0, 'b', 300)}, {_shares("(SELECT * FROM o WHERE s = 'O')", 1, 'c', 300)}, x AS (SELECT b.share - c.share v FROM b JOIN c USING (r)) SELECT round(low, 9) low, round(high, 9) high FROM ({_ENDS})"
)
def difference_interval_of_shares(t):
    return difference_interval(_outcomes(t, "F"), _outcomes(t, "O"), "f", "ok", 300).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(
    """WITH f AS (SELECT c_custkey, c_mktsegment, CAST(count(o_orderkey) + 1 AS DOUBLE) w FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT c_mktsegment, list([c_custkey, w] ORDER BY sha256('salt:' || c_custkey)) fs, 0.3 * sum(w) target FROM f GROUP BY 1),
h AS (SELECT c_mktsegment, fs, list_reduce(list_prepend([-1.0, 0.0], fs), lambda a, x: CASE WHEN abs(a[2] + x[2] - target) < abs(a[2] - target) THEN list_append(list_concat([a[1], a[2] + x[2]], a[3:]), x[1]) ELSE list_concat([a[1], a[2]], a[3:]) END) taken FROM s)
SELECT CAST(x[1] AS BIGINT) c_custkey, c_mktsegment, list_contains(taken[3:], x[1]) held_out FROM (SELECT c_mktsegment, taken, unnest(fs) x FROM h)"""
)
def held_out_families(t):
    """Customers held out by segment, weighed by their orders, to 30 % as near as whole families allow."""
    weights = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_mktsegment").agg((F.count("o_orderkey") + 1).cast("double").alias("w"))
    return held_out_strata(weights, "c_custkey", "c_mktsegment", "w", "salt")
