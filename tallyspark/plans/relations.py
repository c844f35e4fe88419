"""Joins, shaping, set operations and marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.casts import alias_norm, blank_to_null, periods, season_of_id, season_type, to_int, to_num
from ..operators import shaping as S
from ..operators.series import eras
from .base import G, games, query, teams_of


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1")
def latest_per(t):
    return S.latest_per(t("events"), ["user_id", "event_type"], "ts", [F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, user_id, CAST(ts AS DATE) fetched FROM events QUALIFY CAST(ts AS DATE) = max(CAST(ts AS DATE)) OVER (PARTITION BY user_id)")
def latest_batch_per(t):
    """All rows of a user's last day: a response may have several rows, and all of the newest stay."""
    rows = t("events").select("event_id", "user_id", F.to_date("ts").alias("fetched"))
    return S.latest_batch_per(rows, ["user_id"], "fetched").select("event_id", "user_id", "fetched")


@query(
    "SELECT \"day\", user_id, event_id, value FROM (SELECT *, CAST(ts AS DATE) \"day\" FROM events) QUALIFY row_number() OVER (PARTITION BY \"day\", user_id ORDER BY (event_type = 'purchase') DESC NULLS LAST, value DESC NULLS LAST, event_id) = 1"
)
def dup_resolution(t):
    """One row of several by an ordered list of criteria, the first a condition."""
    rows = t("events").withColumn("day", F.to_date("ts"))
    order = [F.expr("event_type = 'purchase'").desc_nulls_last(), F.col("value").desc_nulls_last(), F.col("event_id")]
    return S.first_by(rows, ["day", "user_id"], order).select("day", "user_id", "event_id", "value")


_PARTS = f"WITH {G}, p AS (SELECT player, season, season_type AS part, round(sum(pts), 4) pts, count(*) gp FROM g GROUP BY 1, 2, 3), tot AS (SELECT player, season, 'TOT' part, round(sum(pts), 4) pts, CAST(sum(gp) AS BIGINT) gp FROM p GROUP BY 1, 2 HAVING count(*) > 1)"


def _parts(t):
    parts = games(t).groupBy("player", "season", F.col("season_type").alias("part")).agg(F.round(F.sum("pts"), 4).alias("pts"), F.count("*").alias("gp"))
    totals = parts.groupBy("player", "season").agg(F.count("*").alias("n"), F.round(F.sum("pts"), 4).alias("pts"), F.sum("gp").alias("gp")).where("n > 1")
    return parts, totals.select("player", "season", F.lit("TOT").alias("part"), "pts", "gp")


@query(_PARTS + ", u AS (SELECT * FROM p UNION ALL BY NAME SELECT * FROM tot) SELECT player, season, part, pts, gp FROM u QUALIFY part = 'TOT' OR count(*) OVER (PARTITION BY player, season) = 1")
def total_row_preference(t):
    parts, totals = _parts(t)
    rows = S.union_by_name([parts, totals]).withColumn("is_total", F.col("part") == "TOT")
    return S.total_or_single(rows, ["player", "season"], "is_total").drop("is_total")


@query(
    f"WITH {G}, r AS (SELECT player, c_nationkey home, season, season_type, date, game, min(date) OVER (PARTITION BY player, season, season_type) first_date FROM g JOIN customer ON c_custkey = player) SELECT player, season, season_type last_type, game FROM r QUALIFY row_number() OVER (PARTITION BY player, season ORDER BY date DESC, (season_type = 'F') DESC, first_date DESC, game DESC) = 1"
)
def last_team_tiebreak(t):
    """Four criteria in turn, so that the order is total."""
    rows = games(t).join(teams_of(t), "player")
    first = rows.groupBy("player", "season", "season_type").agg(F.min("date").alias("first_date"))
    rows = rows.join(first, ["player", "season", "season_type"])
    out = S.first_by(rows, ["player", "season"], [F.col("date").desc(), (F.col("season_type") == "F").desc(), F.col("first_date").desc(), F.col("game").desc()])
    return out.select("player", "season", F.col("season_type").alias("last_type"), "game")


_SIDES = "WITH s AS (SELECT l_orderkey game, l_suppkey side, any_value(l_returnflag = 'N') FILTER (true) home, CAST(sum(l_quantity) AS BIGINT) pts FROM (SELECT l_orderkey, l_suppkey, min(l_returnflag) l_returnflag, sum(l_quantity) l_quantity FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2), two AS (SELECT game FROM s GROUP BY 1 HAVING count(*) = 2), h AS (SELECT game, count(*) FILTER (home) homes FROM s SEMI JOIN two USING (game) GROUP BY 1), o AS (SELECT s.*, homes, row_number() OVER (PARTITION BY game ORDER BY CASE WHEN homes = 1 AND home THEN 0 WHEN homes = 1 THEN 1 ELSE 0 END, side) k FROM s JOIN h USING (game))"


def _sides(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("side")).agg((F.min("l_returnflag") == "N").alias("home"), F.sum("l_quantity").cast("long").alias("pts"))


def _paired(t):
    return S.pair_rows(_sides(t), "game", "side", "home", ["side", "pts"])


@query(_SIDES + " SELECT game, a.side home_side, a.pts home_pts, b.side away_side, b.pts away_pts, a.homes <> 1 is_neutral, CASE WHEN a.pts > b.pts THEN a.side ELSE b.side END winner, abs(a.pts - b.pts) margin FROM o a JOIN o b USING (game) WHERE a.k = 1 AND b.k = 2")
def pair_games(t):
    return _paired(t).withColumns({"winner": F.when(F.col("home_pts") > F.col("away_pts"), F.col("home_side")).otherwise(F.col("away_side")), "margin": F.abs(F.col("home_pts") - F.col("away_pts"))}).select(
        "game", "home_side", "home_pts", "away_side", "away_pts", "is_neutral", "winner", "margin"
    )


@query(
    _SIDES + ", p AS (SELECT game, a.side hs, a.pts hp, b.side as_, b.pts ap, a.homes <> 1 neutral FROM o a JOIN o b USING (game) WHERE a.k = 1 AND b.k = 2), r AS (SELECT hs side, hp pts, ap opp, 'home' role, neutral FROM p UNION ALL SELECT as_, ap, hp, 'road', neutral FROM p)"
    " SELECT side, count(*) gp, count(*) FILTER (pts > opp) wins, count(*) FILTER (role = 'home' AND NOT neutral) home_games, count(*) FILTER (role = 'road' AND NOT neutral) road_games, count(*) FILTER (neutral) neutral_games, CAST(sum(pts) AS BIGINT) pts, CAST(sum(opp) AS BIGINT) opp_pts FROM r GROUP BY 1",
    "neutral_split",
)
def team_record(t):
    """Home, road and neutral games of each side, from one scan of the games."""
    rows = S.by_role(_paired(t), ["is_neutral"], {"home": {"side": "home_side", "pts": "home_pts", "opp": "away_pts"}, "road": {"side": "away_side", "pts": "away_pts", "opp": "home_pts"}})
    settled = ~F.col("is_neutral")
    return rows.groupBy("side").agg(
        F.count("*").alias("gp"), F.count_if(F.col("pts") > F.col("opp")).alias("wins"), F.count_if((F.col("role") == "home") & settled).alias("home_games"), F.count_if((F.col("role") == "road") & settled).alias("road_games"),
        F.count_if("is_neutral").alias("neutral_games"), F.sum("pts").alias("pts"), F.sum("opp").alias("opp_pts"),
    )


@query("WITH a AS (SELECT l_partkey % 25 x, l_suppkey % 25 y, count(*) n FROM lineitem GROUP BY 1, 2), b AS (SELECT n_nationkey x, (n_nationkey + 7) % 25 y, n_name FROM nation) SELECT n_name, CAST(sum(n) AS BIGINT) n FROM a JOIN b ON least(a.x, a.y) = least(b.x, b.y) AND greatest(a.x, a.y) = greatest(b.x, b.y) GROUP BY 1")
def unordered_pair_join(t):
    a = t("lineitem").groupBy((F.col("l_partkey") % 25).alias("x"), (F.col("l_suppkey") % 25).alias("y")).agg(F.count("*").alias("n"))
    b = t("nation").select(F.col("n_nationkey").cast("long").alias("p"), ((F.col("n_nationkey") + 7) % 25).cast("long").alias("q"), "n_name")
    return S.unordered_pairs(a, b, ("x", "y"), ("p", "q")).groupBy("n_name").agg(F.sum("n").alias("n"))


_ERAS = f"{G}, y AS (SELECT player, season, max(urgent) flag FROM g GROUP BY 1, 2), i AS (SELECT *, season - row_number() OVER (PARTITION BY player, flag ORDER BY season) k FROM y), e AS (SELECT player, flag, min(season) first_step, max(season) last_step FROM i GROUP BY player, flag, k)"


@query(f"WITH {_ERAS} SELECT game, g.player, flag, first_step, last_step FROM g JOIN e ON g.player = e.player AND season BETWEEN first_step AND last_step")
def era_join(t):
    log = games(t)
    spans = eras(log.groupBy("player", "season").agg(F.max("urgent").alias("flag")), ["player"], "season", ["flag"])
    return S.era_join(log, spans, ["player"], "season", "first_step", "last_step").select("game", "player", "flag", "first_step", "last_step")


@query(f"WITH {G} SELECT season, season_type, min(date) first_date, max(date) last_date, count(*) n, max(date) <= DATE '1998-06-30' included, min(date) <= DATE '1998-06-30' AND max(date) > DATE '1998-06-30' straddles FROM g GROUP BY 1, 2")
def season_type_status(t):
    return S.group_status(games(t), ["season", "season_type"], "date", F.lit("1998-06-30").cast("date"))


@query(f"WITH {G}, s AS (SELECT season, season_type FROM g GROUP BY 1, 2 HAVING max(date) <= DATE '1998-06-30') SELECT season, season_type, round(sum(pts), 4) pts FROM g SEMI JOIN s USING (season, season_type) GROUP BY 1, 2")
def as_of_filter(t):
    status = S.group_status(games(t), ["season", "season_type"], "date", F.lit("1998-06-30").cast("date"))
    return S.gated(games(t), status, ["season", "season_type"]).groupBy("season", "season_type").agg(F.round(F.sum("pts"), 4).alias("pts"))


@query(f"WITH {G}, s AS (SELECT season, bool_or(season_type = 'F' AND date <= DATE '1998-06-30') early, bool_and(date <= DATE '1998-06-30') done FROM g GROUP BY 1) SELECT game, player, season FROM g JOIN s USING (season) WHERE urgent = 1 AND pts > 300000 AND CASE WHEN season_type = 'F' THEN early ELSE done END")
def award_gating(t):
    """In-season awards count once the regular part is on, all others when the season is over."""
    cut = F.lit("1998-06-30").cast("date")
    known = games(t).groupBy("season").agg(F.bool_or((F.col("season_type") == "F") & (F.col("date") <= cut)).alias("early"), F.bool_and(F.col("date") <= cut).alias("done"))
    rows = games(t).where("urgent = 1 and pts > 300000").join(F.broadcast(known), "season")  # one row a year
    return rows.where(F.when(F.col("season_type") == "F", F.col("early")).otherwise(F.col("done"))).select("game", "player", "season")


@query(f"WITH {G}, w AS (SELECT season, c_nationkey team, sum(pts) p FROM g JOIN customer ON c_custkey = player GROUP BY 1, 2), best AS (SELECT season, max_by(team, p) team FROM w GROUP BY 1) SELECT DISTINCT player, season FROM g JOIN customer ON c_custkey = player JOIN best USING (season) WHERE team = c_nationkey", "player_titles")
def titles(t):
    rows = games(t).join(teams_of(t), "player")
    best = rows.groupBy("season", "team").agg(F.sum("pts").alias("p")).groupBy("season").agg(F.max_by("team", "p").alias("team"))
    return rows.join(best, ["season", "team"], "left_semi").select("player", "season").distinct()


@query("WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, unnest([{'record': 'price', 'value': l_extendedprice}, {'record': 'quantity', 'value': l_quantity * 1000 + l_linenumber}]) e FROM lineitem) SELECT e.record, e.value, l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(rank() OVER (PARTITION BY e.record ORDER BY e.value DESC) AS INTEGER) rank FROM l QUALIFY rank <= 10")
def records_topk(t):
    rows = t("lineitem").withColumn("q", F.col("l_quantity") * 1000 + F.col("l_linenumber"))
    return S.top_ranked(rows, {"price": "l_extendedprice", "quantity": "q"}, 10, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query(
    "WITH a AS (SELECT trim(regexp_replace(lower(p_name), '[.'']', '', 'g')) alias, p_partkey id, 1 p FROM part UNION SELECT lower(split_part(p_name, ' ', 1)), p_partkey, 2 FROM part UNION SELECT lower(s_name), s_suppkey, 3 FROM supplier) SELECT alias, id FROM a QUALIFY row_number() OVER (PARTITION BY alias ORDER BY p, id) = 1"
)
def alias_union_precedence(t):
    whole = t("part").select(alias_norm("p_name").alias("alias"), F.col("p_partkey").alias("id"))
    short = t("part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("alias"), F.col("p_partkey").alias("id"))
    other = t("supplier").select(F.lower("s_name").alias("alias"), F.col("s_suppkey").alias("id"))
    return S.with_precedence([whole, short, other], ["alias"], [F.col("id")])


@query("SELECT n_name AS name, n_regionkey AS region, CAST(NULL AS DOUBLE) balance FROM nation UNION ALL BY NAME SELECT s_name AS name, s_acctbal AS balance FROM supplier")
def set_union_by_name(t):
    a = t("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = t("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return S.union_by_name([a, b])


@query("SELECT c_nationkey k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_except(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT c_nationkey k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_intersect(t):
    return t("customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").where("s_acctbal < 0").select("s_nationkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(t):
    return t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(t):
    return t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT l_partkey, l_suppkey, count(*) n FROM lineitem WHERE (l_partkey % 50, l_suppkey % 20) NOT IN (SELECT p_size, p_partkey % 20 FROM part) GROUP BY 1, 2")
def not_in_tuple_rewrite(t):
    """A tuple NOT IN as an anti-join on hashed keys; written as NOT IN it would compare all rows with all."""
    seen = t("part").select(F.col("p_size").cast("long").alias("a"), (F.col("p_partkey") % 20).alias("b")).distinct()
    rows = t("lineitem").join(seen, ((F.col("l_partkey") % 50) == F.col("a")) & ((F.col("l_suppkey") % 20) == F.col("b")), "left_anti")
    return rows.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) k FROM events", "json_flatten")
def json_fields(t):
    return t("events").select("event_id", to_int(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) s, min(CAST(json_extract_string(props, '$.k') AS INTEGER)) lo, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) hi FROM events GROUP BY 1")
def json_aggregate(t):
    return t("events").withColumn("k", F.from_json("props", "k int")["k"]).groupBy("event_type").agg(F.sum("k").alias("s"), F.min("k").alias("lo"), F.max("k").alias("hi"))


@query(
    "SELECT o_orderkey, CASE CAST(o_orderkey % 5 AS INTEGER) WHEN 0 THEN 'Regular Season' WHEN 1 THEN 'Playoffs' WHEN 2 THEN 'PlayIn' WHEN 3 THEN 'Cup Final' END kind, CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') label, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS INTEGER) END n FROM orders"
)
def code_derivation(t):
    """Typed values and codes from text columns: kinds of season from an id's prefix, labels, numbers that may be absent."""
    prefix = F.element_at(F.array(*(F.lit(x) for x in ("002", "004", "005", "006", "001"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    number = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" ")).otherwise((F.col("o_orderkey") % 100).cast("string"))
    return t("orders").select("o_orderkey", season_type(F.concat(prefix, F.lit("0001"))).alias("kind"), season_of_id(F.concat(F.lit("2"), F.year("o_orderdate").cast("string"))).alias("label"), to_int(blank_to_null(number)).alias("n"))


@query("SELECT l_linenumber, CAST(sum(CASE WHEN m >= 240 THEN 4 + CAST(round((m - 240) / 25) AS INTEGER) END) AS BIGINT) p, round(sum(x), 4) x FROM (SELECT l_linenumber, CAST(l_quantity AS INTEGER) * 8 m, l_quantity x FROM lineitem) GROUP BY 1")
def overtime_periods(t):
    rows = t("lineitem").select("l_linenumber", (F.col("l_quantity").cast("int") * 8).alias("m"), to_num(F.col("l_quantity").cast("string")).alias("x"))
    return rows.groupBy("l_linenumber").agg(F.sum(periods("m")).alias("p"), F.round(F.sum("x"), 4).alias("x"))


@query("SELECT r_name, l_returnflag, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) revenue, count(DISTINCT c_custkey) customers, round(median(l_quantity), 2) mid FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def star_join(t):
    dims = t("customer").join(F.broadcast(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    facts = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return facts.join(dims, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name", "l_returnflag").agg(
        F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"), F.count_distinct("c_custkey").alias("customers"), F.round(F.median("l_quantity"), 2).alias("mid")
    )


@query("SELECT o_orderstatus, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1996), 4) AS y1996, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1997), 4) AS y1997 FROM orders GROUP BY 1")
def pivot_years(t):
    rows = t("orders").select("o_orderstatus", F.concat(F.lit("y"), F.year("o_orderdate").cast("string")).alias("y"), "o_totalprice")
    return rows.groupBy("o_orderstatus").pivot("y", ["y1996", "y1997"]).agg(F.round(F.sum("o_totalprice"), 4))


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) best FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def scalar_subqueries(t):
    customers, best = t("customer"), t("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))
    mean = F.broadcast(customers.agg(F.avg("c_acctbal").alias("mean")))  # one row
    return customers.join(mean).where("c_acctbal > mean").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "best")
