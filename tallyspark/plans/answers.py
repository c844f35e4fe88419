"""Drafts of answers made from the games, and their numbers held against the results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import numbers_in
from ..operators.results import Rounding, shown
from ..operators.shaping import joined_text
from ..operators.verifier import check, numbers_match, problems
from .base import query

#: A season of a player in exact whole numbers: games, cents in all, urgent games; and what drafts state.
_PS = """ps AS (SELECT o_custkey player, CAST(year(o_orderdate) AS INTEGER) season, count(*) gp, CAST(sum(round(o_totalprice * 100)) AS BIGINT) cents, count(*) FILTER (o_orderpriority = '1-URGENT') urgent FROM orders GROUP BY ALL),
s AS (SELECT *, player || '-' || season AS "key", (2 * cents + gp) // (2 * gp) hundredths, (2 * cents + 10 * gp) // (20 * gp) tenths, (2000 * urgent + gp) // (2 * gp) mills, (cents + 50) // 100 whole FROM ps)"""


def _seasons(t):
    rows = t("orders").groupBy(F.col("o_custkey").alias("player"), F.year("o_orderdate").alias("season")).agg(
        F.count("*").alias("gp"), F.sum(F.round(F.col("o_totalprice") * 100)).cast("bigint").alias("cents"), F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("urgent")
    )
    return rows.withColumns(
        {
            "key": F.concat_ws("-", "player", "season"),
            "hundredths": F.expr("(2 * cents + gp) div (2 * gp)"),
            "tenths": F.expr("(2 * cents + 10 * gp) div (20 * gp)"),
            "mills": F.expr("(2000 * urgent + gp) div (2 * gp)"),
            "whole": F.expr("(cents + 50) div 100"),
        }
    )


def _values(rows):
    """What a season's results are: name, value, how it is shown and with how many decimals."""
    per_game = (F.col("cents") / 100) / F.col("gp")
    ways = [("points_per_game", per_game, "number", 1), ("points", F.col("cents") / 100, "number", 0), ("gp", F.col("gp").cast("double"), "number", 0), ("urgent_pct", F.col("urgent") / F.col("gp"), "percent", 1)]
    each = F.array(*(F.struct(F.lit(c).alias("column"), v.alias("value"), F.lit(d).alias("display"), F.lit(k).alias("decimals")) for c, v, d, k in ways))
    return rows.select("key", F.inline(each))


def _point(number, digits: int):
    """A whole number with its last digits after a point."""
    return F.concat((F.col(number) / 10**digits).cast("bigint").cast("string"), F.lit("."), F.lpad((F.col(number) % 10**digits).cast("string"), digits, "0"))


_STATED = r"""x AS (SELECT "key", unnest([printf('%d.%02d', hundredths // 100, hundredths % 100), printf('%d.%d', tenths // 10, tenths % 10), CAST(whole AS VARCHAR), format('{:,}', whole), printf('%d.%d', mills // 10, mills % 10) || '%', printf('%d.%03d', mills // 1000, mills % 1000), (mills // 10) || '%', CAST(gp + player % 3 AS VARCHAR)]) AS "text" FROM s),
y AS (SELECT DISTINCT "key", "text", CAST(replace(rtrim("text", '%'), ',', '') AS DECIMAL(30, 4)) AS "value", len(regexp_extract("text", '\.([0-9]+)', 1)) decimals FROM x),
e AS (SELECT "key", (cents / 100.0) / gp v, 1 d FROM s UNION ALL SELECT "key", cents / 100.0, 0 FROM s UNION ALL SELECT "key", gp, 0 FROM s UNION ALL SELECT "key", 100 * (urgent / gp), 1 FROM s UNION ALL SELECT "key", urgent / gp, 3 FROM s),
n AS (SELECT "key", d, CASE d WHEN 0 THEN CAST(CAST(CAST(v AS VARCHAR) AS DECIMAL(30, 0)) AS DECIMAL(30, 4)) WHEN 1 THEN CAST(CAST(CAST(v AS VARCHAR) AS DECIMAL(30, 1)) AS DECIMAL(30, 4)) ELSE CAST(CAST(CAST(v AS VARCHAR) AS DECIMAL(30, 3)) AS DECIMAL(30, 4)) END r FROM e)"""


@query(f"""WITH {_PS}, {_STATED} SELECT "key", "text", EXISTS (SELECT 1 FROM n WHERE n."key" = y."key" AND n.r = y."value" AND y.decimals <= n.d) matched FROM y""", "numbers_match")
def stated_numbers(t):
    """Every way in which a season's numbers were stated, and whether one of its results may be stated so."""
    rows = _seasons(t)
    texts = F.array(
        _point("hundredths", 2), _point("tenths", 1), F.col("whole").cast("string"), F.format_number("whole", 0), F.concat(_point("mills", 1), F.lit("%")), _point("mills", 3), F.concat(F.expr("mills div 10").cast("string"), F.lit("%")), (F.col("gp") + F.col("player") % 3).cast("string")
    )
    stated = rows.select("key", F.explode(F.array_distinct(texts)).alias("text"))
    read = stated.select("key", "text", numbers_in("text").getItem(0).alias("n")).select("key", "text", "n.value", "n.decimals")
    return numbers_match(read, _values(rows), "key", ["key", "text"])


#: Phrases and the results that they can mean.
NAMES = (("points per game", "points_per_game"), ("points", "points"), ("points", "points_per_game"), ("games", "gp"), ("urgent", "urgent_pct"), ("assists", "assists"), ("assists per game", "assists_per_game"))
_NAMES = ", ".join(f"('{p}', '{c}')" for p, c in NAMES)
#: Drafts of one season, by the remainder of the player's number: right ones, a wrong number, a wrong name before and after it, a word for a quantity, a wrong season.
_DRAFTS = (
    ("In ", "season", ", player ", "player", " scored ", "points", " points in ", "gp", " games, ", "tenths", " points per game."),
    ("Player ", "player", ": ", "wrong", " points per game in ", "season"),
    ("Player ", "player", " had ", "tenths", " assists per game (", "gp", " games)."),
    ("Points per game: ", "tenths", "; urgent: ", "percent", "; assists: ", "points", "!"),
    ("Dozens of games, ", "gp", " games to be exact, and ", "percent", " urgent"),
    ("In ", "next", " player ", "player", " had ", "hundredths", " points per game, ", "percent", " of them urgent"),
)
#: What stands for each of them, in DuckDB's SQL and in Spark's.
_PIECE = {
    "season": ("printf('%d-%02d', season, (season + 1) % 100)",) * 2,
    "next": ("printf('%d-%02d', season + 1, (season + 2) % 100)",) * 2,
    "player": ("CAST(player AS VARCHAR)", "cast(player as string)"),
    "points": ("format('{:,}', whole)", "format_number(whole, 0)"),
    "gp": ("CAST(gp AS VARCHAR)", "cast(gp as string)"),
    "tenths": ("printf('%d.%d', tenths // 10, tenths % 10)", "printf('%d.%d', tenths div 10, tenths % 10)"),
    "wrong": ("printf('%d.%d', (tenths + 3) // 10, (tenths + 3) % 10)", "printf('%d.%d', (tenths + 3) div 10, (tenths + 3) % 10)"),
    "hundredths": ("printf('%d.%02d', hundredths // 100, hundredths % 100)", "printf('%d.%02d', hundredths div 100, hundredths % 100)"),
    "percent": ("printf('%d.%d', mills // 10, mills % 10) || '%'", "printf('%d.%d', mills div 10, mills % 10) || '%'"),
}


def _draft(dialect: int) -> str:
    texts = [" || ".join(_PIECE[x][dialect] if x in _PIECE else f"'{x}'" for x in parts) for parts in _DRAFTS]
    return "CASE player % 6 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(texts)) + " END"


_NUMBER = r"(?:([A-Za-z][A-Za-z %''-]{0,40}): *)?([0-9]{4}-[0-9]{2}|[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(\.[0-9]+)?(%?)([^0-9,.;:!?()]*)"
_FOUND = rf"""d AS (SELECT *, {_draft(0)} draft FROM s),
p AS (SELECT "key", player, season, i, regexp_extract(piece, '{_NUMBER}', ['b', 'w', 'f', 'c', 'a']) g FROM (SELECT *, unnest(regexp_extract_all(draft, '{_NUMBER}')) piece, generate_subscripts(regexp_extract_all(draft, '{_NUMBER}'), 1) i FROM d)),
q AS (SELECT "key", player, season, i, g.w || g.f || g.c AS "text", contains(g.w, '-') token, CASE WHEN contains(g.w, '-') THEN NULL ELSE CAST(replace(g.w, ',', '') || g.f AS DECIMAL(30, 4)) END AS "value", greatest(len(g.f) - 1, 0) decimals, regexp_extract_all(g.a, '[A-Za-z%]+')[:5] after, regexp_extract_all(g.b, '[A-Za-z%]+')[:6] before FROM p),
e AS (SELECT "key", 'points_per_game' c, (cents / 100.0) / gp v, 1 d FROM s UNION ALL SELECT "key", 'points', cents / 100.0, 0 FROM s UNION ALL SELECT "key", 'gp', gp, 0 FROM s UNION ALL SELECT "key", 'urgent_pct', 100 * (urgent / gp), 1 FROM s UNION ALL SELECT "key", 'urgent_pct', urgent / gp, 3 FROM s),
n AS (SELECT "key", c, d, CASE d WHEN 0 THEN CAST(CAST(CAST(v AS VARCHAR) AS DECIMAL(30, 0)) AS DECIMAL(30, 4)) WHEN 1 THEN CAST(CAST(CAST(v AS VARCHAR) AS DECIMAL(30, 1)) AS DECIMAL(30, 4)) ELSE CAST(CAST(CAST(v AS VARCHAR) AS DECIMAL(30, 3)) AS DECIMAL(30, 4)) END r FROM e),
h AS (SELECT q."key", q.i, list(DISTINCT c) cols FROM q JOIN n ON n."key" = q."key" AND r = q."value" AND decimals <= d GROUP BY ALL),
names AS (SELECT p, list(c) means FROM (VALUES {_NAMES}) v(p, c) GROUP BY p),
spans AS (SELECT "key", i, side, k, n, array_to_string(w[k:k + n - 1], ' ') raw FROM (SELECT "key", i, 'after' side, after w FROM q UNION ALL SELECT "key", i, 'before', before FROM q), (SELECT unnest(range(1, 7)) k), (SELECT unnest(range(1, 4)) n) WHERE k + n - 1 <= len(w)),
labels AS (SELECT "key", i, side, arg_min(raw, 10 * k - n) raw, arg_min(means, 10 * k - n) means FROM spans JOIN names ON p = lower(raw) GROUP BY ALL),
judged AS (SELECT q.*, cols, a.raw ar, a.means am, b.raw br, b.means bm FROM q LEFT JOIN h ON h."key" = q."key" AND h.i = q.i LEFT JOIN labels a ON a."key" = q."key" AND a.i = q.i AND a.side = 'after' LEFT JOIN labels b ON b."key" = q."key" AND b.i = q.i AND b.side = 'before')
SELECT "key", 'unmatched' kind, "text" what FROM judged WHERE cols IS NULL AND NOT CASE WHEN token THEN "text" = printf('%d-%02d', season, (season + 1) % 100) ELSE "value" = player END
UNION ALL SELECT "key", 'mislabelled', CASE WHEN ar IS NOT NULL THEN "text" || ' ' || ar ELSE br || ': ' || "text" END FROM judged WHERE cols IS NOT NULL AND CASE WHEN ar IS NOT NULL THEN NOT list_has_any(am, cols) WHEN br IS NOT NULL THEN NOT list_has_any(bm, cols) ELSE FALSE END
UNION ALL SELECT "key", 'unmatched', 'Dozens' FROM d WHERE player % 6 = 4"""


def _checked(t):
    rows = _seasons(t)
    drafts = rows.select("key", F.expr(_draft(1)).alias("draft"))
    literals = rows.select("key", F.explode(F.array(F.expr(_PIECE["season"][1]), F.concat(F.lit("player "), F.col("player")))).alias("text"))
    names = rows.sparkSession.createDataFrame(NAMES, "phrase string, column string")
    return check(drafts, _values(rows), literals, names)


@query(f"WITH {_PS}, {_FOUND}")
def verify_drafts(t):
    """The numbers of every season's draft that its results don't support, or support under another name."""
    return problems(_checked(t))


@query(f"""WITH {_PS}, bad AS (SELECT "key", count(*) n FROM (WITH {_FOUND}) GROUP BY "key") SELECT s."key", bad.n IS NULL ok FROM s LEFT JOIN bad ON bad."key" = s."key" """)
def drafts_verified(t):
    """Whether each draft may be shown."""
    return _checked(t).select("key", "ok")


@query(f"""WITH {_PS} SELECT "key", CAST(gp AS VARCHAR) gp, format('{{:,}}', CAST(CAST(CAST(cents / 100.0 AS VARCHAR) AS DECIMAL(30, 0)) AS BIGINT)) points, CAST(CAST(CAST((cents / 100.0) / gp AS VARCHAR) AS DECIMAL(30, 1)) AS VARCHAR) points_per_game, CAST(CAST(CAST(100 * (urgent / gp) AS VARCHAR) AS DECIMAL(30, 1)) AS VARCHAR) || '%' urgent_pct,
  CASE WHEN cents >= 10000 THEN format('{{:,}}', cents) ELSE CAST(cents AS VARCHAR) END cents, CASE WHEN urgent > 0 THEN 'yes' ELSE 'no' END any_urgent, CASE WHEN player % 2 = 0 THEN 'n/a' ELSE CAST(season AS VARCHAR) END season FROM s""")
def cells_shown(t):
    """A season's results as they are shown."""
    rows = _seasons(t).select(
        "key", "gp", F.lit(1).alias("team_gp"), (F.col("cents") / 100).alias("points"), ((F.col("cents") / 100) / F.col("gp")).alias("points_per_game"), (F.col("urgent") / F.col("gp")).alias("urgent_pct"), "cents", (F.col("urgent") > 0).alias("any_urgent"),
        F.when(F.col("player") % 2 != 0, F.col("season")).alias("season"),
    )
    return shown(rows, {"points": Rounding(0), "points_per_game": Rounding(1), "urgent_pct": Rounding(1, percent=True)})


@query("""SELECT o_custkey player, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderdate DESC, o_orderkey) FILTER (o_orderstatus <> 'P') games FROM orders GROUP BY 1""")
def games_listed(t):
    """Each player's games from the newest, but those of a kind."""
    order = [-F.unix_date(F.to_date("o_orderdate")), F.col("o_orderkey")]
    return t("orders").groupBy(F.col("o_custkey").alias("player")).agg(joined_text(F.col("o_orderkey"), order, where=F.col("o_orderstatus") != "P").alias("games"))
