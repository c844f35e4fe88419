"""Checks as queries: each gives the violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from .base import G, games, query


@query("SELECT l_orderkey, l_linenumber, count(*) n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def constraint_unique(t):
    return Q.not_unique(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) n FROM lineitem GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def constraint_unique_combination(t):
    return Q.not_unique(t("lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query("SELECT 'c_acctbal' AS \"column\", count(*) n FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL HAVING count(*) > 0")
def constraint_not_null(t):
    rows = t("customer").withColumn("c_acctbal", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")))
    return Q.nulls(rows, ["c_custkey", "c_acctbal"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def constraint_relationship(t):
    return Q.orphans(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", t("customer").where("c_acctbal > 0"), "c_custkey")


@query("SELECT o_orderpriority, count(*) n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def constraint_accepted(t):
    return Q.unaccepted(t("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


_SUMS = "WITH s AS (SELECT l_orderkey k, round(sum(l_extendedprice * (1 - l_discount)), 4) summed FROM lineitem GROUP BY 1), w AS (SELECT o_orderkey k, o_totalprice stated FROM orders), o AS (SELECT k, stated, summed, abs(stated - summed) off FROM s JOIN w USING (k))"


def _sums(t, slack, allowed=None):
    parts = t("lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    whole = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"))
    out = Q.sums_differ(parts, whole, ["k"], F.col("x"), F.col("x"), slack, allowed)
    return out.select("k", "stated", F.round("summed", 4).alias("summed"))


@query(_SUMS + " SELECT k, stated, summed FROM o WHERE off > 1000 AND k % 10 <> 3")
def domain_sum_reconcile(t):
    """With an allow-list of known gaps."""
    return _sums(t, 1000.0, t("orders").where("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("k")))


@query(_SUMS + " SELECT k, stated, summed FROM o WHERE off > greatest(1000.0, 0.5 * stated)")
def domain_tolerance(t):
    return _sums(t, F.greatest(F.lit(1000.0), 0.5 * F.col("stated")))


@query(f"WITH {G}, a AS (SELECT player, season, count(*) n, CAST(sum(urgent) AS BIGINT) u FROM g GROUP BY 1, 2), b AS (SELECT player, season, count(*) n, nullif(CAST(sum(urgent) AS BIGINT), 1) u FROM g GROUP BY 1, 2) SELECT player, season, a.n n, a.u u, b.n _n, b.u _u FROM a JOIN b USING (player, season) WHERE a.n IS DISTINCT FROM b.n OR a.u IS DISTINCT FROM b.u")
def careers_match(t):
    """Null-safe comparison of two sources, column by column."""
    a = games(t).groupBy("player", "season").agg(F.count("*").alias("n"), F.sum("urgent").alias("u"))
    b = a.withColumn("u", F.nullif("u", F.lit(1)))
    return Q.differs(a, b, ["player", "season"], ["n", "u"])


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) "day", count(*) FILTER (event_type <> 'purchase' OR user_id % 3 > 0) got, count(*) expected FROM events GROUP BY 1)
SELECT "day", nullif(got, 0) got, expected FROM d WHERE got = 0 OR abs(got - expected) / expected > 0.1"""
)
def game_count_anomaly(t):
    rows = t("events").withColumn("day", F.to_date("ts"))
    got = rows.where("event_type <> 'purchase' or user_id % 3 > 0").groupBy("day").agg(F.count("*").alias("n"))
    return Q.count_anomalies(got, rows.groupBy("day").agg(F.count("*").alias("n")), "day")


@query("SELECT * FROM (SELECT 'l_tax' stat, count(*) n FROM lineitem WHERE year(l_shipdate) < 1996 UNION ALL SELECT 'l_discount', count(*) FROM lineitem WHERE year(l_shipdate) < 1990) WHERE n > 0")
def untracked_is_null(t):
    return Q.untracked_values(t("lineitem").withColumn("season", F.year("l_shipdate")), "season", {"l_tax": 1996, "l_discount": 1990})
