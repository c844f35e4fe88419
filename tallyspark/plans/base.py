"""The register of queries, and the frames that several of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (t), where t reads a table by name, under its own name, with its DuckDB SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name or f.__name__, f.__doc__
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return f

    return register


def games(t) -> DataFrame:
    """Orders as a game log: game, player, season, season_type, date, pts, urgent."""
    return t("orders").select(
        F.col("o_orderkey").alias("game"), F.col("o_custkey").alias("player"), F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("season_type"),
        F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("pts"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
    )


def player_seasons(t) -> DataFrame:
    """player, season, season_type, gp, pts, urgent."""
    return games(t).groupBy("player", "season", "season_type").agg(F.count("*").alias("gp"), F.sum("pts").alias("pts"), F.sum("urgent").alias("urgent"))


def teams_of(t) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("player"), F.col("c_nationkey").alias("team"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))


def team_seasons(t) -> DataFrame:
    """team, season, gp (games of its busiest player-season), pts, wins (urgent games)."""
    return games(t).join(teams_of(t), "player").groupBy("team", "season").agg(F.count("*").alias("gp"), F.sum("pts").alias("pts"), F.sum("urgent").alias("wins"))


#: The same frames in DuckDB's SQL.
G = "g AS (SELECT o_orderkey game, o_custkey player, CAST(year(o_orderdate) AS INTEGER) season, o_orderstatus season_type, CAST(o_orderdate AS DATE) date, o_totalprice pts, CAST(o_orderpriority = '1-URGENT' AS INTEGER) urgent FROM orders)"
PS = G + ", ps AS (SELECT player, season, season_type, count(*) gp, sum(pts) pts, CAST(sum(urgent) AS BIGINT) urgent FROM g GROUP BY ALL)"
TS = G + ", ts AS (SELECT c_nationkey team, season, count(*) gp, sum(pts) pts, CAST(sum(urgent) AS BIGINT) wins FROM g JOIN customer ON c_custkey = player GROUP BY ALL)"
