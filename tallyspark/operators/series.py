"""Series of an entity: first and last n, requested order, trends, streaks, eras, shares, pooled ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge_n(rows: DataFrame, entity: list[str], order: list[str], n: int, last: bool = False) -> DataFrame:
    """The first (or last) n rows of each entity."""
    w = Window.partitionBy(*entity).orderBy(*((F.col(c).desc() if last else F.col(c).asc()) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def in_requested_order(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of the ids, with their position in the request."""
    wanted = F.posexplode(F.array(*(F.lit(i) for i in ids))).alias("position", "_wanted")
    listed = rows.sparkSession.range(1).select(wanted)
    return rows.join(F.broadcast(listed), rows[key] == F.col("_wanted")).drop("_wanted")


def change(rows: DataFrame, entity: list[str], order: str, value: str) -> DataFrame:
    """value's difference from the entity's row before (delta; null for the first)."""
    w = Window.partitionBy(*entity).orderBy(order)
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(w))


def streaks(rows: DataFrame, entity: list[str], order: list[str], holds: Column) -> DataFrame:
    """Runs of consecutive rows for which the condition holds: entity, first, last (by the first order column) and length."""
    w = Window.partitionBy(*entity).orderBy(*order)
    broken = F.sum(F.when(holds, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("_run", broken).where(holds)
    return runs.groupBy(*entity, "_run").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length")).drop("_run")


def longest(runs: DataFrame, entity: list[str]) -> DataFrame:
    """Each entity's longest run; of equal ones the earliest."""
    w = Window.partitionBy(*entity).orderBy(F.col("length").desc(), F.col("first"))
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def eras(rows: DataFrame, entity: list[str], step: str, state: list[str]) -> DataFrame:
    """Runs of consecutive steps with the same state: entity, state, first_step, last_step."""
    w = Window.partitionBy(*entity, *state).orderBy(step)
    islands = rows.select(*entity, *state, step).distinct().withColumn("_island", F.col(step) - F.row_number().over(w))
    return islands.groupBy(*entity, *state, "_island").agg(F.min(step).alias("first_step"), F.max(step).alias("last_step")).drop("_island")


def share_of_total(rows: DataFrame, group: list[str], value: Column, within: list[str] | None = None) -> DataFrame:
    """Sums of value by group, and each one's share of the whole (or of its part). Totals are aggregated, not windowed."""
    sums = rows.groupBy(*group).agg(F.sum(value).alias("value"))
    if within:
        return sums.join(sums.groupBy(*within).agg(F.sum("value").alias("_all")), within).withColumn("share", F.col("value") / F.nullif("_all", F.lit(0))).drop("_all")
    return sums.join(F.broadcast(sums.agg(F.sum("value").alias("_all")))).withColumn("share", F.col("value") / F.nullif("_all", F.lit(0))).drop("_all")  # one row


def pooled_ratio(rows: DataFrame, group: list[str], above: str, below: str) -> DataFrame:
    """The ratio of sums, not the mean of ratios."""
    return rows.groupBy(*group).agg((F.sum(above).cast("double") / F.nullif(F.sum(below).cast("double"), F.lit(0.0))).alias("ratio"))
