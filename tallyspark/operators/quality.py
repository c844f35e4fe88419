"""Checks: each is a frame of violations that must be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_unique(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def nulls(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that have nulls, and how many, in one scan."""
    entries = [F.struct(F.lit(c).alias("column"), F.count(F.when(F.col(c).isNull(), 1)).alias("n")) for c in columns]
    return rows.agg(F.array(*entries).alias("e")).select(F.explode("e").alias("e")).select("e.*").where("n > 0")


def orphans(rows: DataFrame, column: str, parents: DataFrame, parent: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(parent).alias("_parent")), F.col(column) == F.col("_parent"), "left_anti")


def unaccepted(rows: DataFrame, column: str, accepted: list) -> DataFrame:
    return rows.where(~F.col(column).isin(accepted)).groupBy(column).agg(F.count("*").alias("n"))


def sums_differ(parts: DataFrame, whole: DataFrame, keys: list[str], part: Column, stated: Column, slack: Column | float = 0.0, allowed: DataFrame | None = None) -> DataFrame:
    """Keys whose parts do not sum to the stated whole within the slack, unless they are allowed."""
    sums = parts.groupBy(*keys).agg(F.sum(part).alias("summed"))
    off = whole.withColumn("stated", stated).select(*keys, "stated").join(sums, keys).withColumn("off", F.abs(F.col("stated") - F.col("summed")))
    out = off.where(F.col("off") > (slack if isinstance(slack, Column) else F.lit(slack)))
    return out if allowed is None else out.join(allowed, keys, "left_anti")


def differs(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys at which two tables differ in any column, null being a value."""
    other = b.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.select(*keys, *columns).join(other, keys).where(differ)


def count_anomalies(got: DataFrame, expected: DataFrame, day: str, tolerance: float = 0.10) -> DataFrame:
    """Days whose count is off by more than the tolerance, or that only one side has. got and expected: day, n."""
    both = got.select(day, F.col("n").alias("got")).join(expected.select(day, F.col("n").alias("expected")), day, "full")
    off = F.abs(F.coalesce("got", F.lit(0)) - F.col("expected")) / F.nullif(F.col("expected").cast("double"), F.lit(0.0))
    return both.where(F.col("expected").isNull() | F.col("got").isNull() | (off > tolerance))


def untracked_values(rows: DataFrame, start: str, first: dict[str, int]) -> DataFrame:
    """Statistics with values before the first season in which they were tracked."""
    entries = [F.struct(F.lit(c).alias("stat"), F.count(F.when((F.col(start) < y) & F.col(c).isNotNull(), 1)).alias("n")) for c, y in first.items()]
    return rows.agg(F.array(*entries).alias("e")).select(F.explode("e").alias("e")).select("e.*").where("n > 0")


def require_empty(check: str, violations: DataFrame, shown: int = 5) -> None:
    """Raises with the first violations if there are any."""
    found = violations.limit(shown).collect()
    if found:
        raise ValueError(f"{check}: {'; '.join(str(r.asDict()) for r in found)}")
