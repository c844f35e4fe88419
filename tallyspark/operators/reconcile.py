"""Two tables held against each other in both directions, in one aggregation of signed counts, less what is known to be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The sentences of a note about missing seasons.
_NOTE = ("The source is missing season totals for this player for: ", ". The totals here exclude those seasons.")


def multiset_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """columns and n: how many more of such a row a has than b (negative: b has more); rows that both have equally often are left out.
    Nulls equal nulls. One aggregation with partial sums, no join."""
    sides = [side.select(*columns).withColumn("_n", F.lit(sign).cast("bigint")) for side, sign in ((a, 1), (b, -1))]
    return sides[0].unionByName(sides[1]).groupBy(*columns).agg(F.sum("_n").alias("n")).where("n <> 0")


def reconcile(logs: DataFrame, totals: DataFrame, keys: list[str], owner: str, known: DataFrame) -> DataFrame:
    """keys and kind for every key that the two tables don't share, or that is listed though it is there:
    'unexplained' and 'listed_gap' (in logs only), 'no_log' (in totals only), 'listed_with_rows' (listed, but in totals).

    known: keys; a row lists its key, or every key of its owner if all other keys are null. Null keys are keys of their own."""
    rows = [side.select(*keys).withColumns({"_log": F.lit(log), "_total": F.lit(1 - log)}) for side, log in ((logs, 1), (totals, 0))]
    seen = rows[0].unionByName(rows[1]).groupBy(*keys).agg(F.max("_log").alias("log"), F.max("_total").alias("total"))
    others = [k for k in keys if k != owner]
    bare = F.lit(True)
    for k in others:
        bare = bare & F.col(k).isNull()
    whole = known.where(bare).select(F.col(owner).alias("_owner")).distinct().withColumn("_whole", F.lit(True))
    exact = known.where(~bare).select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct().withColumn("_exact", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    found = seen.join(whole, F.col(owner) == F.col("_owner"), "left").join(exact, same, "left")
    listed = F.col("_whole").isNotNull() | F.col("_exact").isNotNull()
    missing = F.col("total") == 0
    kinds = F.array(F.when(missing & ~listed, "unexplained"), F.when(missing & listed, "listed_gap"), F.when(F.col("log") == 0, "no_log"), F.when(~missing & listed, "listed_with_rows"))
    return found.select(*keys, F.explode(F.array_compact(kinds)).alias("kind"))


def gap_notes(gaps: DataFrame, player: str, partial_classes: list[str]) -> DataFrame:
    """player and note, for players whose listed gaps (player, class, season, season_type) are single seasons of a partial class, in order."""
    part = gaps.where(F.col("class").isin(partial_classes) & F.col("season").isNotNull() & (F.col("season") != ""))
    each = part.select(player, F.struct("season", F.lower(F.coalesce("season_type", F.lit(""))).alias("kind")).alias("g"))
    listed = F.transform(F.array_sort(F.collect_list("g")), lambda g: F.concat_ws(" ", g["season"], g["kind"]))
    return each.groupBy(player).agg(F.concat(F.lit(_NOTE[0]), F.array_join(listed, ", "), F.lit(_NOTE[1])).alias("note"))
