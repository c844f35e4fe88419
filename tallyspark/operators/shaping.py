"""From landed rows to marts: newest fetch, duplicates, totals, pairing, roles, eras, cutoffs, gates, aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_per(rows: DataFrame, keys: list[str], fetched: str, tie: list[Column] = ()) -> DataFrame:
    """The newest fetch of each key. fetched is compared as text where it is text."""
    return first_by(rows, keys, [F.col(fetched).desc(), *tie])


def latest_batch_per(rows: DataFrame, keys: list[str], fetched: str) -> DataFrame:
    """All rows of the newest response of each request; the rest of a key's responses go. An aggregation and a join rather than
    a window, so that a request with many rows has partial maxima."""
    newest = rows.groupBy(*keys).agg(F.max(fetched).alias("_newest"))
    return rows.join(newest, keys).where(F.col(fetched) == F.col("_newest")).drop("_newest")


def total_or_single(rows: DataFrame, keys: list[str], is_total: str) -> DataFrame:
    """The stated total of each key; where there is none, its row if it is the only one. Parts are never summed."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    totals = F.count(F.when(F.col(is_total), 1)).over(w)
    return rows.withColumns({"_n": n, "_t": totals}).where(F.col(is_total) | ((F.col("_t") == 0) & (F.col("_n") == 1))).drop("_n", "_t")


def pair_rows(rows: DataFrame, key: str, side: str, home: str, columns: list[str]) -> DataFrame:
    """One row for each key with two: home_ and away_ columns. Where not exactly one of the two is home, the game is neutral
    and the lower side stands as home."""
    keep = F.struct(*columns)
    order = F.struct(F.col("_rank"), F.col(side))
    pair = rows.withColumn("_rank", F.when(F.col(home), 0).otherwise(1)).groupBy(key).agg(
        F.count("*").alias("_n"), F.count(F.when(F.col(home), 1)).alias("_homes"), F.min_by(keep, order).alias("_h"), F.max_by(keep, order).alias("_a"), F.min_by(keep, F.col(side)).alias("_l"), F.max_by(keep, F.col(side)).alias("_g"),
    )
    neutral = F.col("_homes") != 1
    out = [F.when(neutral, F.col(f"_l.{c}")).otherwise(F.col(f"_h.{c}")).alias(f"home_{c}") for c in columns] + [F.when(neutral, F.col(f"_g.{c}")).otherwise(F.col(f"_a.{c}")).alias(f"away_{c}") for c in columns]
    return pair.where("_n = 2").select(key, *out, neutral.alias("is_neutral"))


def by_role(games: DataFrame, shared: list[str], roles: dict[str, dict[str, str]]) -> DataFrame:
    """A row for each role of each game (home and away as team and opponent), from one scan."""
    entries = [F.struct(F.lit(role).alias("role"), *(F.col(c).alias(name) for name, c in columns.items())) for role, columns in roles.items()]
    return games.select(*shared, F.explode(F.array(*entries)).alias("_r")).select(*shared, "_r.*")


def unordered_pairs(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Joins on a pair of columns in either order, as an equi-join on the least and the greatest."""
    x = left.withColumns({"_lo": F.least(*a), "_hi": F.greatest(*a)})
    y = right.withColumns({"_lo": F.least(*b), "_hi": F.greatest(*b)})
    return x.join(y, ["_lo", "_hi"]).drop("_lo", "_hi")


def era_join(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, first: str, last: str) -> DataFrame:
    """Each row with the span of its key that holds it: an equi-join with a condition on the rest."""
    return rows.join(spans, [rows[k] == spans[k] for k in keys] + [rows[at].between(spans[first], spans[last])]).select(rows["*"], *(spans[c] for c in spans.columns if c not in keys))


def group_status(rows: DataFrame, group: list[str], date: str, as_of: Column) -> DataFrame:
    """For each group its first and last date, rows, whether all of it is up to the cutoff, and whether the cutoff falls inside."""
    out = rows.groupBy(*group).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n"))
    return out.withColumns({"included": F.col("last_date") <= as_of, "straddles": (F.col("first_date") <= as_of) & (F.col("last_date") > as_of)})


def gated(rows: DataFrame, status: DataFrame, group: list[str]) -> DataFrame:
    """The rows of the groups that are included."""
    return rows.join(status.where("included").select(*group), group, "left_semi")


def top_ranked(rows: DataFrame, stats: dict[str, str], n: int, keep: list[str]) -> DataFrame:
    """For each named statistic the rows ranked n or better by it, ties kept, from one scan: (record, value, keep)."""
    entries = F.explode(F.array(*(F.struct(F.lit(name).alias("record"), F.col(c).cast("double").alias("value")) for name, c in stats.items())))
    long = rows.select(*keep, entries.alias("_e")).select("_e.record", "_e.value", *keep).where("value is not null")
    w = Window.partitionBy("record").orderBy(F.col("value").desc())
    return long.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= n)


def with_precedence(sources: list[DataFrame], keys: list[str], tie: list[Column]) -> DataFrame:
    """The union of alias sources, the earlier one winning for a key that several have."""
    union = reduce(DataFrame.unionByName, [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)])
    return first_by(union, keys, [F.col("_p"), *tie]).drop("_p")


def joined_text(value: Column, order: list[Column], separator: str = ", ", where: Column | None = None) -> Column:
    """An aggregate: the texts of a group that are not null (and pass where), in their order, joined; null where there is none. A group's texts become one cell, so
    this is for groups that a reader can read."""
    keep = value.isNotNull() if where is None else value.isNotNull() & where
    row = F.when(keep, F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), value.cast("string").alias("v")))
    listed = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["v"])
    return F.when(F.size(listed) > 0, F.array_join(listed, separator))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Statistics that availability may name.
MOST_STATS = 10_000


def first_seasons(availability: DataFrame) -> dict[str, int]:
    """The small table of first tracked seasons as a dictionary; nulls are left out. More than MOST_STATS rows are an error, not a part."""
    found = availability.where("first_season_start is not null").select("stat", "first_season_start").limit(MOST_STATS + 1).collect()
    if len(found) > MOST_STATS:
        raise ValueError(f"availability names more than {MOST_STATS} statistics")
    return {r[0]: r[1] for r in found}
