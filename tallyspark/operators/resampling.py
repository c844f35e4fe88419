"""Intervals by resampling families, and a held-out part by strata, as aggregations whose randomness is a hash.

A replicate draws every family a number of times that follows Poisson's law with mean 1 (what drawing as many families with
replacement tends to); the number comes from a hash of family, replicate and seed, so partial sums by replicate are all that is
shuffled, and the same data give the same interval.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Poisson's law with mean 1, summed up, in parts of 2**32.
POISSON = tuple(round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(10))


def _hash(family: Column, replicate: Column, seed: int) -> Column:
    """32 bits in hexadecimal digits, which are in the order of the numbers."""
    return F.substring(F.md5(F.concat_ws(":", family.cast("string"), replicate.cast("string"), F.lit(seed).cast("string"))), 1, 8)


def _drawn(h: Column) -> Column:
    return sum((F.when(h >= format(t, "08x"), 1).otherwise(0) for t in POISSON), F.lit(0))


def draws(family: Column, replicate: Column, seed: int) -> Column:
    """How often the replicate draws the family."""
    return _drawn(_hash(family, replicate, seed))


def replicates(outcomes: DataFrame, family: str, passed: str, n: int, seed: int) -> DataFrame:
    """replicate and share, the share passed in each replicate; one that draws no family has none.

    Each family is n rows, so families are dealt into as many tasks as a shuffle has, not as few as their bytes would have. The hash is a
    column of its own, evaluated once; who is not drawn counts 0 instead of being filtered, as a filter would evaluate it again."""
    groups = outcomes.groupBy(F.col(family).alias("_f")).agg(F.count(F.when(F.col(passed), 1)).alias("_p"), F.count("*").alias("_n"))
    dealt = groups.repartition(int(outcomes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("_f"))
    each = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate")).withColumn("_h", _hash(F.col("_f"), F.col("replicate"), seed)).withColumn("_w", _drawn(F.col("_h")))
    sums = each.groupBy("replicate").agg(F.sum(F.col("_w") * F.col("_p")).alias("_p"), F.sum(F.col("_w") * F.col("_n")).alias("_n"))
    return sums.where("_n > 0").select("replicate", (F.col("_p") / F.col("_n")).alias("share"))


def _interval(values: DataFrame, value: str, level: float, n: int) -> DataFrame:
    """low and high: the values at the ends of the middle part, of n at most."""
    placed = values.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.row_number().over(Window.orderBy(value)).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))
    low, high = F.floor((1 - level) / 2 * F.col("n")), F.floor((1 + level) / 2 * F.col("n")) - 1
    return placed.agg(F.max(F.when(F.col("k") - 1 == low, F.col("v"))).alias("low"), F.max(F.when(F.col("k") - 1 == high, F.col("v"))).alias("high"))


def family_interval(outcomes: DataFrame, family: str, passed: str, n: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """low and high of the share passed, of n replicates over whole families. Null families are one family; null outcomes are not passed."""
    return _interval(replicates(outcomes, family, passed, n, seed), "share", level, n)


def difference_interval(a: DataFrame, b: DataFrame, family: str, passed: str, n: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """low and high of the difference of the shares passed; the two are resampled apart."""
    left, right = replicates(a, family, passed, n, seed), replicates(b, family, passed, n, seed + 1).withColumnRenamed("share", "other")
    return _interval(left.join(right, "replicate").select((F.col("share") - F.col("other")).alias("d")), "d", level, n)


def _held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """f, s and held_out of rows f, s, w (weight) and t (target), which come stratum by stratum in the order they are judged in."""
    stratum, held, begun = None, 0.0, False
    for batch in batches:
        out = []
        for s, w, t in zip(*(batch.column(c).to_pylist() for c in ("s", "w", "t")), strict=True):
            if not begun or (s != stratum and not (s != s and stratum != stratum)):  # what is not a number is one stratum
                stratum, held, begun = s, 0.0, True
            closer = w is not None and t is not None and abs(held + w - t) < abs(held - t)
            held += w if closer else 0.0
            out.append(closer)
        yield pa.RecordBatch.from_arrays([batch.column("f"), batch.column("s"), pa.array(out, pa.bool_())], names=["f", "s", "held_out"])


def held_out_strata(families: DataFrame, family: str, stratum: str, weight: str, salt: str, part: float = 0.30) -> DataFrame:
    """family, stratum and held_out: in each stratum, families in the order of their salted hash are held out as long as each brings
    the weight held out nearer to the part. families has one row a family; a stratum's families pass through one task, in a stream
    of which only the weight held out is kept."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(family).cast("string")), 256)
    target = (F.lit(part) * F.sum(weight).over(Window.partitionBy(stratum))).cast("double")
    rows = families.select(F.col(family).alias("f"), F.col(stratum).alias("s"), F.col(weight).cast("double").alias("w"), key.alias("h"), target.alias("t"))
    ordered = rows.repartition("s").sortWithinPartitions("s", "h", "f", "w").select("f", "s", "w", "t")
    kinds = T.StructType([T.StructField("f", rows.schema["f"].dataType), T.StructField("s", rows.schema["s"].dataType), T.StructField("held_out", T.BooleanType())])
    return ordered.mapInArrow(_held_out, kinds).select(F.col("f").alias(family), F.col("s").alias(stratum), "held_out")
