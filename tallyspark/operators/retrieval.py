"""Ranking of texts and vectors, and folds over conversations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("_w", lambda w: w == term))


def bm25(docs: DataFrame, key: str, text: str, question: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """key and score of the documents that share a term with the question. Documents are read once for the terms asked for;
    only their counts are shuffled."""
    asked = sorted(set(re.findall("[a-z0-9]+", question.lower())))
    # only words that are asked for become cells; the others are counted
    whole_word = rf"(?<![a-z0-9])(?:{'|'.join(asked)})(?![a-z0-9])" if asked else "(?!)"
    plain = F.lower(text)
    rows = docs.select(key, F.regexp_extract_all(plain, F.lit(whole_word), F.lit(0)).alias("_w"), F.regexp_count(plain, F.lit("[a-z0-9]+")).alias("_n_words"))
    counts = [_occurrences(term).alias("_tf") for term in asked]
    rows = rows.select(key, F.col("_n_words").alias("_len"), F.array(*(F.struct(F.lit(t).alias("term"), c) for t, c in zip(asked, counts, strict=True))).alias("_t"))
    frequencies = [F.count_if(F.col("_t")[i]["_tf"] > 0).cast("double").alias(f"f{i}") for i in range(len(asked))]
    whole = rows.agg(F.count("*").cast("double").alias("_n"), F.avg("_len").alias("_mean"), *frequencies)
    rows = rows.join(F.broadcast(whole))  # one row of counts
    score = F.lit(0.0)
    for i in range(len(asked)):
        f, tf = F.col(f"f{i}"), F.col("_t")[i]["_tf"]
        score = score + F.log(1 + (F.col("_n") - f + 0.5) / (f + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_mean")))
    return rows.withColumn("score", score).where("score > 0").select(key, "score")


def nearest(vectors: DataFrame, key: str, vector: str, probe: list[float], n: int) -> DataFrame:
    """The n vectors nearest to the probe (Euclidean distance, rounded to 6 places; ties by key)."""
    target = F.array(*(F.lit(x) for x in probe))
    square = F.aggregate(F.zip_with(vector, target, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda x, y: x + y)
    return vectors.withColumn("distance", F.round(F.sqrt(square), 6)).orderBy("distance", key).limit(n)


def reciprocal_rank(lists: list[DataFrame], key: str, order: str, n: int, k: int = 60) -> DataFrame:
    """Fuses short ranked lists: the sum of 1 / (k + rank), ranks from 1; ties by key."""
    ranked = [x.select(key, (F.row_number().over(Window.orderBy(order, key))).alias("_r")) for x in lists]
    union = reduce(DataFrame.unionByName, ranked)
    return union.groupBy(key).agg(F.sum(1.0 / (k + F.col("_r"))).alias("score")).orderBy(F.desc("score"), key).limit(n)


def carried(rows: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """Nulls filled with the last value before them in their group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))
