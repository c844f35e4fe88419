"""Sharding by extendible hashing.

Every row has a hash; the directory starts with one bucket, and only buckets whose bytes exceed the limit are split on one
more leading bit. The tree of byte sums is built from one aggregation by a prefix long enough for the data's size; should a
few prefixes still exceed the limit, those alone are aggregated again with more bits. Rows meet the directory by an equi-join
on the prefix, so no bucket is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: Leading bits from the key, and further bits from the row, used only where rows with equal keys exceed the limit together.
KEY_BITS, ROW_BITS = 31, 31
_BITS = KEY_BITS + ROW_BITS
_STEP = 8
ADDED = ("bytes", "shard", "depth", "shard_bytes")


def key_bits(key: str | Column) -> Column:
    """The leading 31 bits of the MD5 of a key's text; null counts as empty."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.coalesce(key.cast("string"), F.lit("")).cast("binary")
    return F.shiftright(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), 1)


def _hash(key: str, spread: Column) -> Column:
    row = F.xxhash64(F.col(key).cast("string"), spread).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return F.shiftleft(key_bits(key), ROW_BITS).bitwiseOR(row)


def _prefix(bits: Column, depth: Column | int) -> Column:
    return F.expr(f"shiftright(_h, {_BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftright", bits, (F.lit(_BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """The buckets of rows (_h, bytes): depth, prefix (its leading bits as a number) and shard_bytes. Together they hold every
    row; none exceeds the limit and none could be joined with its sibling within it."""
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    deep = min(_BITS, max(4, (max(int(total), 1) // limit).bit_length() + 4))
    top, cells, found = 0, rows, None
    while True:
        own = cells.groupBy(_prefix(F.col("_h"), deep).alias("cell")).agg(F.sum("bytes").alias("b"))
        sums = own.select(F.explode(F.sequence(F.lit(top), F.lit(deep))).alias("depth"), "cell", "b")
        sums = sums.groupBy("depth", F.call_function("shiftright", F.col("cell"), F.lit(deep) - F.col("depth")).alias("prefix")).agg(F.sum("b").alias("shard_bytes"))
        sums = written(sums, "sums")
        above = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_p"), F.col("shard_bytes").alias("_above"))
        below = sums.withColumn("_p", F.shiftright("prefix", 1)).join(above, ["depth", "_p"], "left").drop("_p")
        whole = F.col("_above").isNull() & (F.lit(top) == 0) & (F.col("depth") == 0)
        last = F.col("depth") == (_BITS if deep == _BITS else -1)
        leaves = below.where((whole | (F.col("_above") > limit)) & ((F.col("shard_bytes") <= limit) | last)).drop("_above")
        found = leaves if found is None else found.unionByName(leaves)
        if deep == _BITS:
            return found
        heavy = sums.where((F.col("depth") == deep) & (F.col("shard_bytes") > limit)).select(F.col("prefix").alias("_cell"))
        if heavy.isEmpty():
            return found
        cells = rows.join(heavy, _prefix(F.col("_h"), deep) == F.col("_cell"), "left_semi")
        top, deep = deep, min(_BITS, deep + _STEP)


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 128_000_000) -> DataFrame:
    """Every row of docs (without the text) with bytes (of its UTF-8 text), shard (the leading bits of its bucket, as text of
    0 and 1; empty if one bucket holds all), depth and shard_bytes.

    No shard exceeds the limit, but for a row that exceeds it alone: it has a shard of its own, named "row-" and its hash, so
    that it splits no bucket. Rows with equal keys share a shard unless they exceed the limit together; bits of the row
    itself then part them. Null texts have no bytes; null keys count as one key; an empty table has no shards; columns of
    docs whose names clash with an added column are replaced.
    """
    base = docs.drop(*[c for c in docs.columns if c.lower() in (*ADDED, "_h")])
    rows = base.select(*(c for c in base.columns if c != text), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), _hash(key, F.monotonically_increasing_id()).alias("_h"))
    rows = written(rows, "rows")
    heavy = F.col("bytes") > limit
    fits = rows.where(~heavy)
    found = written(directory(fits.select("_h", "bytes"), limit), "directory")
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    found = found.select("depth", "prefix", "shard_bytes", name.alias("shard"))
    keep = [c for c in rows.columns if c != "_h"]
    placed = None
    # the depths are few (at most the hash's bits); each is an equi-join on prefixes of that length
    depths = sorted(r[0] for r in found.select("depth").distinct().collect())
    if depths:
        entry = F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(F.col("_h"), d).alias("prefix")) for d in depths))
        keyed = fits.select(*keep, F.explode(entry).alias("_e")) if len(depths) > 1 else fits.select(*keep, entry[0].alias("_e"))
        placed = keyed.select(*keep, F.col("_e.depth").alias("depth"), F.col("_e.prefix").alias("prefix")).join(found, ["depth", "prefix"]).select(*keep, "shard", "depth", "shard_bytes")
    alone = rows.where(heavy).select(*keep, F.concat(F.lit("row-"), F.hex("_h")).alias("shard"), F.lit(_BITS).alias("depth"), F.col("bytes").alias("shard_bytes"))
    return alone if placed is None else placed.unionByName(alone)


def write_shards(docs: DataFrame, shards: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes docs to one folder a shard. Each shard is within the limit and so is one task's work; keys must be unique."""
    named = docs.join(shards.select(key, F.col("shard").alias("_shard")), key)
    named.repartition("_shard").withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(path)
