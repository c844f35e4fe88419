"""A change feed of leaderboards: two chained levels of transformWithState.

Lines (nation, item, day, cents) arrive in a stream, no day in more than one of its batches and days in order. The first level is
keyed by nation and a bucket of items: a shard keeps the running revenue of its items and sends, for each day, what changed in
its own top ten (with the revenue of an item that leaves it, too). The second is keyed by nation: it keeps the shards' boards,
which hold every item that can be on the nation's, and so ranks exactly. A nation with a third of all lines is dealt over its shards,
and an item with a third of them is summed by day in each task of the batch job before the stream, so that the executors keep Python workers
of one kind while it runs.

Every start opens a store for each partition and level, and Spark 4.1 closes a store without its native statistics (465 KB each, measured),
which stay until the executor ends. What else takes memory is therefore kept low: the batch job's tasks sort ROWS lines at most, unless one key has more.

A shard's revenues are a list of runs, each a batch's sums sorted by item and packed; a batch writes one run and RUNS of them are
merged into one, so a batch writes what is new, not all that is known. A board is found from the items that a batch touches and
the best ten of the others, whose revenue does not change meanwhile.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .store import shared_dir, spread, written

TOP = 10
#: Runs of a shard's state that are merged into one.
RUNS = 16
#: Sums that a task keeps before it sends them on.
HELD = 200_000
#: Lines for each partition of the joins.
ROWS = 250_000
#: Shards of a nation, by the number of items: one for each ITEMS of them, within bounds that keep the second level's state bounded.
ITEMS, LEAST_SHARDS, MOST_SHARDS = 20_000, 8, 256
LINES = "nation_id int, item_id bigint, day bigint, cents bigint"
FEED = "nation_id int, arrival_day bigint, item_id bigint, change string, old_rank int, new_rank int, revenue bigint"
_SHARD = "nation_id int, bucket int, day bigint, item_id bigint, cents bigint, listed boolean"


def _packed(items: np.ndarray, cents: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate([np.diff(items, prepend=0), cents]).astype("<i8").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<i8")
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _summed(items: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct items in order, and the sum of each."""
    found, at = np.unique(items, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, cents)
    return found, total


def best(items: np.ndarray, cents: np.ndarray) -> np.ndarray:
    """Indices of the ten highest positive revenues in order, ties to the smaller item."""
    at = np.flatnonzero(cents > 0)
    if len(at) > 4 * TOP:
        at = at[cents[at] >= np.partition(cents[at], len(at) - TOP)[len(at) - TOP]]
    return at[np.lexsort((items[at], -cents[at]))][:TOP]


def shard_changes(items: np.ndarray, cents: np.ndarray, days: np.ndarray, moved: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
    """(day, item, revenue, listed) for what changes in the top ten of a shard: items and cents are its revenues before, and on
    days (sorted) the item moved gets value more. Rows of a day may repeat an item."""
    touched = np.unique(moved)
    rest = ~np.isin(items, touched, assume_unique=True)
    top = best(items[rest], cents[rest])
    known, at = np.concatenate([touched, items[rest][top]]), np.searchsorted(touched, moved)
    now = np.zeros(len(known), np.int64)
    now[len(touched) :] = cents[rest][top]
    if len(items):
        of = np.minimum(np.searchsorted(items, touched), len(items) - 1)
        now[: len(touched)] = np.where(items[of] == touched, cents[of], 0)
    board = {int(known[k]): int(now[k]) for k in best(known, now)}
    ends = np.flatnonzero(np.append(days[1:] != days[:-1], True)) + 1
    begin = 0
    for end in ends.tolist():
        np.add.at(now, at[begin:end], value[begin:end])
        day, before, places = int(days[begin]), board, best(known, now)
        board = {int(known[k]): int(now[k]) for k in places}
        for item, revenue in board.items():
            if before.get(item) != revenue:
                yield day, item, revenue, True
        for item in before.keys() - board.keys():
            yield day, item, int(now[np.flatnonzero(known == item)[0]]), False
        begin = end


class Shard(StatefulProcessor):
    """Running revenues of a nation's bucket of items; sends changes of its top ten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "n int", "run binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = [r[["day", "item_id", "cents"]].to_numpy(np.int64) for r in rows]
        lines = np.concatenate(got)
        lines = lines[np.argsort(lines[:, 0], kind="stable")]
        runs = [_unpacked(v[0]) for _, v in sorted(self.runs.iterator(), key=lambda x: x[0][0])] if self.runs.exists() else []
        items, cents = _summed(*map(np.concatenate, zip(*runs, strict=True))) if runs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        new = _summed(lines[:, 1], lines[:, 2])
        if len(runs) >= RUNS:
            new = _summed(np.concatenate([items, new[0]]), np.concatenate([cents, new[1]]))
            self.runs.clear()
            runs = []
        self.runs.updateValue((len(runs),), (_packed(*new),))
        out = list(shard_changes(items, cents, lines[:, 0], lines[:, 1], lines[:, 2]))
        if out:
            found = pd.DataFrame(out, columns=["day", "item_id", "cents", "listed"])
            found.insert(0, "nation_id", np.int32(key[0]))
            found.insert(1, "bucket", np.int32(key[1]))
            yield found

    def close(self) -> None:
        pass


def board_changes(held: dict[int, int], changes: list[tuple[int, int, int, bool]]) -> Iterator[tuple[int, int, str, int | None, int | None, int]]:
    """(day, item, change, old rank, new rank, revenue) for what changes in the top ten of held ({item: revenue}, which is brought
    up to date) after each day's changes (day, item, revenue, listed), sorted by day."""

    def ranks() -> dict[int, int]:
        items, cents = np.fromiter(held.keys(), np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held))
        return {int(items[k]): place for place, k in enumerate(best(items, cents), 1)}

    old, k = ranks(), 0
    while k < len(changes):
        day, gone = changes[k][0], {}
        while k < len(changes) and changes[k][0] == day:
            _, item, revenue, listed = changes[k]
            if listed:
                held[item] = revenue
            else:
                held.pop(item, None)
                gone[item] = revenue
            k += 1
        new = ranks()
        for item in sorted(old.keys() | new.keys()):
            was, now = old.get(item), new.get(item)
            if was != now:
                yield day, item, "enter" if was is None else "exit" if now is None else "move", was, now, held[item] if item in held else gone[item]
        old = new


class Board(StatefulProcessor):
    """A nation's board, from the boards of its shards."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shards = handle.getValueState("shards", "boards binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changes = sorted(x for r in rows for x in zip(r["day"].tolist(), r["item_id"].tolist(), r["cents"].tolist(), r["listed"].tolist(), strict=True))
        held = dict(zip(*(x.tolist() for x in _unpacked(self.shards.get()[0])), strict=True)) if self.shards.exists() else {}
        out = list(board_changes(held, changes))
        items = np.array(sorted(held), np.int64)
        self.shards.update((_packed(items, np.array([held[i] for i in items.tolist()], np.int64)),))
        if out:
            found = pd.DataFrame(out, columns=["arrival_day", "item_id", "change", "old_rank", "new_rank", "revenue"])
            found = found.astype({"old_rank": "Int32", "new_rank": "Int32"})
            found.insert(0, "nation_id", np.int32(key[0]))
            yield found

    def close(self) -> None:
        pass


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of cents by all other columns over what a task has read, HELD of them at most at once."""

    def sums(parts: list) -> pa.Table:
        names = parts[0].schema.names
        keys = [x for x in names if x != "cents"]
        found = pa.Table.from_batches(parts).group_by(keys).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"]).select(names)
        return pa.Table.from_arrays(found.columns, schema=parts[0].schema)  # a sum may be null to Arrow, and would not go together with batches whose cents may not

    kept: list[pa.RecordBatch] = []
    for b in batches:
        kept.append(b)
        if sum(x.num_rows for x in kept) > HELD:
            kept = sums(kept).to_batches()
            if sum(x.num_rows for x in kept) > HELD // 2:
                yield from kept
                kept = []
    if kept:
        yield from sums(kept).to_batches()


def combined(lines: DataFrame) -> DataFrame:
    """The lines with cents summed, in each task, over those that are equal in all other columns; nothing is shuffled."""
    return lines.mapInArrow(_combined, lines.schema)


def changes(lines: DataFrame, shards: int) -> DataFrame:
    """The change feed of a stream of LINES (as FEED), without the lines' nulls; no day may come in two batches, nor after a later one.
    Where an item has very many lines, let them be combined() before."""
    bucket = F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int")
    known = lines.select("nation_id", "item_id", "day", "cents").where("nation_id is not null and item_id is not null")
    dealt = known.withColumn("bucket", bucket).groupBy("nation_id", "bucket")
    local = dealt.transformWithStateInPandas(Shard(), _SHARD, "Append", "None")
    return local.groupBy("nation_id").transformWithStateInPandas(Board(), FEED, "Append", "None")


@contextmanager
def settings(spark: SparkSession, **values: str):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores holds 4 MB of disk
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else the stores of every start stay open in the executors
}


def feed(batches: DataFrame, shards: int, late: Callable[[int], Column | None] = lambda b: None) -> DataFrame:
    """FEED rows of a table of LINES with a column batch (and whatever late asks for). For each batch, in order, its lines are
    appended to the folder that the stream reads, and the streaming query is started anew on one checkpoint, takes what is new
    there and ends. Folders are new at every call. late: by batch, the condition of lines to leave out."""
    spark = batches.sparkSession
    home = f"{shared_dir(spark).rstrip('/')}/tallyspark/leaderboard-{uuid.uuid4().hex}"
    kept = batches.drop("batch").schema
    found = 0
    with settings(spark, **_STATE):
        for (b,) in batches.select("batch").distinct().orderBy("batch").collect():
            batches.where(F.col("batch") == b).drop("batch").write.mode("append").parquet(f"{home}/lines")
            lines, left_out = spark.readStream.schema(kept).parquet(f"{home}/lines"), late(b)
            fresh = lines if left_out is None else lines.where(~F.coalesce(left_out, F.lit(False)))
            run = changes(fresh, shards).writeStream.format("parquet").outputMode("append").option("path", f"{home}/feed").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
            try:
                run.awaitTermination()
            finally:
                run.stop()
            found += 1
    return spark.read.schema(FEED).parquet(f"{home}/feed") if found else spark.createDataFrame([], FEED)


#: What the feed of sale lines counts with: its first day (since 1970), the days of missing dates, batches over so many days, days of grace.
FIRST_DAY, SPAN, BATCHES, OVER, GRACE = 19723, 150, 10, 180, 3


def sale_batches(lines: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """nation_id, item_id, day (of arrival), shipped (day), cents and batch of every sale line; a line that no board counts has null
    nation_id. Prices and nations are joined by merging, in which adaptive execution splits an item or vendor that many lines have; nothing is broadcast."""
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")))
    h = F.crc32(text.cast("binary"))
    shipped = F.coalesce(F.unix_date(F.to_date("shipped_at")).cast("bigint"), FIRST_DAY + h % SPAN)
    day = shipped + h % 7 + F.when(h % 5 == 0, 20).otherwise(0)
    batch = F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / OVER))).cast("int")
    finite = lambda x: F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)
    price = items.where("item_id is not null").select(F.col("item_id").alias("_item"), F.lit(True).alias("_known"), finite(F.col("price").cast("double")).alias("price"))
    nation = vendors.where("vendor_id is not null").select(F.col("vendor_id").alias("_vendor"), F.col("nation_id").cast("int").alias("nation_id"))
    rows = lines.select("item_id", "vendor_id", "quantity", finite(F.col("amount").cast("double")).alias("amount"), "flag", shipped.alias("shipped"), day.alias("day"))
    joined = rows.join(price.hint("merge"), F.col("item_id") == F.col("_item"), "left").join(nation.hint("merge"), F.col("vendor_id") == F.col("_vendor"), "left")
    cents = F.coalesce(F.floor(100 * F.col("amount") + 0.5), F.col("quantity") * F.floor(100 * F.col("price") + 0.5), F.lit(0))
    signed = F.when(F.col("flag") == "swapped", -cents).otherwise(cents).cast("bigint")
    counted = F.when(F.col("_known"), F.col("nation_id")).alias("nation_id")
    return joined.select(counted, "item_id", "day", "shipped", signed.alias("cents"), batch.alias("batch"))


def sales_feed(lines: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """The change feed of the boards of nations over sale lines, with the batch of each change.

    Dates that are null are spread by the line's checksum; null amounts count by price, without one as 0; lines without a known
    item or nation move no board but count for lateness; repeated lines count each; amounts and prices that are not finite count as
    null. item_id and vendor_id are keys of items and vendors. Without lines the feed is empty. Other columns are left out, so their names do not matter.
    """
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, -(-items.count() // ITEMS)))
    spark = lines.sparkSession
    with settings(spark, **{"spark.sql.shuffle.partitions": str(spread(lines.count(), ROWS, spark))}):
        batches = written(combined(sale_batches(lines, items, vendors)), "lines", "batch")
    latest = dict(map(tuple, batches.groupBy("batch").agg(F.max("shipped")).collect()))

    def late(b: int) -> Column | None:
        before = [most for batch, most in latest.items() if batch < b]
        return F.col("shipped") + GRACE < F.lit(max(before)) if before else None

    found = feed(batches, shards, late)
    batch = F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((F.col("arrival_day") - FIRST_DAY) * BATCHES / OVER))).cast("int")
    return found.select("nation_id", "arrival_day", "item_id", batch.alias("batch"), "change", "old_rank", "new_rank", "revenue")
