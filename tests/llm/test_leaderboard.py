"""Leaderboards: both levels against plain recounts, runs of state, the feed over several starts, awkward rows."""

import random
import zlib
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import leaderboard
from tallyspark.llm.leaderboard import _packed, _unpacked, best, board_changes, combined, feed, sales_feed, shard_changes


def top(revenue):
    return sorted((i for i, r in revenue.items() if r > 0), key=lambda i: (-revenue[i], i))[:10]


def recount(lines):
    """(nation, day, item, change, old, new, revenue) of lines (nation, item, day, cents)."""
    out = []
    for nation in {x[0] for x in lines}:
        revenue, old = {}, {}
        own = [x for x in lines if x[0] == nation]
        for day in sorted({x[2] for x in own}):
            for _, item, d, cents in own:
                if d == day:
                    revenue[item] = revenue.get(item, 0) + cents
            new = {i: k for k, i in enumerate(top(revenue), 1)}
            for i in old.keys() | new.keys():
                if old.get(i) != new.get(i):
                    out.append((nation, day, i, "enter" if i not in old else "exit" if i not in new else "move", old.get(i), new.get(i), revenue[i]))
            old = new
    return out


def made(rng, n, nations=3, items=60, days=12):
    return [(rng.randrange(nations), rng.randrange(items), rng.randrange(days), rng.choice([-1, 1, 1, 2]) * rng.randrange(0, 40)) for _ in range(n)]


def test_packing_round_trip():
    items, cents = np.array([-5, 0, 7, 2**62]), np.array([1, -(2**60), 0, 3])
    assert [x.tolist() for x in _unpacked(_packed(items, cents))] == [items.tolist(), cents.tolist()]
    assert [len(x) for x in _unpacked(_packed(items[:0], cents[:0]))] == [0, 0]


def test_best_with_ties():
    rng = random.Random(2)
    for n in (0, 1, 9, 10, 41, 300):
        revenue = {i: rng.randrange(-3, 6) for i in rng.sample(range(1000), n)}
        items, cents = np.array(list(revenue), np.int64), np.array(list(revenue.values()), np.int64)
        assert items[best(items, cents)].tolist() == top(revenue)


@pytest.mark.parametrize("seed", range(6))
def test_shards_and_merger_equal_a_recount(seed):
    """Two levels in several batches, as the processors chain them, without Spark."""
    rng = random.Random(seed)
    lines = made(rng, 900, nations=1, items=rng.choice([15, 60, 200]))
    shards = 3
    held, state, out = {}, {s: {} for s in range(shards)}, []
    for batch in ([x for x in lines if x[2] < 4], [x for x in lines if 4 <= x[2] < 5], [x for x in lines if x[2] >= 5]):
        changes = []
        for s in range(shards):
            own = sorted((x for x in batch if x[1] % shards == s), key=lambda x: x[2])
            if own:
                items = np.array(sorted(state[s]), np.int64)
                arrays = [np.array([x[k] for x in own], np.int64) for k in (2, 1, 3)]
                changes += shard_changes(items, np.array([state[s][i] for i in items.tolist()], np.int64), *arrays)
                for _, i, _, c in own:
                    state[s][i] = state[s].get(i, 0) + c
        out += [(0, *x) for x in board_changes(held, sorted(changes))]
        assert len(held) <= 10 * shards
    assert sorted(out, key=str) == sorted(recount(lines), key=str)


def test_feed_over_several_starts(spark, monkeypatch):
    monkeypatch.setattr(leaderboard, "RUNS", 1)  # runs are merged at once
    monkeypatch.setattr(leaderboard, "HELD", 50)
    rng = random.Random(9)
    lines = made(rng, 700)
    rows = [(*x, x[2] // 5) for x in lines] + [(None, 1, 3, 10**6, 0), (1, None, 3, 10**6, 0)]
    df = spark.createDataFrame(rows, leaderboard.LINES + ", batch int").repartition(3)
    got = [tuple(r) for r in feed(df, shards=2).collect()]
    assert sorted(got, key=str) == sorted(recount(lines), key=str)


def test_sale_lines_with_awkward_rows(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    lines = []
    for k in range(260):
        shipped = rng.choice([None] + [start + timedelta(days=rng.randrange(150), hours=5)] * 9)
        lines.append((rng.choice([None, k]), rng.choice([None, 1, 2, 99]), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 4]), rng.choice([None, 3]), rng.choice([None, 2.345, -1.005, float("nan"), float("inf")]), rng.choice([None, "kept", "swapped"]), shipped))
    lines += lines[:20]
    df = spark.createDataFrame([(*x, "x", 7) for x in lines], "sale_id long, item_id long, vendor_id long, line_no int, quantity int, amount double, flag string, shipped_at timestamp_ntz, batch string, _item int")
    items = spark.createDataFrame([(1, 1.25, "a"), (2, None, "b"), (None, 5.0, "c")], "item_id long, price double, day string")
    vendors = spark.createDataFrame([(1, 3), (2, None), (None, 4), (3, 8)], "vendor_id long, nation_id int")
    placed = []
    for sale, item, vendor, number, quantity, amount, flag, shipped in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, number)).encode())
        s = (shipped - datetime(1970, 1, 1)).days if shipped else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        amount = None if amount is None or not np.isfinite(amount) else amount
        price = {1: 1.25}.get(item)
        cents = int(np.floor(100 * amount + 0.5)) if amount is not None else quantity * int(np.floor(100 * price + 0.5)) if quantity is not None and price is not None else 0
        nation = {1: 3, 3: 8}.get(vendor) if item in (1, 2) else None
        placed.append((nation, item, a, -cents if flag == "swapped" else cents, s, min(10, 1 + int((a - 19723) * 10 // 180))))
    counted = []
    for nation, item, a, cents, s, b in placed:
        before = [x[4] for x in placed if x[5] < b]
        if nation is not None and not (before and s + 3 < max(before)):
            counted.append((nation, item, a, cents))
    got = [tuple(r) for r in sales_feed(df, items, vendors).collect()]
    want = [(n, d, i, min(10, 1 + (d - 19723) * 10 // 180), c, o, w, r) for n, d, i, c, o, w, r in recount(counted)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sales_feed(df.limit(0), items, vendors).count() == 0


def test_no_store_stays_open_after_its_batch(spark):
    """Each start opens a store a partition and level; those that are closed have removed their folder."""
    jvm = spark.sparkContext._jvm
    local = Path(jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf()))
    before = set(local.glob("**/*StateStoreId*"))
    df = spark.createDataFrame([(*x, x[2] // 6) for x in made(random.Random(3), 80)], leaderboard.LINES + ", batch int")
    assert feed(df, shards=2).count() > 0
    assert set(local.glob("**/*StateStoreId*")) <= before


def test_lines_are_combined_in_each_task(spark, monkeypatch):
    monkeypatch.setattr(leaderboard, "HELD", 40)
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, 1, 7]), rng.randrange(3), rng.randrange(2), rng.randrange(-9, 9)) for _ in range(600)]
    df = spark.createDataFrame(rows, "nation_id int, item_id bigint, day bigint, shipped bigint, cents bigint").coalesce(2)
    got, want = [tuple(r) for r in combined(df).collect()], {}
    for *k, c in rows:
        want[tuple(k)] = want.get(tuple(k), 0) + c
    found = {}
    for *k, c in got:
        found[tuple(k)] = found.get(tuple(k), 0) + c
    assert found == want
    assert len(got) <= len(rows) // 3
    assert combined(df).columns == df.columns


def test_lines_without_null_cents_are_combined_again_and_again(spark, monkeypatch):
    """Sums that are kept meet further batches of the task, as where a third of the lines has one item."""
    monkeypatch.setattr(leaderboard, "HELD", 40)
    df = spark.range(600).coalesce(1).select((F.col("id") % 2).cast("int").alias("nation_id"), F.lit(7).cast("bigint").alias("item_id"), F.lit(1).cast("bigint").alias("day"), F.coalesce("id", F.lit(0)).alias("cents"))
    assert not df.schema["cents"].nullable
    with leaderboard.settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "25"}):
        got = [tuple(r) for r in combined(df).collect()]
    assert sorted(got) == [(0, 7, 1, sum(range(0, 600, 2))), (1, 7, 1, sum(range(1, 600, 2)))]


def test_joins_have_a_partition_for_so_many_lines_and_the_stream_no_second_kind_of_worker(spark, monkeypatch):
    """Sorts of the joins grow with the lines of a partition; workers of mapInArrow would stay beside those of the state."""
    monkeypatch.setattr(leaderboard, "ROWS", 20)
    had, seen = spark.conf.get("spark.sql.shuffle.partitions"), {}
    write, change = leaderboard.written, leaderboard.changes

    def writing(*a):
        seen["partitions"] = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return write(*a)

    def changing(lines, shards):
        out = change(lines, shards)
        seen["plan"] = out._jdf.queryExecution().logical().toString()
        seen["stream"] = spark.conf.get("spark.sql.shuffle.partitions")
        return out

    monkeypatch.setattr(leaderboard, "written", writing)
    monkeypatch.setattr(leaderboard, "changes", changing)
    lines = spark.createDataFrame([(k, k % 4, 1, 1, 2, 3.5, "kept", datetime(2024, 1, 1)) for k in range(200)], "sale_id long, item_id long, vendor_id long, line_no int, quantity int, amount double, flag string, shipped_at timestamp_ntz")
    items = spark.createDataFrame([(k, 1.25) for k in range(4)], "item_id long, price double")
    assert sales_feed(lines, items, spark.createDataFrame([(1, 3)], "vendor_id long, nation_id int")).count() > 0
    assert seen["partitions"] == 10
    assert seen["stream"] == had == spark.conf.get("spark.sql.shuffle.partitions")
    assert "MapInArrow" not in seen["plan"] and seen["plan"].count("TransformWithState") == 2
