"""Keyed upserts and backfills: only what changes is written, and a run that is killed between any two steps does no harm."""

import itertools

import pytest
from pyspark.sql import functions as F

from tallyspark.sources.backfill import Backfill
from tallyspark.sources.commits import Conflict, Log
from tallyspark.sources.upsert import KeyedTable


def _files(path):
    return {str(p) for p in path.rglob("*") if p.is_file()}


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_log(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    assert log.read() == (0, {}) and log.commit(0, {"a": "é"}) == 1 and log.commit(1, {"a": 2}) == 2
    assert log.read() == (2, {"a": 2}) and log.read(1) == (1, {"a": "é"})
    with pytest.raises(Conflict):
        log.commit(1, {})


def test_only_changed_partitions_are_written(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["id"], 8)
    assert table.table() is None
    first = spark.createDataFrame([(k, f"text {k}", 1) for k in range(40)] + [(3, "newer", 2)], "id int, text string, fetched int")
    derived = []

    def embed(changed):
        derived.append(changed.count())
        return changed.withColumn("vector", F.array(F.length("text").cast("float")))

    options = {"newest": ["fetched"], "content": ["text"], "derive": embed}
    assert table.upsert(first, **options) == {"changed": 40, "deleted": 0, "rewritten": 8}
    before = _files(tmp_path)
    assert table.upsert(first, **options) == {"changed": 0, "deleted": 0, "rewritten": 0} and _files(tmp_path) == before
    assert table.upsert(first.limit(0), **options)["rewritten"] == 0 and _files(tmp_path) == before
    assert table.upsert(spark.createDataFrame([(3, "newest", 3), (4, "text 4", 9)], first.schema), **options) == {"changed": 1, "deleted": 0, "rewritten": 1}
    assert derived == [40, 1]
    rows = {r.id: r for r in table.table().collect()}
    assert len(rows) == 40 and rows[3].text == "newest" and list(rows[3].vector) == [6.0] and rows[4].fetched == 1  # the content is as it was
    assert _rows(table.table(1).where("id = 3"), "text") == [("newer",)]
    gone = table.upsert(table.table().where("id < 30").select("id", "text", "fetched"), delete_missing=True, **options)
    assert gone["deleted"] == 10 and gone["changed"] == 0 and table.table().count() == 30
    assert KeyedTable(spark, str(tmp_path), ["id"], 99).partitions == 8
    assert table.sweep(keep=1) >= 1 and table.table().count() == 30


def test_a_stream_takes_each_batch_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"], 4)
    schema = "id int, v int"
    for k in range(3):
        spark.createDataFrame([(i, k) for i in range(k, 6)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        run = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(table.sink("s", newest=["v"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
    assert _rows(table.table(), "id", "v") == [(i, min(i, 2)) for i in range(6)]
    version = table.log.read()[0]
    table.sink("s", newest=["v"])(spark.createDataFrame([(0, 99)], schema), 2)  # a batch that is repeated
    assert table.log.read()[0] == version
    table.sink("s", newest=["v"])(spark.createDataFrame([(0, 99)], schema), 3)
    assert _rows(table.table().where("id = 0"), "v") == [(99,)]


class Killed(BaseException):
    pass


@pytest.mark.parametrize("where", ["write", "commit"])
def test_a_backfill_that_is_killed_goes_on(spark, tmp_path, monkeypatch, where):
    def fetch(unit):
        if unit["n"] % 7 == 3:
            raise ValueError(f"no {unit['n']}")
        return f"body {unit['n']}"

    def fixed(unit):
        return f"body {unit['n']}"

    def later(b):
        if b.table("first").count() == 0:
            raise LookupError("needs the first stage")
        return b.table("first").select(F.concat(F.lit("again-"), "uid").alias("uid"), F.length("body").alias("n"))

    stages = {"first": lambda b: spark.range(20).select(F.concat(F.lit("u"), "id").alias("uid"), F.col("id").alias("n")), "second": later}
    whole = Backfill(spark, str(tmp_path / "whole"), 3)
    assert whole.run({"second": later}, fetch)["blocked"] == 1
    stats = whole.run(stages, fetch)
    assert (stats["fetched"], stats["skipped"], stats["failed"]) == (17 + 17, 0, 3) and {r.error for r in whole.failures().collect()} == {f"ValueError: no {n}" for n in (3, 10, 17)}

    cut = Backfill(spark, str(tmp_path / "cut"), 3)
    step = itertools.count()
    commit = Log.commit
    for kill_at in range(12):  # a kill at every commit in turn, before it or right after it
        seen = itertools.count()

        def killed(self, after, state, kill_at=kill_at, seen=seen):
            if next(seen) == 1:
                if where == "commit":
                    commit(self, after, state)
                raise Killed
            next(step)
            return commit(self, after, state)

        monkeypatch.setattr(Log, "commit", killed)
        try:
            cut.run(stages, fetch)
            break
        except Killed:
            pass
    monkeypatch.setattr(Log, "commit", commit)
    cut.run(stages, fetch)
    assert _rows(cut.table(), "uid", "stage", "body") == _rows(whole.table(), "uid", "stage", "body")
    again = cut.run(stages, fixed)
    assert again["fetched"] == 3 + 3 and cut.failures().count() == 0 and cut.run(stages, fixed) == {"fetched": 0, "skipped": 40, "failed": 0, "blocked": 0}
    assert cut.table().count() == 40 and cut.table().select("uid").distinct().count() == 40


def test_a_run_of_few_waves(spark, tmp_path):
    b = Backfill(spark, str(tmp_path), 5)
    stages = {"s": lambda _: spark.range(30).select(F.col("id").cast("string").alias("uid"))}
    seen = [b.run(stages, lambda u: u["uid"], waves=2)["fetched"] for _ in range(4)]
    assert sum(seen) == 30 and seen[-1] == 0 and b.table().count() == 30
