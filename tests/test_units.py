"""Small operators, sources, functions and guards."""

import json
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyspark.functions import casts
from tallyspark.functions.numbers import extract_numbers, half_up
from tallyspark.functions.text import similarity, states
from tallyspark.functions.timeref import Clock, label, time_of
from tallyspark.operators import evaluation, quality, series, shaping
from tallyspark.operators.guard import Refused, check, collected, guarded
from tallyspark.operators.leaders import leaders
from tallyspark.operators.metrics import Base, Metric, compile_metrics
from tallyspark.operators.retrieval import reciprocal_rank
from tallyspark.sources.landing import Contract, ContractError, flatten, headers_of, land, read_raw, schedule_counts
from tallyspark.sources.raw_store import RawStore, patient, request_key
from tallyspark.sources.snapshots import Snapshots, fingerprint, scope_seed, write_partitioned
from tallyspark.streaming.latest import current, daily_counts, newest_first, read_folder, upsert_into


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_casts(spark):
    for text, want in (("12.5", 12), ("13.5", 14), ("7", 7), ("x", None), (None, None), ("-3.0", -3)):
        assert one(spark, casts.to_int(F.lit(text).cast("string"))) == want
    assert one(spark, casts.season_label(F.lit(1999))) == "1999-00" and one(spark, casts.season_of_id(F.lit("22024"))) == "2024-25"
    assert one(spark, casts.season_type(F.lit("0042300001"))) == "Playoffs" and one(spark, casts.season_type(F.lit("0012300001"))) is None
    assert [one(spark, casts.periods(F.lit(m))) for m in (240, 265, 290, 239)] == [4, 5, 6, None]
    assert one(spark, casts.alias_norm(F.lit("Łuka  Dončić Jr."))) == "luka doncic jr" and one(spark, casts.ratio(F.lit(1), F.lit(0))) is None


def test_fusion_reads_each_base_once(spark):
    rows = spark.createDataFrame([(1, 10, 1), (1, 20, 0), (2, 5, 0)], "k int, x int, f int")
    metrics = [Metric("total", "b", "sum(x)"), Metric("flagged", "b", "count(*)", where="f = 1"), Metric("rate", "b", "sum(x) / nullif(count(*), 0)"), Metric("big", "b", "count_if(x > 9)", where="f = 0")]
    out = compile_metrics(spark.createDataFrame([(1,), (2,), (3,)], "k int"), {"b": Base(rows, ("k",))}, metrics)
    assert {tuple(r) for r in out.collect()} == {(1, 30, 1, 15.0, 1), (2, 5, None, 5.0, 0), (3, None, None, None, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_leaders_keep_or_cut_ties(spark):
    rows = spark.createDataFrame([(1, 9.0), (2, 9.0), (3, 8.0), (4, 8.0), (5, None)], "id int, v double")
    assert [r["id"] for r in leaders(rows, "v", "id", 3).orderBy("rank").collect()] == [1, 2, 3]
    assert sorted((r["id"], r["rank"]) for r in leaders(rows, "v", "id", 3, ties="keep").collect()) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    assert leaders(rows.where("false"), "v", "id", 3, ties="keep").count() == 0


def test_series_and_shaping(spark):
    rows = spark.createDataFrame([("a", i, i not in (3, 7)) for i in range(10)], "k string, t int, w boolean")
    runs = series.streaks(rows, ["k"], ["t"], F.col("w"))
    assert sorted(tuple(r) for r in runs.collect()) == [("a", 0, 2, 3), ("a", 4, 6, 3), ("a", 8, 9, 2)]
    assert series.longest(runs, ["k"]).first()["first"] == 0
    batches = spark.createDataFrame([("q", "2024-01", 1), ("q", "2024-02", 2), ("q", "2024-02", 3)], "k string, f string, v int")
    assert sorted(r["v"] for r in shaping.latest_batch_per(batches, ["k"], "f").collect()) == [2, 3]
    games = spark.createDataFrame([("g", 2, False, 5), ("g", 1, False, 9), ("h", 1, True, 3), ("h", 2, False, 4), ("i", 1, True, 0)], "g string, t int, home boolean, p int")
    assert sorted(tuple(r) for r in shaping.pair_rows(games, "g", "t", "home", ["t", "p"]).collect()) == [("g", 1, 9, 2, 5, True), ("h", 1, 3, 2, 4, False)]
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(2, 1, "hit"), (3, 1, "miss")], "p int, q int, n string")
    assert [r["n"] for r in shaping.unordered_pairs(a, b, ("x", "y"), ("p", "q")).collect()] == ["hit"]
    lists = [spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, o double"), spark.createDataFrame([("b", 1.0)], "id string, o double")]
    assert [r["id"] for r in reciprocal_rank(lists, "id", "o", 2).collect()] == ["b", "a"]


def test_anomalies(spark):
    got = spark.createDataFrame([("a", 9), ("b", 80), ("d", 1)], "day string, n int")
    want = spark.createDataFrame([("a", 9), ("b", 100), ("c", 2)], "day string, n int")
    assert sorted(r["day"] for r in quality.count_anomalies(got, want, "day").collect()) == ["b", "c", "d"]


RAW = {"key": "k1", "endpoint": "Log", "season": "2023-24", "params": {"Season": "2023-24"}, "fetched_at": "2024-01-01", "response": {"resultSets": [{"name": "Rows", "headers": ["ID", "V", "T"], "rowSet": [[1, 2.0, None], [2, 2.5, "x"]]}, {"name": "Other", "headers": ["Z"], "rowSet": []}]}}


def test_landing(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    more = json.loads(json.dumps(RAW)) | {"key": "k2", "fetched_at": "2024-01-02"}
    more["response"]["resultSets"][0] = {"name": "Rows", "headers": ["ID", "NEW"], "rowSet": [[3, True]]}
    single = RAW | {"endpoint": "Solo", "response": {"resultSet": {"name": "One", "headers": ["A"], "rowSet": [["b"]]}}}
    for i, d in enumerate((RAW, more, single)):
        (tmp_path / "raw" / f"{i}.json").write_text(json.dumps(d))
    raw = read_raw(spark, str(tmp_path / "raw"))
    assert headers_of(raw, "Log", "Rows") == ["ID", "V", "T", "NEW"]
    tables = land(raw, {"Log": ["Rows", "Missing"], "Solo": ["One"]}, str(tmp_path / "out"))
    got = sorted((r["ID"], r["V"], r["T"], r["NEW"], r["_key"], json.loads(r["_params"])["Season"]) for r in tables["log__rows"].collect())
    assert [x[:5] for x in got] == [("1", "2", None, None, "k1"), ("2", "2.5", "x", None, "k1"), ("3", None, None, "true", "k2")]
    assert tables["log__missing"].count() == 0 and tables["solo__one"].first()["A"] == "b"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text(json.dumps(RAW | {"response": {"resultSets": [{"name": "Rows", "headers": ["ID", "V"], "rowSet": [[1]]}]}}))
    with pytest.raises(Exception, match="not as wide"):
        flatten(read_raw(spark, str(tmp_path / "bad")), "Log", "Rows", ["ID"]).collect()


@pytest.mark.parametrize(
    "change",
    [lambda s: s.update(headers=["ID", "V", "U"]), lambda s: s.update(headers=["V", "ID", "T"]), lambda s: s.update(headers=["ID", "V"]), lambda s: s["rowSet"].append([1, 2.0]), lambda s: s["rowSet"].append([1, 2.0, "a", "b"]), lambda s: s["rowSet"].append([1, "two", "x"]), lambda s: s["rowSet"].append([None, 2.0, "x"]), lambda s: s.update(name="Gone")],
)
def test_contracts(change):
    contract = Contract.observed("Log", [json.dumps(RAW)], {"Rows": ("ID",)})
    contract.check(json.dumps(RAW))
    bad = json.loads(json.dumps(RAW))
    change(bad["response"]["resultSets"][0])
    with pytest.raises(ContractError):
        contract.check(json.dumps(bad))


def test_schedule(spark):
    doc = {"response": {"leagueSchedule": {"gameDates": [{"gameDate": "d1", "games": [{"gameId": "0022300001", "gameStatus": 3}, {"gameId": "0012300001", "gameStatus": 3}, {"gameId": "0022300002", "gameStatus": 1}]}, {"gameDate": "d2", "games": []}]}}}
    assert [tuple(r) for r in schedule_counts(spark.createDataFrame([(json.dumps(doc),)], "value string")).collect()] == [("d1", 1)]


def test_raw_store(tmp_path):
    calls = []
    store = RawStore(tmp_path, lambda e, p: calls.append(p) or {"n": len(calls)})
    assert store.get("e", "p", a=1)["response"] == store.get("e", "p", a=1)["response"] == {"n": 1}
    assert store.get("e", "p", refresh=True, a=1)["response"] == {"n": 2} and store.get("e", "p", a=1)["response"] == {"n": 2}
    assert len(list(tmp_path.rglob("*.json"))) == 2 and not list(tmp_path.rglob("*.part"))
    assert request_key("e", {"a": 1, "b": 2}) == request_key("e", {"b": 2, "a": 1}) != request_key("e", {"a": 2, "b": 2})
    waits, answers = [], iter([{}, OSError(), {"ok": 1}])

    def call():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert patient(call, sleep=waits.append) == {"ok": 1} and waits == [2.0, 4.0]


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, tmp_path / "s", keep=2)
    for k in range(1, 5):
        s.build(f"b{k}", {"t": spark.range(k)}, f"2024-01-0{k}")
        s.publish(f"b{k}")
    assert s.names() == ["b3", "b4"] and s.table("t").count() == 4
    assert s.rollback() == "b3" and s.table("t").count() == 3
    with pytest.raises(FileExistsError):
        s.build("b4", {"t": spark.range(1)}, "x")
    part = next((tmp_path / "s" / "b4").rglob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError, match="not as it was built"):
        s.publish("b4")
    assert fingerprint(spark.range(9)) == fingerprint(spark.range(9).orderBy(F.desc("id")).repartition(3)) != fingerprint(spark.range(8))
    seed = spark.createDataFrame([("a", "r"), ("b", "r"), (None, None), (" ", None)], "season string, season_type string")
    assert scope_seed(seed, spark.createDataFrame([("a", "r")], "season string, season_type string")).count() == 3
    write_partitioned(spark.range(20).selectExpr("id", "id % 2 as season"), str(tmp_path / "p"), "season", ["id"])
    assert spark.read.parquet(str(tmp_path / "p")).where("season = 1").count() == 10


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, v int, fetched timestamp"
    rows = [(1, 1, "2024-01-01"), (1, 2, "2024-01-03"), (2, 5, "2024-01-02"), (1, 2, "2024-01-03")]
    spark.createDataFrame(rows, "k int, v int, fetched string").withColumn("fetched", F.to_timestamp("fetched")).write.parquet(src)
    stream = newest_first(read_folder(spark, src, schema), ["k"], "fetched")
    run = lambda: stream.writeStream.foreachBatch(upsert_into(out, ["k"], "fetched")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    run()
    assert sorted((r["k"], r["v"]) for r in current(spark, out, 1).collect()) == [(1, 2), (2, 5)]
    spark.createDataFrame([(2, 9, "2024-01-05"), (1, 0, "2023-12-31")], "k int, v int, fetched string").withColumn("fetched", F.to_timestamp("fetched")).write.mode("append").parquet(src)
    run()
    newest = max(int(p.name[1:]) for p in (tmp_path / "out").iterdir())
    assert sorted((r["k"], r["v"]) for r in current(spark, out, newest).collect()) == [(1, 2), (2, 9)]
    q = daily_counts(read_folder(spark, src, schema), "fetched").writeStream.format("memory").queryName("daily").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {str(r["day"]): r["n"] for r in spark.table("daily").collect()}.get("2024-01-03") == 2


GOOD = ["select a from v", "select count(*) as n from v group by a having count(*) > 0 order by 1 limit 5", "with w as (select a from v) select * from w", "select a from v union select a + 1 from v", "select a, row_number() over (order by a) r from v", "select * from v limit 1000"]
BAD = [
    "drop table v", "select 1; select 2", "insert into v values (1)", "create table x as select * from v", "select * from other", "select * from parquet.`/etc/passwd`", "select * from spark_catalog.default.v", "set spark.x = 1", "select java_method('java.lang.System', 'exit', 1) from v",
    "select reflect('a', 'b') from v", "select * from range(10)", "select * from v tablesample (10 rows)", "with recursive r as (select 1) select * from r", "describe v", "explain select * from v", "cache table v", "select input_file_name() from v", "select transform(a) using 'cat' from v",
    "select * from v, lateral explode(array(1))", "", "select a from v where a in (select b from hidden)", "select " + "a," * 3000 + "a from v", "select a\0 from v", "show tables", "select current_user() from v", "use other", "select * from v lateral view explode(array(1)) t as x",
]


@pytest.mark.parametrize("sql", GOOD)
def test_allowed_queries(spark, sql):
    v = spark.range(500).withColumnRenamed("id", "a")
    assert 1 <= len(collected(guarded(sql, {"v": v}), 60)) <= 100
    assert not spark.catalog.listTables() or all(not t.name.startswith("v_") for t in spark.catalog.listTables())


@pytest.mark.parametrize("sql", BAD)
def test_refused_queries(spark, sql):
    with pytest.raises(Refused):
        check(spark, sql, {"v"})


def test_the_watchdog(spark):
    with pytest.raises(Exception, match="(?i)cancel|interrupt"):
        collected(spark.range(3 * 10**10).selectExpr("sum(id % 7)"), 1.0)


def test_numbers():
    got = [(x["value"], x["decimals"], x["percent"]) for x in extract_numbers("He had 1,234 points, 45.6% and -7 in 2023-24 on 2024-01-02; 2.5 million; team23 no") if not x["token"]]
    assert got == [("1234", 0, False), ("45.6", 1, True), ("-7", 0, False), ("2500000", 0, False)]
    assert extract_numbers(None) == [] and str(half_up(1.005, 2)) == "1.01" and str(half_up(0.285, 2)) == "0.29"
    assert states(45.6, 1, True, 0.4561, 1, True) and not states(45.61, 2, True, 0.4561, 1, True) and states(27.1, 1, False, 27.05, 1, False) and not states(27.0, 1, False, 27.05, 1, False)
    assert similarity("abc", "abc") == 100 and similarity("", "") == 100 and similarity("abcd", "abxd") == pytest.approx(75)


def test_time():
    c = Clock(date(2024, 4, 12), 2023, 2022)
    assert time_of("who won last night", c).day == date(2024, 4, 12) and time_of("yesterday", c).day == date(2024, 4, 11)
    assert time_of("in the 2015-16 season", c).seasons == ("2015-16",) and time_of("since 2021", c).seasons == ("2021-22", "2022-23", "2023-24")
    assert len(time_of("best of the 90s", c).seasons) == 10 and time_of("last three seasons", c).seasons[0] == "2021-22"
    assert time_of("last season", c).seasons == ("2022-23",) and time_of("the last finals", c).season_type == "Playoffs" and time_of("this season", c).seasons == ("2023-24",)
    assert time_of("nothing here", c).seasons == () and label(1999) == "1999-00"


def test_evaluation():
    assert evaluation.row_sets_equal([{"a": 1.0000001}, {"a": 2}], [{"b": 2}, {"b": 1}], {"b": "a"}) and not evaluation.row_sets_equal([{"a": 1}], [{"b": 1}, {"b": 1}], {"b": "a"})
    assert not evaluation.row_sets_equal([{"a": 1}, {"a": 2}], [{"a": 2}, {"a": 1}], {"a": "a"}, ordered=True)
    assert evaluation.mcnemar([True] * 5, [False] * 5) == 1 / 32 and evaluation.mcnemar([True], [True]) == 1
    share, low, high = evaluation.family_bootstrap({"x": [True, True], "y": [False], "z": [True]})
    assert low <= share <= high and share == 0.75
    assert 0.25 < sum(evaluation.held_out(f"f{i}", "s") for i in range(2000)) / 2000 < 0.35


SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"])
def test_queries_agree_with_their_sql(spark, name):
    if name not in entry.queries():
        pytest.skip("not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    own = entry.queries()[name](spark, SMALL)
    other = con.sql(entry.oracle_sql()[name])
    assert sorted(own.columns) == sorted(other.columns)
    columns = sorted(own.columns)
    norm = lambda x: round(x, 9) if isinstance(x, float) else x
    a = sorted((tuple(norm(r[c]) for c in columns) for r in own.collect()), key=repr)
    at = [other.columns.index(c) for c in columns]
    b = sorted((tuple(norm(r[i]) for i in at) for r in other.fetchall()), key=repr)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() == 10
