"""Follow-ups: the stream's fold equals the windows; the rules one by one."""

import pytest

from tallyspark.operators.followup import TURN, carry_over, carry_over_stream, step

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = [c.split()[0] for c in TURN.split(", ")]


def turn(k, question, **more):
    return tuple({"turn": k, "question": question, **more}.get(c) for c in _COLUMNS)


CONVERSATION = [
    turn(1, "How many points did X have in 2001?", players=["X"], season="2001", metric="points", result_players=["X"]),
    turn(2, "And in the playoffs?", season_type="playoffs", phrase=True),
    turn(3, "Who led the league in assists that year, and by how much?", result_players=["L"], metric="assists"),
    turn(4, "How many of his games were at home in that one season?"),
    turn(5, "Compare X and Y over their whole careers in every season", players=["X", "Y"], several_seasons=True),
    turn(6, "How many rebounds did he have in all of these games?"),
    turn(7, "How many rebounds did he have, for both of these players?", result_teams=["T"]),
    turn(8, "What do you know about their record in the very last year"),
    turn(9, "What about that?", ambiguous=True),
    turn(10, "What about that?"),
    turn(11, None, teams=["U"]),
    turn(12, "and?"),
    turn(13, "", arg_season="1999", arg_season_type="regular"),
    turn(14, "hehe théhe HE'S", players=[]),
]


def test_rules(spark):
    df = spark.createDataFrame([("c", *t) for t in CONVERSATION], f"conv string, {TURN}")
    got = {r.turn: r for r in carry_over(df, "conv").collect()}
    seen = lambda k: (list(got[k].players), list(got[k].teams), got[k].season, got[k].season_type, got[k].metric, list(got[k].carried))
    assert seen(1) == (["X"], [], "2001", None, "points", [])
    assert seen(2) == (["X"], [], "2001", "playoffs", "points", ["players", "season"])
    assert seen(4) == (["L"], [], "2001", "playoffs", "assists", ["players", "season", "season_type"])
    assert seen(5)[2] is None and got[6].unclear == "he" and list(got[6].candidates) == ["X", "Y"] and seen(6)[0] == []
    assert seen(7)[0] == ["X", "Y"] and seen(8)[1] == ["T"]
    assert seen(9)[:2] == ([], []) and seen(10)[:2] == (["X", "Y"], []) and seen(11)[0] == [] and seen(12)[0] == ["X", "Y"]
    assert got[14].unclear == "he" or got[14].unclear == "he's"
    state = {}
    for t in CONVERSATION:
        want = step(state, dict(zip(_COLUMNS, t, strict=True)))
        row = got[want["turn"]].asDict()
        assert {k: row[k] for k in want if k != "unclear"} == {k: v for k, v in want.items() if k != "unclear"}, want["turn"]
        assert (row["unclear"] is None) == (want["unclear"] is None)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, _ROCKS)
    yield
    spark.conf.unset(name)


def test_stream_equals_batch_on_conversations(spark, rocks, tmp_path):
    from tallyspark.plans.retrieval import user_turns

    t = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    turns = user_turns(t)
    for k, where in enumerate(("turn < 2", "turn between 2 and 4", "turn > 4")):
        turns.where(where).coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
        stream = carry_over_stream(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns")), "conv_id")
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = carry_over(turns, "conv_id")
    assert got.count() == want.count() > 100
    key = lambda r: str(r.asDict() | {"unclear": r["unclear"] is None})
    assert sorted(map(key, got.select(want.columns).collect())) == sorted(map(key, want.collect()))
    assert want.where("size(carried) > 0").count() > 20
