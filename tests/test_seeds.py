"""Typed seeds, bad lines by number, and what a load leaves out."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.shaping import first_seasons
from tallyspark.sources import seeds
from tallyspark.sources.landing import land, read_raw
from tallyspark.sources.seeds import SEEDS, SeedError, parsed, read_seed, read_seeds


def test_eleven_typed_seeds(spark, tmp_path):
    for name, types in SEEDS.items():
        columns = [t.split(" ") for t in types.split(", ")]
        cells = {"string": '"a, b"', "int": "7", "date": "1948-03-23"}
        (tmp_path / f"{name}.csv").write_text(",".join([c for c, _ in columns] + ["more"]) + "\n" + ",".join([cells[k] for _, k in columns] + ["x"]) + "\r\n\n" + ",".join("" for _ in range(len(columns) + 1)) + "\n")
    found = read_seeds(spark, str(tmp_path))
    assert len(found) == 11
    for name, df in found.items():
        assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [tuple(t.split(" ")) for t in SEEDS[name].split(", ")] + [("more", "string")]
        rows = [tuple(r) for r in df.collect()]
        assert len(rows) == 2 and rows[0][-1] == "x" and all(v is None for v in rows[1]) and "a, b" in rows[0]


def test_bad_lines(spark, tmp_path):
    path = tmp_path / "season_schedule.csv"
    path.write_text("note,season_start,max_games\nfine,1946,61\nbad number,19x6,61\nshort,1947\n\nfine,,\nlong,1948,60,9\n")
    with pytest.raises(SeedError, match="line 3: bad number,19x6,61; line 4: short,1947; line 7: long,1948,60,9"):
        read_seed(spark, str(tmp_path), "season_schedule")
    assert [r["_line"] for r in parsed(spark, str(path), SEEDS["season_schedule"]).where("_bad is null").collect()] == [2, 6]
    path.write_text("season_start,note\n1946,x\n")
    with pytest.raises(SeedError, match="lacks max_games"):
        read_seed(spark, str(tmp_path), "season_schedule")
    path.write_text("")
    with pytest.raises(SeedError, match="lacks"):
        read_seed(spark, str(tmp_path), "season_schedule")


def test_load_predicates(spark, tmp_path):
    for k in range(4):
        (tmp_path / "raw").mkdir(exist_ok=True)
        doc = {"key": f"k{k}", "endpoint": "e", "season": f"200{k}", "params": {}, "fetched_at": "t", "response": {"resultSets": [{"name": "S", "headers": ["A"], "rowSet": [[k], [k + 10]]}]}}
        (tmp_path / "raw" / f"f{k}.json").write_text(json.dumps(doc))
    (tmp_path / "raw" / "broken.json").write_text("{")
    raw = read_raw(spark, str(tmp_path / "raw"), F.col("_metadata.file_name").rlike("^f[0-2]"))
    assert raw.count() == 3
    table = land(raw, {"e": ["S"]}, str(tmp_path / "out"), F.col("season") > "2000")["e__s"]
    assert sorted(r["A"] for r in table.collect()) == ["1", "11", "12", "2"]


def test_no_statistic_is_dropped(spark, monkeypatch):
    from tallyspark.operators import shaping

    rows = spark.range(1500).select(F.concat(F.lit("s"), "id").alias("stat"), F.col("id").cast("int").alias("first_season_start"))
    assert len(first_seasons(rows)) == 1500
    monkeypatch.setattr(shaping, "MOST_STATS", 100)
    with pytest.raises(ValueError, match="more than 100"):
        first_seasons(rows)
    assert seeds.SEEDS
