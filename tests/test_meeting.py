"""Which names meet before their ratio is computed: all similar ones, hardly any others."""

import random
from itertools import product

import duckdb
import pytest
from test_mentions import ratio

import __spark_entry__ as entry
from tallyspark.operators.entities import LEAST_RATIO, LONG, meeting_keys, similar_names

SMALL = "/root/testdata/sf0.001"


def edited(rng, text, letters):
    return "".join(c + rng.choice(letters) * (rng.random() < 0.07) for c in text if rng.random() > 0.07)


def test_similar_texts_share_a_key():
    rng, met = random.Random(5), 0
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdefghij "])
        a = "".join(rng.choices(letters, k=rng.randint(2, LONG)))
        b = edited(rng, a, letters)[:LONG]
        if len(b) > 1 and ratio(a, b) >= LEAST_RATIO:
            met += 1
            assert meeting_keys(a, True) & meeting_keys(b, False), (a, b)
    assert met > 500


def test_other_names_hardly_meet():
    names = [r[0] for r in duckdb.sql(f"select distinct lower(name) from '{SMALL}/clients.parquet' where len(name) > 1 order by 1").fetchall()]
    first, second = ([meeting_keys(x, k) for x in names] for k in (True, False))
    met = sum(not a.isdisjoint(b) for (i, a), (j, b) in product(enumerate(first), enumerate(second)) if i != j)
    assert met < len(names) ** 2 / 50


def test_long_texts_are_found_too(spark):
    rng = random.Random(9)
    names = {"".join(rng.choices("abcdefgh ", k=rng.randint(28, 70))) for _ in range(40)}
    spans = {edited(rng, n, "abcdefgh ") for n in names}
    got = similar_names(spark.createDataFrame([(s,) for s in spans], "span string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    want = {(s, n) for s, n in product(spans, names) if ratio(s, n) >= LEAST_RATIO}
    assert {(r.span, r.name) for r in got} == want and len(got) == len(want) and any(len(s) < LONG for s, _ in want) and any(len(s) > LONG for s, _ in want)


@pytest.mark.parametrize("name", ["fuzzy_names"])
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("vendors", "clients"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, entry.queries()[name](spark, SMALL).collect())) == sorted(want)
