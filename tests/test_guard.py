"""Ad-hoc SQL: what is refused, what runs, and over what."""

import pytest

from tallyspark.operators.guard import Refused, check, guarded, repaired

REFUSED = [
    "select " + ", ".join(f"{k} as c{k}" for k in range(30)) + ", reflect('java.lang.System', 'getProperty', 'user.home') as x from v",
    "select * from secret where 'a, secret as (' is not null",
    "select case when a > 0 then java_method('java.lang.System', 'exit', 1) end from v",
    "with secret as (select * from secret) select * from secret",
    "with a as (select * from b), b as (select * from v) select * from a",
    "select * from (with c as (select * from v) select * from c) x join c on true",
    "with recursive r as (select 1 as n union all select n + 1 from r) select * from r",
    "select a from v where a in (select a from secret)",
    "select a from v where exists (select 1 from secret)",
    "select (select max(a) from secret) from v",
    "select a from v union select a from secret",
    "select * from parquet.`/etc/passwd`",
    "select * from range(5)",
    "select * from v tablesample (10 percent)",
    "select explode(array(1, 2)) from v",
    "select repeat('x', 100) from v",
    "select lpad('x', 1000000000) from v",
    "select max(a) filter (where reflect('a', 'b') is null) from v",
    "select sum(a) over (partition by current_user()) from v",
    "select a from v order by rand()",
    "select a from v group by a having max(uuid()) is null",
    "select transform(array(a), x -> x) from v",
    "select system.builtin.abs(a) from v",
    "insert into v values (1)",
    "set spark.x = 1",
    "show tables",
    "values (1)",
    "select 1; select 2",
    "select a from v where a = :x",
    "select '\0' from v",
    "select '\ud800' from v",
    "select a from v -- " + "x" * 4000,
]

ALLOWED = [
    ("select 'the v here, secret' as t from v", [("the v here, secret",)] * 3),
    ("with w as (select a from v), x as (select a + 1 as a from w) select sum(a) as s from x", [(9,)]),
    ("select a, row_number() over (order by a desc) as r from v where a between 2 and 3 order by a", [(2, 2), (3, 1)]),
    ("select count(*) filter (where a > 1) as n, round(avg(a), 1) as m from v", [(2, 2.0)]),
    ("select a from v where a in (select max(a) from v) or a = (select min(a) from v) order by 1", [(1,), (3,)]),
    ("select case when a % 2 = 0 then 'even' else 'odd' end as k, count(*) as n from v group by 1 having count(*) > 1", [("odd", 2)]),
    ("select a from v except select 2 order by a", [(1,), (3,)]),
    ("select cast('1' as int) + a as b from v order by b limit 1", [(2,)]),
    ("select V.a from V left join v as u on u.a = V.a + 1 where u.a is null", [(3,)]),
]


@pytest.fixture
def v(spark):
    spark.createDataFrame([(9,)], "a int").createOrReplaceTempView("secret")
    yield spark.createDataFrame([(1,), (2,), (3,)], "a int")
    spark.catalog.dropTempView("secret")


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, v, sql):
    with pytest.raises(Refused):
        check(spark, sql, {"v"})


@pytest.mark.parametrize("sql, rows", ALLOWED)
def test_allowed(v, sql, rows):
    assert [tuple(r) for r in guarded(sql, {"v": v}).collect()] == rows


def test_the_session_is_its_own(spark, v):
    before = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    out = guarded("select a from v", {"v": v}, rows=2)
    assert out.count() == 2 and spark.conf.get("spark.sql.runSQLOnFiles", "true") == before
    assert "v" not in {t.name for t in spark.catalog.listTables()} and "secret" not in {t.name for t in out.sparkSession.catalog.listTables()}


def test_one_repair(v):
    asked = []

    def repair(sql, message):
        asked.append(message)
        return "select a from v" if len(asked) == 1 else "select b from v"

    assert repaired("select a from secret", {"v": v}, repair).count() == 3 and "secret" in asked[0]
    with pytest.raises(Refused):
        repaired("select nothing from v", {"v": v}, lambda sql, message: "select a from secret")


def test_bound_parameters_and_late_answers(spark):
    from pyspark.sql import functions as F

    from tallyspark.operators.guard import answered

    views = {"v": spark.range(20).withColumn("s", F.concat(F.lit("x' or '1'='1"), "id"))}
    assert [r.id for r in answered("select id from v where id = :a or s = :b", views, args={"a": 3, "b": "x' or '1'='15"}, seconds=60)] == [3, 5]
    assert [r.id for r in answered("select id from v where id = ?", views, args=[4], seconds=60)] == [4]
    with pytest.raises(Exception, match="(?i)parameter"):
        answered("select id from v where id = :a", views, args={"b": 1}, seconds=60)
    with pytest.raises(Refused):
        guarded("select id from v where id = :a", views, args={"a": F.expr("1")})
    with pytest.raises(Exception, match="(?i)cancel|interrupt|took more"):
        answered("select sum(id % 7) from w", {"w": spark.range(3 * 10**10)}, seconds=1.0)
