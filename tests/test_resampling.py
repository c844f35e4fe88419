"""Strata as a stream against a plain fold, and hashes that are evaluated once."""

import hashlib

from tallyspark.operators.resampling import held_out_strata, replicates


def test_a_stratum_is_no_array_and_is_judged_in_order(spark):
    rows = [(k, None if k % 11 == 0 else f"s{k % 3}", None if k % 17 == 0 else float(k % 23)) for k in range(3000)]
    got = held_out_strata(spark.createDataFrame(rows, "f int, s string, w double"), "f", "s", "w", "salt")
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for s in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.sha256(f"salt:{r[0]}".encode()).hexdigest())
        target, held = 0.3 * sum(r[2] or 0 for r in own), 0.0
        for f, _, w in own:
            want[f, s] = w is not None and abs(held + w - target) < abs(held - target)
            held += w if want[f, s] else 0.0
    assert {(r.f, r.s): r.held_out for r in got.collect()} == want


def test_a_draw_is_hashed_once(spark):
    df = spark.createDataFrame([(k % 4, k % 3 == 0) for k in range(40)], "f int, ok boolean")
    shares = replicates(df, "f", "ok", 200, 7)
    assert shares._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert replicates(df.where("f = 0"), "f", "ok", 200, 7).count() < 200 and all(0 <= r.share <= 1 for r in shares.collect())
