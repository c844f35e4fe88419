"""Bands retrieve few pairs among many templates, and lose none."""

import numpy as np

from tallyspark.llm.licenses import candidates, license_words, scan_licenses, shingles
from pyspark.sql import functions as F


def test_many_templates_and_few_candidates(spark):
    r = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    wordings = [" ".join(r.choice(vocabulary, int(r.integers(5, 40)))) for _ in range(10_000)]
    templates = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(wordings)] + [("null", None), ("short", "a b c"), ("empty", "")], "license string, template string").repartition(8)
    planted = [(d, int(r.integers(0, 10_000))) for d in range(40)]
    docs = [(d, " ".join(r.choice(vocabulary, 60)) + " " + wordings[t].upper() + ". " + " ".join(r.choice(vocabulary, 60)), "clash") for d, t in planted] + [(900, None, "x"), (901, "", "x")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, license string")
    got = {(x["doc_id"], x["license"]) for x in scan_licenses(docs, templates).collect()}
    assert got == {(d, f"t{t}") for d, t in planted}
    assert {(x["doc_id"], x["license"]) for x in scan_licenses(docs, templates, block_bytes=8_000_000).collect()} == got
    known = templates.where("template is not null").select("license", license_words("template").alias("_t")).withColumn("_shingles", F.array_distinct(shingles("_t"))).where("size(_shingles) > 0")
    known = known.select("license", "_shingles", F.expr("cast(pow(2, ceil(log2(greatest(size(_t), 8)))) as int)").alias("_half"))
    rows = docs.select("doc_id", license_words("text").alias("_t")).where("size(_t) >= 5").select("doc_id", shingles("_t").alias("_s"))
    pairs = candidates(rows, known).select("doc_id", "license", "_k").distinct().count()
    assert len(planted) <= pairs <= 4 * len(planted)  # of 10,000 templates times hundreds of windows
