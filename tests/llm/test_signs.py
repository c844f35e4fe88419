"""Obfuscated words at whose end the sign stands, and doubled letters."""

import numpy as np

from tallyspark.llm.toxicity import toxicity


def test_signs_at_the_end_and_doubled_letters_are_restored(spark):
    r = np.random.default_rng(11)
    words = ["".join(r.choice(["ra", "ne", "to", "li", "shu", "mo", "ke", "pan", "dri"], int(r.integers(1, 4)))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        own = [str(x) for x in r.choice(words, 40)]
        if i % 6 == 0:
            for b in r.choice(["vexgrut", "blorfis", "snazupik"], 2, replace=False):
                own[int(r.integers(40))] = str(b)
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 6 == 0)))
    hidden = {2000: "to vexgru7 ra", 2001: "li vexgru7. mo", 2002: "ke blorfi$ ne", 2003: "pan snazuupik to", 2004: "shu blorfi5"}
    clean = {3000: "ra ne 7 to 5", 3001: "mo mo7 ke $ li", 3002: "ra! ne. to- li*"}
    docs = spark.createDataFrame([*rows, *hidden.items(), *clean.items()], "doc_id long, text string")
    out = {x["doc_id"]: x["score"] for x in toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(out[i] >= 0.7 for i in hidden) and all(out[i] < 0.7 for i in clean)
    assert all((out[i] >= 0.7) == (i % 6 == 0) for i in range(900))
