"""Repeated rows and null ids among near duplicates."""

import pytest

from tallyspark.llm.jaccard import similar_components


def _texts():
    body = [f"w{i}" for i in range(100)]
    near = [*body[:50], "changed", *body[51:]]
    return " ".join(body), " ".join(near), " ".join(f"v{i}" for i in range(80)), " ".join(f"u{i}" for i in range(80))


@pytest.mark.parametrize("files", [True, False])
def test_one_row_of_each_group_stays(spark, tmp_path, files):
    import corpus_pipeline as P

    a, b, c, d = _texts()
    rows = [(1, a), (7, c), (7, c), (7, c), (None, b), (None, d), (None, d), (9, a), (9, c + " x " + d), (3, None), (3, None), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long").repartition(3)
    if files:
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    out = P.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] or -1, r["text"] or "") for r in out.collect()))
    assert got == sorted([(1, a), (7, c), (-1, d), (9, c + " x " + d), (3, ""), (3, ""), (-1, ""), (-1, "")])


def test_classes_of_null_keys_link(spark):
    a, b, c, d = _texts()
    docs = spark.createDataFrame([(None, a), (4, b), (5, c), (5, d), (6, d + " more")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in similar_components(docs).collect())
    assert got == [(-1, 98, 4), (4, 98, 4), (5, 78, 5), (5, 78, 5), (6, 79, 5)]
