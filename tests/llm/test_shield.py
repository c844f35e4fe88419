"""Columns of documents that are named like an operator's own go through the pipeline's stages unchanged."""

import corpus_pipeline as P


def test_clashing_columns_stay(spark, tmp_path):
    rows = [(i, " ".join(f"word{(i * 7 + k) % 97}x{i}" for k in range(60)), "en", "s", 300, f"own{i}", i * 2, "mine", None, "a", "b", "c", "d", i) for i in range(70)] + [(None,) * 14]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, n_tokens long, topic string, kept boolean, _lang string, _row string, _host string, _own1 string, own long")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for stage in (P.quality, P.near_duplicates, P.decontaminated, P.mixed):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert {(r["doc_id"], *r[5:]) for r in out.collect()} <= {(r[0], *r[5:]) for r in rows}
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_names_of_an_operator_s_own_change_nothing(spark):
    from tallyspark.llm.mixing import mix
    from tallyspark.llm.site_lines import drop_site_lines
    from pyspark.sql import functions as F

    rows = [(i, f"some words {i} and more", "en" if i % 3 else "de", "s", "x", "y", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _lang string, _source string, own long")
    got = {r.doc_id: r for r in mix(docs).collect()}
    plain = {r.doc_id: r for r in mix(docs.select("doc_id", "text", "lang", "source")).collect()}
    assert all((got[i].probability, got[i].sampled, got[i].weight) == (plain[i].probability, plain[i].sampled, plain[i].weight) and (got[i]["_lang"], got[i]["_source"], got[i].own) == ("x", "y", i) for i in range(60))
    pages = spark.createDataFrame([(i, "h", f"same\nline {i}", "mine", "own") for i in range(8)], "page_id long, site string, body string, _host string, _lines string")
    out = drop_site_lines(pages, F.split("body", "\n"), F.col("site"))
    assert sorted((r.page_id, r.text, r["_host"], r["_lines"]) for r in out.collect()) == [(i, f"line {i}", "mine", "own") for i in range(8)]
