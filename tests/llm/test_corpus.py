"""Shards, licenses, pages, mixing, toxicity, site lines and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm.licenses import TEMPLATES, scan_licenses, templates
from tallyspark.llm.mixing import MARGINS, mix, n_tokens, rake
from tallyspark.llm.sharding import assign_shards, key_bits, write_shards
from tallyspark.llm.site_lines import drop_site_lines, host_of, html_lines
from tallyspark.llm.site_tree import low_branches, main_text, main_texts
from tallyspark.llm.toxicity import Decoder, Letters, held_out, toxicity, trigram_counts

DOCS = "doc_id long, text string, lang string, source string"


def test_shards_fit_and_split_only_where_needed(spark):
    r = np.random.default_rng(4)
    rows = [(i, "x" * int(r.integers(0, 900))) for i in range(600)] + [(9999, None), (None, "null key"), (None, None), (5000, "y" * 30_000)] + [(7, "z" * 700)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    limit = 9000
    out = assign_shards(docs, limit=limit).collect()
    assert len(out) == len(rows)
    size, of = defaultdict(int), defaultdict(set)
    for x in out:
        size[x["shard"]] += x["bytes"]
        of[x["shard"]].add((x["depth"], x["shard_bytes"]))
    assert all(len(v) == 1 and next(iter(v))[1] == size[s] for s, v in of.items())
    assert all(b <= limit for s, b in size.items() if not s.startswith("row-"))
    assert [b for s, b in size.items() if s.startswith("row-")] == [30_000]
    names = [s for s in size if not s.startswith("row-")]
    assert not any(a != b and b.startswith(a) for a in names for b in names)  # a prefix code
    under = lambda p: sum(b for s, b in size.items() if not s.startswith("row-") and s.startswith(p))
    assert all(under(s[:-1]) > limit for s in names if s)  # no bucket was split that fitted
    bits = {x[0]: x[1] for x in docs.select("doc_id", key_bits("doc_id")).distinct().collect()}
    assert all(f"{bits[x['doc_id']]:031b}".startswith(x["shard"][:31]) for x in out if not x["shard"].startswith("row-"))


def test_shards_of_small_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, shard int")
    assert assign_shards(empty).columns == ["doc_id", "bytes", "shard", "depth", "shard_bytes"] and assign_shards(empty).count() == 0
    docs = spark.createDataFrame([(1, "é"), (2, "")], "doc_id long, text string")
    shards = assign_shards(docs)
    assert sorted(map(tuple, shards.collect())) == [(1, 2, "", 0, 2), (2, 0, "", 0, 2)]
    write_shards(docs, shards, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_licenses_are_found_wherever_they_stand(spark):
    r = np.random.default_rng(6)
    noise = lambda n: " ".join(f"n{x}" for x in r.integers(0, 10_000, n))
    rows, want = [(0, None), (1, ""), (2, "the license of the version software")], set()
    for k, (name, text) in enumerate(TEMPLATES.items()):
        for off in (0, 3, 17, 64, 1000):
            i = 100 * (k + 1) + off
            rows.append((i, f"{noise(off)} {text.upper() if off == 3 else text} {noise(50)}"))
            want.add((i, name))
        words = text.split()
        half = len(words) // 2
        if len(words) > 40:  # four fifths are enough, a half is not
            rows += [(9000 + k, " ".join(words[: int(len(words) * 0.9)])), (9500 + k, " ".join(words[:half]))]
            want.add((9000 + k, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = {(x["doc_id"], x["license"]) for x in scan_licenses(docs, templates(spark)).collect()}
    inside = {(i, "Apache-2.0 (line)") for i, n in want if n == "Apache-2.0 (notice)"}
    assert want <= got <= want | inside
    assert scan_licenses(docs, templates(spark, {"none": "short one", "empty": ""})).count() == 0
    assert scan_licenses(docs.where("false"), templates(spark)).count() == 0
    blocks = scan_licenses(docs, templates(spark), block_bytes=20_000)
    assert {(x["doc_id"], x["license"]) for x in blocks.collect()} == got


PAGE = """<!DOCTYPE html><html><head><title>t &amp; t</title><script>var x = "</p><article>";</script></head><body>
<header class="site">Site name</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookieNotice">We use cookies</div>
<aside>Sidebar</aside><main><article id="post-12"><header><h1>A title &eacute;</h1></header><p>First   para<br>graph <b>bold<p>Second
one<!-- hidden <p> --><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><form><button>Go</button></form>
<div class="ad-box">Buy</div><section class="comments"><article>Nice!</article></section></article></main><footer>&copy; x</footer></body>"""


def test_main_text_of_a_page():
    assert main_text(PAGE) == "A title é\n\nFirst para graph bold\n\nSecond one\n\none\n\ntwo\n\na b"
    assert main_text("") == "" and main_text("plain &lt;text&gt;") == "plain <text>"
    assert main_text("<p>a</p><p>b</p><script>unclosed") == "a\n\nb"
    assert main_text("<div>" * 3000 + "deep") == "deep"


def test_the_site_tree_cuts_what_every_page_repeats(spark):
    rows = []
    for i in range(20):
        rows.append((i, f"http://One.example/{i}", f"<html><body><div class=box><p>Same words on all pages</p></div><div class=story><p>Story {i} of many {i * 7}</p><p>More {i}</p></div></body></html>"))
    rows += [(100, "http://two.example/", "<body><p>Alone</p></body>"), (101, None, "<p>No host</p>"), (102, "http://one.example/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    assert [r["_host"] for r in low_branches(pages).collect()] == ["one.example"]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in main_texts(pages).collect()}
    assert got[3] == ("Story 3 of many 21\n\nMore 3", 26)
    assert got[100][0] == "Alone" and got[101][0] == "No host" and got[102] == ("", 0)
    assert main_texts(pages.where("false")).count() == 0


def test_equal_pages_are_not_boilerplate(spark):
    pages = spark.createDataFrame([(i, "http://m.example/a", "<body><article><p>The same article</p></article></body>") for i in range(30)], "page_id long, url string, html string")
    assert {r["text"] for r in main_texts(pages).collect()} == {"The same article"}


def test_site_lines_against_brute_force(spark):
    r = np.random.default_rng(8)
    rows = []
    for i in range(200):
        lines = [f"line {x}" for x in r.zipf(1.3, int(r.integers(0, 12))) if x < 10_000]
        rows.append((i, [None, "http://a.example/1", "https://A.example:80/2", "http://b.example", "http://a.example?x"][i % 5], None if i % 31 == 0 else "<p>" + "</p><p> ".join(lines) + "</p><script>x</script>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    split = {i: [x.strip() for x in re.split(r"<[^>]*>|\n", re.sub(r"<script.*?</script>", "", h or "")) if x.strip()] for i, _, h in rows}
    host = {i: (re.match(r"https?://([^/?#]*)", u)[1].lower() if u else None) for i, u, _ in rows}
    total = Counter(host.values())
    on = Counter((host[i], x) for i in split for x in set(split[i]))
    keep = {i: [x for x in ls if host[i] is None or total[host[i]] < 5 or not (on[host[i], x] > 1 and on[host[i], x] > 0.2 * total[host[i]])] for i, ls in split.items()}
    got = drop_site_lines(pages, html_lines("html"), host_of("url")).collect()
    assert {x["page_id"]: (x["host"], x["n_lines"], x["n_dropped"], x["text"]) for x in got} == {i: (host[i], len(split[i]), len(split[i]) - len(keep[i]), "\n".join(keep[i])) for i in split}
    assert drop_site_lines(pages.where("false"), html_lines("html"), host_of("url")).count() == 0


def brute_rake(tokens, targets, rounds=200):
    w = tokens / tokens.sum()
    for _ in range(rounds):
        for axis, t in enumerate(targets):
            other = tuple(x for x in range(3) if x != axis)
            s = w.sum(other)
            w = w * np.where(s > 0, t / np.where(s > 0, s, 1), 0).reshape([-1 if x == axis else 1 for x in range(3)])
    return w


def test_raking_against_brute_force(spark):
    r = np.random.default_rng(10)
    tokens = r.integers(0, 50, (4, 3, 2)).astype(float)
    targets = [x / x.sum() for x in (r.random(4) + 0.2, r.random(3) + 0.2, r.random(2) + 0.2)]
    cells = spark.createDataFrame([(int(a), int(b), int(c), float(tokens[a, b, c])) for a, b, c in np.ndindex(4, 3, 2)], "a int, b int, c int, tokens double")
    frames = {m: spark.createDataFrame([(k, float(x)) for k, x in enumerate(t)], f"{m} int, target double") for m, t in zip("abc", targets, strict=True)}
    got = {(x["a"], x["b"], x["c"]): x["weight"] for x in rake(cells, frames, rounds=60).collect()}
    want = brute_rake(tokens, targets)
    assert all(abs(got.get(k, 0.0) - want[k]) < 1e-6 for k in np.ndindex(4, 3, 2))


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 50) + ("| x | y" if i % 3 else ""), ["en", "de", None][i // 3 % 3 if i % 7 else 0], "big" if i % 4 else f"s{i % 5}") for i in range(1500)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("weight", F.lit("clash"))
    out = mix(docs, powers=dict.fromkeys(MARGINS, 0.5)).toPandas()
    assert len(out) == len(rows) and out.probability.max() == pytest.approx(1) and (out[out.probability == 0].sampled == 0).all()
    for m in MARGINS:
        sums = out.fillna({m: ""}).groupby(m).n_tokens.sum() ** 0.5
        got = (out.n_tokens * out.probability).groupby(out[m].fillna("")).sum()
        want = (sums / sums.sum())[sums > 0]
        assert np.allclose((got / got.sum())[want.index], want, atol=1e-5)
    share = out.sampled.mean() - out.probability.mean()
    assert abs(share) < 0.05
    assert mix(docs.where("false")).count() == 0
    got = spark.createDataFrame([(" a\x85b  c\n",), (None,), ("",)], "text string").select(n_tokens()).collect()
    assert [r[0] for r in got] == [2, 0, 0]


def test_obfuscated_words_are_restored_and_scored(spark):
    r = np.random.default_rng(11)
    words = ["".join(r.choice(["ra", "ne", "to", "li", "shu", "mo", "ke", "pan", "dri"], int(r.integers(1, 4)))) for _ in range(400)]
    bad = ["vexgrum", "blorfing", "snazik"]
    rows, labels, plain = [], [], []
    for i in range(900):
        own = [str(x) for x in r.choice(words, 40)]
        toxic = i % 6 == 0
        if toxic:
            for b in r.choice(bad, 2, replace=False):
                own[int(r.integers(40))] = str(b)
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
        plain.append(toxic)
    hidden = {2000: "to vexgruuuuum ra", 2001: "li v3xgrum mo", 2002: "ke s n a z i k ne", 2003: "pan 5n4z1k to", 2004: "b l o r f i n g shu"}
    clean = {3000: "ra ne to 100 000 li", 3001: None, 3002: "", 3003: "mo *** ke $$$", 3004: " ".join(words * 50)}
    docs = spark.createDataFrame([*rows, *hidden.items(), *clean.items()], "doc_id long, text string").withColumn("score", F.lit("clash"))
    known = spark.createDataFrame([*labels, (1, None), (77777, 1)], "doc_id long, toxic int")
    out = {x["doc_id"]: x for x in toxicity(docs, known, keep_restored=True).collect()}
    assert len(out) == 910 and all(0 <= x["score"] <= 1 for x in out.values())
    assert all((out[i]["score"] >= 0.7) == plain[i] for i in range(900))
    assert all(out[i]["score"] >= 0.7 for i in hidden) and all(out[i]["score"] < 0.7 for i in clean)
    assert "snazik" in out[2002]["restored"] and out[0]["restored"] is None
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900))
    none = toxicity(docs, known.where("false"))
    assert none.where("score >= 0.7").count() == 0


def test_the_language_model_is_a_law(spark):
    docs = spark.createDataFrame([("abc abd",), (None,), ("",), ("É a",)], "text string")
    counts = trigram_counts(docs).toPandas()
    log = Letters(counts["key"].to_numpy(), counts["n"].to_numpy()).log
    assert np.allclose(np.exp(log.astype(float)).sum(-1), 1, atol=1e-4)
    assert Decoder(log).restore(b"4bc") == b"abc"
    assert docs.select(held_out("text")).count() == 4


def test_the_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline as P

    r = np.random.default_rng(12)
    words = ["".join(chr(97 + x) for x in r.integers(0, 26, int(r.integers(3, 9)))) for _ in range(800)]
    item = " ".join(str(x) for x in r.choice(words, 30))
    rows = []
    for i in range(300):
        own = [str(x) for x in r.choice(words, int(r.integers(60, 200)))]
        rows.append((i, " ".join(own)))
    near = rows[5][1].split()
    near[10] = "changed"
    rows += [(1000, rows[5][1]), (1001, " ".join(near)), (1002, item + " " + " ".join(str(x) for x in r.choice(words, 100))), (1003, "short"), (1004, None), (1005, " ".join(w + "$$$" for w in rows[20][1].split()))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    gone = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{k}")
        before, docs = docs, spark.read.parquet(f"{d}/{k}")
        gone.append({x[0] for x in before.select("doc_id").subtract(docs.select("doc_id")).collect()})
    assert gone[0] == {1003, 1004, 1005} and gone[1] == {1000, 1001} and gone[2] == {1002} and gone[4] == set()
    assert sorted(map(tuple, P.run(spark, d).collect())) == sorted(map(tuple, docs.collect()))


def test_large_lists_are_joined_with_salted_keys(spark, monkeypatch):
    from tallyspark.llm import store

    pages = spark.createDataFrame([(i, "http://a.example/", f"<p>menu</p><p>{i}</p>") for i in range(40)] + [(99, None, "<p>menu</p>")], "page_id long, url string, html string")
    want = sorted(map(tuple, drop_site_lines(pages, html_lines("html"), host_of("url")).collect()))
    monkeypatch.setattr(store, "SMALL_BYTES", 0)
    assert sorted(map(tuple, drop_site_lines(pages, html_lines("html"), host_of("url")).collect())) == want
    assert sum(r[-2] for r in want) == 40
