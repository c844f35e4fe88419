"""Markup that is broken, deep or very long, and the tree's entropies against brute force."""

import math
import time
from collections import Counter, defaultdict

import pytest

from tallyspark.llm.site_tree import features, low_branches, main_text

TEXT = "The main text of the page, which is long enough to be one."


@pytest.mark.parametrize(
    "junk", ["<a " * 300_000, "<div>" * 100_000, "<b>" * 50_000 + "<p>x" * 50_000, "<a '" * 100_000, '<a "' * 100_001 + ">", "<iframe>" * 50_000, "<!" * 200_000, "<!--" * 100_000, "</i>" * 100_000, "<" * 500_000, "<ul><li>" * 50_000]
)
def test_awkward_markup_ends_in_time(junk):
    began = time.perf_counter()
    out = main_text(f"<html><body><article><p>{TEXT}</p></article>{junk}")
    assert TEXT in out and time.perf_counter() - began < 20
    features(f"<html><body><article><p>{TEXT}</p>{junk[:200_000]}")


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p title='a > b'>one</p>", "one"), ("<p title='a>one</p>", "one"), ("a < b and c > d", "a < b and c > d"), ("<p>a<!-- x -->b</p>", "ab"), ("<p>a<!-- x", "a"), ("text <b", "text <b"), ("", ""),
        ("<script>if (a < b) '</p>'</script><p>x", "x"), ("<title>t</title><p>x &amp; y", "x & y"), ("<p>x<style>p {}", "x"), ("<P CLASS=x>a<BR/>b</P>c", "a b\n\nc"),
    ],
)
def test_tags_and_quotes(page, text):
    assert main_text(page) == text


def test_low_branches_against_brute_force(spark):
    rows = []
    for i in range(40):
        extra = f"<div class='box'><p>same words</p><span>{['a', 'b'][i % 2]}</span></div>" if i % 3 else "<div class='box'><p>same words</p></div>"
        rows.append((i, "http://h.example/x" if i % 2 else "http://other.example/", f"<body><div class='top'><b>Site</b></div>{extra}<div class='text'><p>Page {i} says {i * i}.</p><p>More of {i}</p></div></body>"))
    pages = spark.createDataFrame([*rows, (99, None, "<p>x</p>"), (100, "http://h.example", None)], "page_id long, url string, html string")
    got = {r["_host"]: set(r["_low"]) for r in low_branches(pages).collect()}
    hosts = defaultdict(list)
    for _, url, html in rows:
        hosts[url.split("/")[2]].append(features(html))
    for host, pages_of in hosts.items():
        nodes, above = defaultdict(list), {}
        for page in pages_of:
            for path, up, shape, texts in page:
                nodes[path].append((shape, set(texts)))
                above[path] = up
        own = {}
        for path, seen in nodes.items():
            m = len(seen)
            if m < 8:
                continue
            shapes = Counter(s for s, _ in seen)
            value = -sum(n / m * math.log(n / m) for n in shapes.values()) / math.log(m)
            texts = Counter(t for _, ts in seen for t in ts)
            if texts:
                entropy = sum(-n * (1 / n) * math.log(1 / n) for n in texts.values()) / len(texts)
                value = max(value, 1 - entropy / math.log(m))
            own[path] = (value, m)
        total = defaultdict(lambda: [0.0, 0.0])
        for path, (value, m) in own.items():
            for d, at in enumerate([path, *above[path][::-1]]):
                total[at][0] += m * 0.9**d * value
                total[at][1] += m * 0.9**d
        assert got.get(host, set()) == {p for p, (x, w) in total.items() if x / w < 0.1}
        assert got[host]


def test_names_of_headings_and_paragraphs_condemn_nothing_inside_an_article():
    from tallyspark.llm.site_tree import main_text

    for inner, text in (('<h2 class="section-header">Heading</h2>', "Heading"), ('<header class="entry-header"><h1>Title</h1></header>', "Title"), ('<p class="market-share">Share</p>', "Share")):
        page = f'<html><body><p class="sidebar">Out</p><article><p>Body of the article.</p>{inner}<div class="share-buttons">Tell all</div><p>More of it.</p></article></body></html>'
        assert main_text(page) == f"Body of the article.\n\n{text}\n\nMore of it."
