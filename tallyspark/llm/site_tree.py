"""Main-text extraction from HTML with a site style tree.

The DOMs of a host's pages are merged: elements with the same path of tags, classes and roles are one node. A node's
presentation importance is the entropy of the child sequences it shows over the pages, its content importance is one less the
mean entropy of its texts over the pages; both are in units of the logarithm of the number of pages, so a branch that is the
same everywhere has importance 0 and one that always differs has 1. The importance of a branch is the mean over its nodes,
weighted by pages and by a factor for each level below. Branches of low importance are cut from every page of the host.

Elements whose role the page itself states (menus, footers, forms and so on, by tag, role, class or id) have importance 0.
All counts are aggregated with partial sums by host and node, so no task sees a whole host.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .site_lines import host_of
from .store import left_join_small, without, written

# Element names of HTML by what they mean for a main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
HIDDEN = RAW | frozenset("head nav footer aside form button select option dialog menu svg canvas object audio video map".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody tfoot thead tr ul caption nav footer aside form".split()
)
CLOSES_P = BLOCK - frozenset("body html tbody tfoot thead tr caption".split())
MAIN = frozenset(["article", "main"])
#: Words of a class, id or role that name a part which is not the main text.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus dialog feedback footer footers form gdpr header headers legal login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promos promotion recommended related reply replies search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets contentinfo complementary alert".split()
)

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_DIGITS = re.compile(r"\d+")
#: What follows these words of a name says what an element has or lacks, not what it is.
_HAS = frozenset("has have no not with without".split())


def _stable(*x: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(x).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: Elements nested deeper become siblings, as in browsers.
DEPTH = 512


#: Elements that are text themselves: inside of an article or main no name condemns them.
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p header blockquote pre figure figcaption li dt dd td th em strong b i q cite code".split())


class Element:
    """path: a hash of what identifies it in the site's tree, 0 for the page; noise: it or something above it is not main text;
    main: it is inside an article or main. stated: its tag or attributes hide it; named: a word of its names does. parts: texts
    and child elements in order."""

    __slots__ = ("tag", "path", "up", "stated", "named", "noise", "main", "parts")

    def __init__(self, tag: str, path: int, up: Element | None, stated: bool, named: bool, main: bool):
        self.tag, self.path, self.up, self.stated, self.named, self.main = tag, path, up, stated, named, main
        self.noise = False
        self.parts: list = []

    def above(self) -> list[int]:
        """The paths of the elements above, the outermost first."""
        out, e = [], self.up
        while e is not None and e.path:
            out.append(e.path)
            e = e.up
        return out[::-1]


def _names(attributes: str) -> list[str]:
    if "=" not in attributes:
        return []
    return [x for m in _NAMES.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").split()]


def _named(names: list[str]) -> bool:
    for x in names:
        for w in _WORD.findall(_CAMEL.sub(r"\1 \2", x).lower()):
            if w in _HAS:
                break
            if w in NOISE:
                return True
    return False


def parse(page: str) -> Element:
    """The page's tree, with its noise marked. Unclosed and stray tags are mended as browsers do in the common cases."""
    root = _parse(page)
    elements = list(_walk(root))
    _mark(elements, True, True)
    if not _has_text(elements):
        _mark(elements, True, False)
        if not _has_text(elements):
            _mark(elements, False, False)
    return root


def _has_text(elements: list[Element]) -> bool:
    return any(not e.noise and any(isinstance(x, str) and not x.isspace() for x in e.parts) for e in elements)


def _mark(elements: list[Element], stated: bool, named: bool) -> None:
    """Sets the noise of all elements (parents first). Names never condemn html, body, main, an article that is in no other, what
    holds a main, what holds half of such articles' text, or, outside of those, most of the page's text; nor, inside of those, headings, paragraphs and the like."""
    size: dict[int, int] = {}
    articles: dict[int, int] = {}
    mains: set[int] = set()
    if named and any(e.named for e in elements):
        nested = set()
        for e in elements:
            if e.tag == "article" or id(e) in nested:
                nested.update(id(x) for x in e.parts if not isinstance(x, str))
        for e in reversed(elements):
            n = a = 0
            for x in e.parts:
                if isinstance(x, str):
                    n += len(x.strip())
                elif not x.stated:
                    n += size[id(x)]
                    a += articles[id(x)]
                    if id(x) in mains:
                        mains.add(id(e))
            if e.tag == "main":
                mains.add(id(e))
            size[id(e)], articles[id(e)] = n, n if e.tag == "article" and id(e) not in nested else a
        total, written_in = size[id(elements[0])], articles[id(elements[0])]
    for e in elements:
        if not e.path:
            e.noise = False
        own = e.noise or e.tag == "head" or (stated and e.stated)
        if named and e.named and not own:
            own = not (
                e.tag in ("html", "body", "main")
                or (e.main and e.tag in TEXT_TAGS)
                or (e.tag == "article" and id(e) not in nested)
                or id(e) in mains
                or 2 * articles[id(e)] >= max(written_in, 1)
                or (not e.main and 2 * size[id(e)] > total)
            )
        e.noise = own
        for x in e.parts:
            if not isinstance(x, str):
                x.noise = own


class _Tokens:
    """Finds the ends of tags in one pass. A tag ends at the first ">" outside of quotes; once a tag has none, quotes count as any
    other character from there on, so no part of a page is searched again and again."""

    def __init__(self, page: str):
        self.page, self.quoted = page, True
        self.unclosed: set[str] = set()

    def end(self, at: int) -> int:
        """The index of the ">" of a tag, or -1."""
        pos = at
        while self.quoted:
            m = _STOP.search(self.page, pos)
            close = -1 if m is None else m.start() if m[0] == ">" else self.page.find(m[0], m.end())
            if close < 0:
                self.quoted = False
            elif m[0] == ">":
                return close
            pos = close + 1
        return self.page.find(">", at)

    def after(self, tag: str, at: int) -> int:
        """The index after the closing tag of a raw element, or -1."""
        if tag in self.unclosed:
            return -1
        close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        if close is None:
            self.unclosed.add(tag)
        return close.end() if close else -1


def _parse(page: str) -> Element:
    root = Element("", 0, None, False, False, False)
    stack, tokens = [root], _Tokens(page)
    at, end = 0, len(page)
    while at < end:
        m = _OPEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.start()
        if m[2] is None:
            close = page.find("-->", m.end()) + 2 if m[0] == "<!--" else page.find(">", m.end())
            if close < 0 or (m[0] == "<!--" and close == 1):
                at = end if m[0] == "<!--" else at
                break
            at = close + 1
            continue
        close = tokens.end(m.end())
        if close < 0:
            break  # no tag ends any more: the rest is text
        at, attributes = close + 1, page[m.end() : close]
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            after = tokens.after(tag, at)
            at = after if after >= 0 else end if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag in CLOSES_P:
            _close(stack, "p", BLOCK - {"p"})
        if tag == "li":
            _close(stack, "li", frozenset(["ul", "ol", "menu"]))
        elif tag in ("dd", "dt"):
            _close(stack, "dd", frozenset(["dl"]))
            _close(stack, "dt", frozenset(["dl"]))
        elif tag in ("td", "th", "tr"):
            for x in ("td", "th", *(["tr"] if tag == "tr" else [])):
                _close(stack, x, frozenset(["table"]))
        up = stack[-1]
        names = _names(attributes)
        main = up.main or tag in MAIN
        stated = tag in HIDDEN or (tag == "header" and not up.main) or re.search(r"\shidden(\s|=|$|/)", f" {attributes.lower()}") is not None
        style = _DIGITS.sub("0", ".".join(sorted(set(names)))).lower()
        own = Element(tag, _stable(str(up.path), tag, style), up, stated, _named(names), main)
        up.parts.append(own)
        if tag not in VOID and not attributes.rstrip().endswith("/") and len(stack) < DEPTH:
            stack.append(own)
    if at < end:
        stack[-1].parts.append(page[at:])
    return root


def _close(stack: list[Element], tag: str, barrier: frozenset[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in barrier:
            return


def _walk(e: Element) -> Iterator[Element]:
    todo = [e]
    while todo:
        x = todo.pop()
        yield x
        todo += [y for y in x.parts if not isinstance(y, str)]


def features(page: str) -> list[tuple[int, list[int], str, list[str]]]:
    """(path, paths above, child sequence, texts) of each node of the page that is not noise by its role."""
    found: dict[int, tuple[Element, set[str], list[str]]] = {}
    for e in _walk(parse(page)):
        if not e.path or e.noise:
            continue
        shape, last = [], None
        texts = []
        for x in e.parts:
            if isinstance(x, str):
                if x.strip():
                    texts.append(" ".join(x.split()))
                continue
            if x.tag != last:  # a run of equal children counts as one
                shape.append(x.tag)
                last = x.tag
        own = found.setdefault(e.path, (e, set(), []))
        own[1].add(" ".join(shape))
        own[2].extend(texts)
    return [(path, e.above(), "|".join(sorted(shapes)), texts) for path, (e, shapes, texts) in found.items()]


def main_text(page: str, low: frozenset[int] = frozenset()) -> str:
    """The blocks of the main text, parted by blank lines, without noise and without the branches at the paths in low: what is
    inside articles if that is at least half of the text in main, or of the page's if it has no main, else main or the page."""
    return _main_text(parse(page), low)


def _inside(root: Element, cut: frozenset[int]) -> str | None:
    """The tag whose elements hold the main text, or None for the whole page."""
    n = {"": 0, "main": 0, "article": 0}
    both = 0  # in an article in main
    todo = [(root, False, False)]
    while todo:
        e, main, article = todo.pop()
        if e.noise or e.path in cut:
            continue
        main, article = main or e.tag == "main", article or e.tag == "article"
        for x in e.parts:
            if isinstance(x, str):
                size = len(x.strip())
                n[""] += size
                n["main"] += size * main
                n["article"] += size * article
                both += size * (main and article)
            else:
                todo.append((x, main, article))
    if n["main"]:
        return "article" if 2 * both >= n["main"] else "main"
    return "article" if n["article"] and 2 * n["article"] >= n[""] else None


def _main_text(root: Element, low: frozenset[int]) -> str:
    for cut in (low, frozenset()):
        inside = _inside(root, cut)
        blocks: list[str] = []
        current: list[str] = []

        def flush(blocks=blocks, current=current) -> None:
            text = " ".join(entities.unescape("".join(current)).split())
            if text:
                blocks.append(text)
            current.clear()

        todo: list = [(root, inside is None)]
        while todo:
            x, within = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                if within:
                    current.append(x)
            elif x.noise or x.path in cut:
                if x.tag in BLOCK:
                    flush()
                elif within:
                    current.append(" ")
            else:
                within = within or x.tag == inside
                block = x.tag in BLOCK
                if block:
                    flush()
                    todo.append((None, within))
                elif x.tag in ("br", "td", "th"):
                    current.append(" ")
                todo += [(y, within) for y in reversed(x.parts)]
        flush()
        if blocks or not low:
            break
    return "\n\n".join(blocks)


_FEATURES = "_host string, _copy long, _node long, _above array<long>, _shape long, _texts array<long>"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            copy = _stable(page)
            for path, above, shape, texts in features(page):
                row = (host, copy, path, above, _stable(shape), sorted({_stable(x) for x in texts}))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["_host", "_copy", "_node", "_above", "_shape", "_texts"])


def low_branches(pages: DataFrame, html: str = "html", url: str = "url", least: float = 0.1, min_pages: int = 8, level: float = 0.9) -> DataFrame:
    """For each host the nodes (_low, hashes of paths) whose branch has an importance under least, judged on min_pages pages
    at least. Byte-equal pages of a host count as one page, so mirrored articles do not look like boilerplate."""
    rows = pages.select(host_of(url).alias("_host"), F.col(html).alias("_html")).where("_host is not null and _html is not null")
    nodes = rows.mapInArrow(_emit, _FEATURES).groupBy("_host", "_copy", "_node").agg(F.first("_above").alias("_above"), F.first("_shape").alias("_shape"), F.first("_texts").alias("_texts"))
    nodes = written(nodes, "nodes")  # so that each page is parsed once for them
    own = nodes.groupBy("_host", "_node", "_shape").agg(F.count("*").alias("n"), F.sum(F.size("_texts")).alias("t"), F.first("_above").alias("_above"))
    pages_of = own.groupBy("_host", "_node").agg(
        F.sum("n").alias("m"), F.sum("t").alias("t"), F.first("_above").alias("_above"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("nlogn")
    )
    texts = nodes.select("_host", "_node", F.explode("_texts").alias("x")).groupBy("_host", "_node", "x").agg(F.count("*").alias("k"))
    content = texts.groupBy("_host", "_node").agg(F.count("*").alias("l"), F.sum(F.log(F.col("k").cast("double"))).alias("logk"))
    m = F.col("m").cast("double")
    known = pages_of.where(F.col("m") >= min_pages).join(content, ["_host", "_node"], "left")
    presentation = (F.log(m) - F.col("nlogn") / m) / F.log(m)
    importance = F.when(F.col("l") > 0, F.greatest(presentation, 1 - F.col("logk") / (F.col("l") * F.log(m)))).otherwise(presentation)
    known = known.select("_host", "_node", "_above", "m", importance.alias("own"))
    up = known.select("_host", "m", "own", F.posexplode(F.reverse(F.concat("_above", F.array("_node")))).alias("d", "_node"))
    weight = F.col("m") * F.pow(F.lit(level), F.col("d"))
    branch = up.groupBy("_host", "_node").agg((F.sum(weight * F.col("own")) / F.sum(weight)).alias("importance"))
    return branch.where(F.col("importance") < least).groupBy("_host").agg(F.collect_list("_node").alias("_low"))


def main_texts(pages: DataFrame, html: str = "html", url: str = "url", **tree) -> DataFrame:
    """Every row of pages (without the html) with text and n_chars, its code points.

    Null html counts as empty and gives an empty text; pages without a host, and hosts with few pages, are judged by the
    stated roles alone; a page from which the tree would cut everything keeps what its roles leave; repeated rows are
    extracted each; columns of pages whose names clash with an added column are replaced.
    """
    base = without(pages, "_host", "_low", "_html", *(x for x in ("text", "n_chars") if x != html))
    low = low_branches(base, html, url, **tree).withColumnRenamed("_host", "_of")
    rest = [f for f in base.schema.fields if f.name.lower() != html.lower()]
    rows = base.select(*(f.name for f in rest), F.col(html).alias("_html"), host_of(url).alias("_host"))
    rows = left_join_small(rows, low, "_host", "_of").drop("_host", "_of")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = []
            for page, nodes in zip(batch.column("_html").to_pylist(), batch.column("_low").to_pylist(), strict=True):
                root = parse(page or "")
                cut: frozenset[int] = frozenset()
                if nodes:
                    cut = known.setdefault(tuple(nodes), frozenset(nodes))
                    if len(known) > 1000:
                        known.clear()
                texts.append(_main_text(root, cut))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in rest), "text", "n_chars"]
            )

    schema = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(extract, schema)
