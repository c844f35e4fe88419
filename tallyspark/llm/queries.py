"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated, decontaminate
from .jaccard import similar_components
from .leaderboard import sales_feed
from .licenses import TEMPLATES, scan_licenses, templates
from .mixing import mix
from .outliers import estimates, judged, statistics
from .sharding import assign_shards
from .site_lines import EDGES, HIDDEN, HOST, PARTS, drop_site_lines, host_of, html_lines
from .site_tree import main_texts
from .simhash import simhash_components
from .store import table, written
from .substrings import remove_repeats
from .toxicity import toxicity
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes

#: The byte limit of a shard.
SHARD_BYTES = 1_500_000


def op1_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(statistics(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")), "counts")
    return judged(counts, estimates(counts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("clean_text").cast("binary"), 256).alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), limit=SHARD_BYTES)
    return found.select("doc_id", "bytes", "shard", "depth", "shard_bytes")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), templates(spark))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), keep_text=False)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def op10_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return drop_site_lines(pages, html_lines("html"), host_of("url")).select("page_id", "host", "n_lines", "n_dropped", "text")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_feed(*(table(spark, sf_dir, t) for t in ("sale_lines", "items", "vendors")))


QUERIES = {f.__name__: f for f in (op1_outliers, op2_substrings, op3_sharding, op4_licenses, op5_main_text, op6_mixing, op7_jaccard, op8_toxicity, op9_decontaminate, op10_site_lines, op11_simhash, op12_vector_codes, op13_leaderboard)}

#: A word of op9's rule; texts have A-Z lower-cased first.
_WORD9 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TEMPLATE_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())

SQL: dict[str, str] = {
    "op2_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
win AS (SELECT doc_id, p, md5_number(array_to_string(w[p:p + 34], ' ')) g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) p FROM d WHERE len(w) >= 35)),
again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT q) qs FROM (SELECT doc_id, unnest(range(p, p + 35)) q FROM win SEMI JOIN again USING (g)) GROUP BY 1),
words AS (SELECT doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) q FROM d),
out AS (SELECT doc_id, unnest(qs) q FROM gone),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) t, count(*) n FROM words ANTI JOIN out USING (doc_id, q) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(t, '')) kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD9}') w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD9}') w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(len(w), 13) n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
win AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, p, grams.n FROM win JOIN grams USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT q) n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) q FROM hits) GROUP BY 1),
of AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item_id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN of USING (doc_id)""",
    "op3_sharding": f"""
WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) b, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) >> 1 h FROM documents),
fits AS (SELECT * FROM d WHERE b <= {SHARD_BYTES}),
sums AS (SELECT k, h >> (31 - k) p, sum(b) s FROM fits, (SELECT unnest(range(0, 25)) k) GROUP BY 1, 2),
placed AS (SELECT doc_id, b, h, min(k) k FROM fits JOIN sums ON h >> (31 - k) = p WHERE s <= {SHARD_BYTES} GROUP BY 1, 2, 3)
SELECT doc_id, b "bytes", CASE WHEN placed.k = 0 THEN '' ELSE lpad(bin(p), CAST(placed.k AS INTEGER), '0') END shard, CAST(placed.k AS INTEGER) depth, CAST(s AS BIGINT) shard_bytes
FROM placed JOIN sums ON sums.k = placed.k AND p = h >> (31 - placed.k)""",
    "op4_licenses": rf"""
WITH t AS (SELECT license, list_filter(string_split_regex({_LOWER.format("template")}, '{_BREAKS}'), lambda x: x <> '') w FROM (VALUES {_TEMPLATE_ROWS}) v(license, template)),
ts AS (SELECT license, half, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) s
  FROM (SELECT *, CAST(pow(2, ceil(log2(greatest(len(w), 8)))) AS BIGINT) half FROM t) WHERE len(w) >= 5),
d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '{_BREAKS}'), lambda x: x <> '') w FROM documents),
ds AS (SELECT doc_id, len(w) n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) s FROM d WHERE len(w) >= 5),
win AS (SELECT doc_id, n, half, k, s[k * half + 1:k * half + greatest(2 * half - 4, 1)] s
  FROM (SELECT doc_id, n, s, half, unnest(range(0, len(s) // half + 1)) k FROM ds, (SELECT DISTINCT half FROM ts)) WHERE k * half < len(s)),
hit AS (SELECT doc_id, license, k, k * half window_start, least(2 * half, n - k * half) window_words, len(list_intersect(ts.s, win.s)) shared, len(ts.s) total FROM win JOIN ts USING (half)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY shared DESC, k) rn FROM hit WHERE shared >= 0.8 * total)
SELECT doc_id, license, CAST(window_start AS BIGINT) window_start, CAST(window_words AS BIGINT) window_words, CAST(shared AS BIGINT) shared, shared / total containment FROM best WHERE rn = 1""",
    "op7_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[p:p + 2], ' ')) g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
df AS (SELECT g, count(*) f FROM s GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f NULLS FIRST, g) k FROM s JOIN n USING (doc_id) LEFT JOIN df USING (g)),
pre AS (SELECT doc_id, g FROM r WHERE 10 * (k - 1) <= n),
cand AS (SELECT DISTINCT a.doc_id x, b.doc_id y FROM pre a JOIN pre b USING (g) WHERE a.doc_id < b.doc_id),
links AS (SELECT x, y FROM cand JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND b.g = a.g JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y
  GROUP BY x, y, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
e AS (SELECT x u, y v FROM links UNION SELECT y, x FROM links),
c AS (SELECT doc_id, doc_id root FROM d UNION SELECT e.v, c.root FROM c JOIN e ON e.u = c.doc_id WHERE c.root < e.v)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) component_id FROM c GROUP BY 1) USING (doc_id)""",
    "op10_site_lines": rf"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') host,
  list_filter(list_transform(string_split_regex(regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g'), '{PARTS}'), lambda x: regexp_replace(x, '{EDGES}', '', 'g')), lambda x: x <> '') l FROM pages),
total AS (SELECT host, count(*) n FROM p WHERE host IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
common AS (SELECT host, line FROM (SELECT host, unnest(list_distinct(l)) line FROM p WHERE host IS NOT NULL) JOIN total USING (host)
  GROUP BY host, line, n HAVING count(*) > 1 AND count(*) > 0.2 * n),
lists AS (SELECT host, list(line) c FROM common GROUP BY 1),
kept AS (SELECT page_id, p.host, l, list_filter(l, lambda x: c IS NULL OR NOT list_contains(c, x)) k FROM p LEFT JOIN lists ON p.host = lists.host)
SELECT page_id, host, CAST(len(l) AS BIGINT) n_lines, CAST(len(l) - len(k) AS BIGINT) n_dropped, coalesce(array_to_string(k, chr(10)), '') AS "text" FROM kept""",
}


def _vector_codes_sql() -> str:
    """Each round is two tables: the nearest entry of every part, and the entries that follow."""
    number = f"list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE)))"
    steps = [
        f"k AS (SELECT vec_id, label, {number} v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, j, v[j * (len(v) // {PARTS}) + 1:(j + 1) * (len(v) // {PARTS})] x FROM k, (SELECT unnest(range({PARTS})) j))",
        f"c0 AS (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 e, x FROM p QUALIFY e < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, label, p.j, p.x, e, list_inner_product(c.x, c.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(p.x, p.x) d FROM p JOIN c{r} c ON p.j = c.j
  QUALIFY row_number() OVER (PARTITION BY vec_id, p.j ORDER BY d, e) = 1)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT j, e, list(v ORDER BY i) x FROM (SELECT j, e, i, floor(sum(x[i]) / count(*)) v FROM (SELECT j, e, x, unnest(range(1, len(x) + 1)) i FROM a{r}) GROUP BY ALL) GROUP BY ALL)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, c.e, coalesce(m.x, c.x) x FROM c{r} c LEFT JOIN m{r} m ON m.j = c.j AND m.e = c.e)")
    steps.append(f"""f AS (SELECT vec_id, any_value(label) label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY j) code, CAST(sum(d) AS BIGINT) error FROM a{ROUNDS} GROUP BY vec_id)""")
    steps.append(f"h AS (SELECT sha256(string_agg(t, ',' ORDER BY j, e)) s FROM (SELECT j, e, array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',') t FROM c{ROUNDS}))")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error, s codebooks_sha256 FROM f, h"


SQL["op12_vector_codes"] = _vector_codes_sql()

#: The checksum is computed byte by byte with the usual table, which SQL makes from the polynomial.
SQL["op13_leaderboard"] = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) t),
l AS (SELECT *, coalesce(CAST(sale_id AS VARCHAR), '') || ',' || coalesce(CAST(item_id AS VARCHAR), '') || ',' || coalesce(CAST(vendor_id AS VARCHAR), '') || ',' || coalesce(CAST(line_no AS VARCHAR), '') k FROM sale_lines),
h AS (SELECT l.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) h FROM l, crc),
c AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END a FROM (SELECT *, coalesce(date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)), 19723 + h % 150) s FROM h)),
n AS (SELECT *, CAST(least(10, greatest(1, 1 + floor((a - 19723) * 10 / 180))) AS INTEGER) b FROM c),
m AS (SELECT b, max(s) m FROM n GROUP BY b),
late AS (SELECT x.b, max(y.m) top FROM m x LEFT JOIN m y ON y.b < x.b GROUP BY x.b),
k AS (SELECT nation_id, n.item_id, a, sum((CASE WHEN flag = 'swapped' THEN -1 ELSE 1 END) * coalesce(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0)) v
  FROM n JOIN late ON late.b = n.b JOIN items ON items.item_id = n.item_id JOIN vendors ON vendors.vendor_id = n.vendor_id WHERE nation_id IS NOT NULL AND (top IS NULL OR s + 3 >= top) GROUP BY ALL),
run AS (SELECT nation_id, item_id, a, sum(v) OVER w r, coalesce(lead(a) OVER w, 999999) z FROM k WINDOW w AS (PARTITION BY nation_id, item_id ORDER BY a)),
d AS (SELECT nation_id, a, lag(a) OVER (PARTITION BY nation_id ORDER BY a) p FROM (SELECT DISTINCT nation_id, a FROM k)),
board AS (SELECT d.nation_id, d.a, item_id, row_number() OVER (PARTITION BY d.nation_id, d.a ORDER BY r DESC, item_id) place FROM d JOIN run ON run.nation_id = d.nation_id AND run.a <= d.a AND d.a < z WHERE r > 0 QUALIFY place <= 10),
old AS (SELECT d.nation_id, d.a, item_id, place FROM d JOIN board ON board.nation_id = d.nation_id AND board.a = d.p),
e AS (SELECT coalesce(x.nation_id, y.nation_id) nation_id, coalesce(x.a, y.a) a, coalesce(x.item_id, y.item_id) item_id, y.place o, x.place w
  FROM board x FULL JOIN old y ON x.nation_id = y.nation_id AND x.a = y.a AND x.item_id = y.item_id WHERE x.place IS DISTINCT FROM y.place)
SELECT CAST(e.nation_id AS INTEGER) nation_id, CAST(e.a AS BIGINT) arrival_day, CAST(e.item_id AS BIGINT) item_id, CAST(least(10, greatest(1, 1 + floor((e.a - 19723) * 10 / 180))) AS INTEGER) batch,
  CASE WHEN o IS NULL THEN 'enter' WHEN w IS NULL THEN 'exit' ELSE 'move' END change, CAST(o AS INTEGER) old_rank, CAST(w AS INTEGER) new_rank, CAST(r AS BIGINT) revenue
FROM e JOIN run ON run.nation_id = e.nation_id AND run.item_id = e.item_id AND run.a <= e.a AND e.a < z"""
