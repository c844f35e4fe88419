"""Text retrieval, number extraction, conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import numbers_in
from ..operators.followup import carry_over as carry_over_turns
from ..operators.guard import guarded
from ..operators.retrieval import bm25, carried, nearest, reciprocal_rank
from .base import query

_QUERY = "thing reer onthe erti the"


@query(
    f"""WITH d AS (SELECT doc_id id, regexp_extract_all(lower(text), '[a-z0-9]+') w FROM documents), t AS (SELECT id, unnest(w) term FROM d),
q AS (SELECT DISTINCT unnest(regexp_extract_all('{_QUERY}', '[a-z0-9]+')) term), n AS (SELECT count(*) n, avg(len(w)) mean FROM d), tf AS (SELECT id, term, count(*) tf FROM t SEMI JOIN q USING (term) GROUP BY 1, 2),
df AS (SELECT term, count(*) f FROM tf GROUP BY 1), s AS (SELECT tf.id, round(sum(ln(1 + (n - f + 0.5) / (f + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))), 6) score FROM tf JOIN df USING (term) JOIN d ON d.id = tf.id, n GROUP BY 1)
SELECT id doc_id, score FROM s ORDER BY score DESC, id DESC LIMIT 10"""
)
def bm25_topk(t):
    return bm25(t("documents"), "doc_id", "text", _QUERY).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), F.desc("doc_id")).limit(10)


_PROBE = "WITH q AS (SELECT embedding p FROM embeddings WHERE vec_id = 7), d AS (SELECT vec_id, label, round(sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: pow(CAST(embedding[i] AS DOUBLE) - CAST(p[i] AS DOUBLE), 2)))), 6) distance FROM embeddings, q)"


@query(_PROBE + " SELECT vec_id, distance FROM d WHERE label <> 3 ORDER BY distance, vec_id LIMIT 10")
def dense_topk(t):
    """Exact nearest neighbours of a stored vector, with a filter before the search."""
    vectors = t("embeddings")
    probe = [float(x) for x in vectors.where("vec_id = 7").first()["embedding"]]
    return nearest(vectors.where("label <> 3"), "vec_id", "embedding", probe, 10).select("vec_id", "distance")


@query(_PROBE + ", a AS (SELECT vec_id, row_number() OVER (ORDER BY distance, vec_id) - 1 r FROM d QUALIFY r < 20), b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 r FROM d QUALIFY r < 20) SELECT vec_id id, round(sum(1.0 / (60 + r + 1)), 9) score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY score DESC, id LIMIT 25")
def rrf_fuse(t):
    vectors = t("embeddings")
    probe = [float(x) for x in vectors.where("vec_id = 7").first()["embedding"]]
    near = nearest(vectors, "vec_id", "embedding", probe, 20).select(F.col("vec_id").alias("id"), F.col("distance").alias("by"))
    first = vectors.select(F.col("vec_id").alias("id"), F.col("vec_id").cast("double").alias("by")).orderBy("by").limit(20)
    return reciprocal_rank([near, first], "id", "by", 25).select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(25)


@query(
    "WITH r AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND len(text) > 40 THEN turn END topic FROM conversations) SELECT conv_id, turn, last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) topic FROM r"
)
def carry_over(t):
    """What an earlier turn named stands until a later one names something else."""
    rows = t("conversations").withColumn("topic", F.when((F.col("role") == "user") & (F.length("text") > 40), F.col("turn")))
    return carried(rows, "conv_id", "turn", "topic").select("conv_id", "turn", "topic")


_LETTER = r"[^\p{L}\p{N}_"
_AMOUNT = rf"{_LETTER}.]([+-]?)((?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+)(%?)(?:\s?(k|K|M|bn|thousand|million|billion)\b)?"


@query(
    rf"""WITH d AS (SELECT doc_id, ' ' || coalesce(text, '') t FROM documents),
a AS (SELECT doc_id, t, regexp_replace(regexp_replace(t, '(^|{_LETTER}.-])([0-9]{{4}}-[0-9]{{2}}(?:-[0-9]{{2}})?)({_LETTER}-]|$)', '\1 \3', 'g'), '(^|{_LETTER}.-])(?i:[0-9]+-point(?:er)?s?\b|[23]P[TMA%]?\b|[23]s\b)', '\1 ', 'g') rest FROM d),
m AS (SELECT doc_id, regexp_extract(piece, '{_AMOUNT}', ['sign', 'n', 'pct', 'scale']) g FROM (SELECT doc_id, unnest(regexp_extract_all(rest, '{_AMOUNT}')) piece FROM a)),
v AS (SELECT doc_id, g, CAST(CASE WHEN g.sign = '-' THEN '-' ELSE '' END || replace(g.n, ',', '') AS DECIMAL(36, 6)) * CASE WHEN g.scale IN ('k', 'K', 'thousand') THEN 1000 WHEN g.scale IN ('M', 'million') THEN 1000000 WHEN g.scale IN ('bn', 'billion') THEN 1000000000 ELSE 1 END x FROM m)
SELECT doc_id, CASE WHEN x = 0 THEN '0' ELSE rtrim(rtrim(CAST(x AS VARCHAR), '0'), '.') END AS "value", CAST(CASE WHEN g.scale <> '' OR NOT contains(g.n, '.') THEN 0 ELSE len(g.n) - instr(g.n, '.') END AS INTEGER) decimals, g.pct = '%' percent, false token, false exotic FROM v
UNION ALL SELECT doc_id, NULL, 0, false, true, false FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{_LETTER}.-]([0-9]{{4}}-[0-9]{{2}}(?:-[0-9]{{2}})?)(?:{_LETTER}-]|$)', 1)) FROM d)
UNION ALL SELECT doc_id, NULL, 0, false, false, true FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(t, '\p{{N}}'), lambda c: NOT regexp_matches(c, '[0-9]'))) FROM d)"""
)
def numbers_extract(t):
    """The numbers, seasons and dates that each text states."""
    return t("documents").select("doc_id", F.explode(numbers_in("text")).alias("number")).select("doc_id", *(f"number.{c}" for c in ("value", "decimals", "percent", "token", "exotic")))


@query("SELECT o_orderstatus, count(*) n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 100")
def guard_select(t):
    """An ad-hoc query over an allowed relation, capped at 100 rows."""
    return guarded("select o_orderstatus, count(*) as n from games_view group by 1 order by 1", {"games_view": t("orders")})


#: The turns of users, with what stands in for names, times, arguments and results: long capitalised words of the question and of the reply.
_TURNS = """u AS (SELECT conv_id, turn, coalesce(text, '') q, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') a, role FROM conversations),
t AS (SELECT conv_id, turn, q, list_sort(list_distinct(regexp_extract_all(q, '[A-Z][a-z]{9,}')))[:2] players, list_sort(list_distinct(regexp_extract_all(q, '[A-Z][a-z]{8}[ .,]')))[:1] teams, len(q) % 11 = 0 ambiguous, CASE WHEN len(q) % 4 = 0 THEN CAST(1990 + len(q) % 30 AS VARCHAR) END season, len(q) % 7 = 0 several_seasons,
  CASE WHEN len(q) % 6 = 0 THEN 'playoffs' END season_type, len(q) % 5 = 0 phrase, CASE WHEN len(q) % 10 = 0 THEN '2001' END arg_season, CASE WHEN len(q) % 9 = 0 THEN 'regular' END arg_season_type, CASE WHEN len(q) % 8 = 0 THEN 'm' || len(q) END metric,
  list_sort(list_distinct(regexp_extract_all(a, '[A-Z][a-z]{8,}')))[:2] result_players, list_sort(list_distinct(regexp_extract_all(a, '[A-Z][a-z]{7}[ .,]')))[:1] result_teams FROM u WHERE role = 'user')"""
_NEAR = r"[^\p{L}\p{N}_]"


def user_turns(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t("conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), F.coalesce("text", F.lit("")).alias("question"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("a"), "role").where("role = 'user'")
    n = F.length("question")
    some = lambda text, pattern, most: F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))), 1, most)
    return rows.select(
        "conv_id", "turn", "question", some("question", "[A-Z][a-z]{9,}", 2).alias("players"), some("question", "[A-Z][a-z]{8}[ .,]", 1).alias("teams"), (n % 11 == 0).alias("ambiguous"), F.when(n % 4 == 0, (1990 + n % 30).cast("string")).alias("season"),
        (n % 7 == 0).alias("several_seasons"), F.when(n % 6 == 0, "playoffs").alias("season_type"), (n % 5 == 0).alias("phrase"), F.when(n % 10 == 0, "2001").alias("arg_season"), F.when(n % 9 == 0, "regular").alias("arg_season_type"),
        F.when(n % 8 == 0, F.concat(F.lit("m"), n)).alias("metric"), some("a", "[A-Z][a-z]{8,}", 2).alias("result_players"), some("a", "[A-Z][a-z]{7}[ .,]", 1).alias("result_teams"),
    )


@query(
    rf"""WITH {_TURNS},
f AS (SELECT *, regexp_matches(' ' || q || ' ', '(?i){_NEAR}(he|him|his|he''s|himself){_NEAR}') he, regexp_matches(' ' || q || ' ', '(?i){_NEAR}(they|them|their|they''re){_NEAR}') they, regexp_matches(' ' || q || ' ', '(?i){_NEAR}(both|each|either|the two|those two|them){_NEAR}') several,
  regexp_matches(q || ' ', '(?i)^\s*(and|what about|how about|and what about|compare that|over|in the|what''s their|what is their|how many has|how many did){_NEAR}') OR len(regexp_extract_all(q, '\S+')) <= 5 follows,
  coalesce(lag(result_players) OVER w, []) lp, coalesce(lag(result_teams) OVER w, []) lt FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT *, CASE WHEN len(players) > 0 THEN players WHEN NOT ambiguous AND he AND (len(lp) = 1 OR len(lp) > 1 AND several) THEN lp END dp, CASE WHEN len(teams) > 0 THEN teams WHEN NOT ambiguous AND they AND len(lt) > 0 THEN lt END dt FROM f),
s AS (SELECT *, coalesce(last_value(dp IGNORE NULLS) OVER b, []) sp, coalesce(last_value(dt IGNORE NULLS) OVER b, []) st, last_value(coalesce(arg_season, season) IGNORE NULLS) OVER b ss, last_value(coalesce(arg_season_type, season_type) IGNORE NULLS) OVER b sk, last_value(metric IGNORE NULLS) OVER c m
  FROM d WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, CASE WHEN len(lp) > 0 THEN lp ELSE sp END pool, CASE WHEN len(lt) > 0 THEN lt ELSE st END tpool FROM s),
x AS (SELECT *, CASE WHEN ambiguous OR len(players) > 0 THEN 'own' WHEN he AND (len(pool) = 1 OR len(pool) > 1 AND several) THEN 'pronoun' WHEN he AND len(pool) > 1 THEN 'unclear' WHEN he THEN 'own' WHEN len(teams) = 0 AND len(sp) > 0 AND follows THEN 'follow' ELSE 'own' END pw FROM p),
y AS (SELECT *, CASE pw WHEN 'pronoun' THEN pool WHEN 'follow' THEN sp ELSE players END cp FROM x),
z AS (SELECT *, CASE WHEN ambiguous OR len(teams) > 0 THEN 'own' WHEN they AND len(tpool) > 0 THEN 'pronoun' WHEN len(cp) = 0 AND len(st) > 0 AND follows THEN 'follow' ELSE 'own' END tw FROM y)
SELECT conv_id, turn, array_to_string(cp, '|') players, array_to_string(CASE tw WHEN 'pronoun' THEN tpool WHEN 'follow' THEN st ELSE teams END, '|') teams, CASE WHEN season IS NULL AND NOT several_seasons THEN ss ELSE season END season,
  CASE WHEN season_type IS NULL AND NOT phrase THEN sk ELSE season_type END season_type, m metric, array_to_string(list_filter([CASE WHEN pw IN ('pronoun', 'follow') THEN 'players' END, CASE WHEN tw <> 'own' THEN 'teams' END, CASE WHEN season IS NULL AND NOT several_seasons AND ss IS NOT NULL THEN 'season' END,
  CASE WHEN season_type IS NULL AND NOT phrase AND sk IS NOT NULL THEN 'season_type' END], lambda c: c IS NOT NULL), '|') carried, CASE WHEN pw = 'unclear' THEN array_to_string(pool, '|') END candidates FROM z"""
)
def follow_ups(t):
    """What each turn of a user means after what was said before."""
    found = carry_over_turns(user_turns(t), "conv_id")
    joined = {c: F.array_join(c, "|").alias(c) for c in ("players", "teams", "carried", "candidates")}
    return found.select("conv_id", "turn", *(joined.get(c, c) for c in ("players", "teams", "season", "season_type", "metric", "carried", "candidates")))
