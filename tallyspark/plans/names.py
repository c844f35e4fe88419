"""Names of vendors and nations in questions made from them, and misspelt names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.entities import distinct_entities, resolve, similar_names
from .base import query


def _vendors(t):
    name = F.regexp_replace("name", " Jr$", "")
    rows = t("vendors").where("name is not null").select(F.col("vendor_id").alias("id"), "name", F.element_at(F.split(name, " "), -1).alias("last"), (F.col("vendor_id") % 7).alias("recency"), "nation_id")
    return rows


def _entities(t):
    players = _vendors(t).select(F.lit("player").alias("kind"), "id", "name", "last", "recency")
    teams = t("nation").select(F.lit("team").alias("kind"), F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("last"), F.lit(0).cast("bigint").alias("recency"))
    return players.unionByName(teams)


def _aliases(t):
    """Full names, last names of one vendor alone, first letters with the last name, and nations by name and by number."""
    v = _vendors(t)
    alone = v.groupBy("last").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("id", F.col("last").alias("alias"), F.lit("last name").alias("alias_kind"))
    full = v.select("id", F.col("name").alias("alias"), F.lit("full name").alias("alias_kind"))
    nick = v.where("id % 5 = 0").select("id", F.concat(F.substring("name", 1, 3), F.lit("-"), F.col("last")).alias("alias"), F.lit("nickname").alias("alias_kind"))
    teams = t("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.explode(F.array("n_name", F.concat(F.lit("Nation "), "n_nationkey"))).alias("alias"), F.lit("name").alias("alias_kind"))
    return full.unionByName(alone).unionByName(nick).withColumn("kind", F.lit("player")).unionByName(teams.withColumn("kind", F.lit("team")))


def _questions(t):
    """A question for every vendor, in one of seven forms: names as they are, misspelt, in part, in lower case, with initials."""
    text = F.expr("""case id % 7
      when 0 then concat('How many did ', name, ' have in Nation ', nation_id, '?')
      when 1 then concat('What about ', substr(name, 1, 3), substr(name, 5), '’s games?')
      when 2 then concat('Compare ', last, ' and ', name, ', ', name)
      when 3 then concat('show ', lower(name), ' vs ', lower(last), ' in NATION_', nation_id)
      when 4 then concat(substr(name, 1, 1), '. ', last, ' or ', last, '-', last, '!')
      when 5 then concat('Is ', substr(name, 1, 3), '-', last, ' in Nation ', nation_id, ' with ', substr(name, 2), '?')
      else concat(upper(name), ' ', reverse(name), ' The ', last) end""")
    return _vendors(t).select("id", text.alias("text"))


@query()
def entity_resolution(t):
    """Every mention of a vendor or nation in the questions."""
    found = resolve(_questions(t), _entities(t), _aliases(t), "id", "text")
    return found.select("id", "at", "n", "mention", F.array_join(F.transform("ids", lambda e: F.concat_ws(":", e["kind"], e["id"])), ",").alias("ids"), "how", "ambiguous")


@query()
def entity_ids(t):
    """The vendors and nations of each question that are meant without doubt, in order."""
    return distinct_entities(resolve(_questions(t), _entities(t), _aliases(t), "id", "text"), "id").select("id", "kind", F.array_join("ids", ",").alias("ids"))


@query(
    """WITH n AS (SELECT DISTINCT name FROM (SELECT lower(name) name FROM clients UNION ALL SELECT lower(name) FROM vendors) WHERE len(name) > 1),
s AS (SELECT DISTINCT substr(name, 1, 3) || substr(name, 5) span FROM (SELECT lower(name) name FROM vendors) WHERE len(name) > 4),
p AS (SELECT span, name FROM s JOIN n ON 100 * abs(len(span) - len(name)) <= 12 * (len(span) + len(name)) AND len(list_intersect(string_split(span, ''), string_split(name, ''))) >= len(list_distinct(string_split(span, ''))) - 4),
l AS (SELECT span, name, list_last(list_reduce(list_prepend(list_transform(range(len(name) + 1), lambda x: 0), list_transform(string_split(span, ''), lambda c: [unicode(c)])), lambda row, c:
  list_reduce(list_prepend([0], list_transform(range(1, len(name) + 1), lambda j: [j])), lambda acc, j: list_append(acc, CASE WHEN unicode(name[j[1]]) = c[1] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], acc[len(acc)]) END)))) common FROM p)
SELECT span, name, CAST(round(200 * common / (len(span) + len(name)), 6) AS DOUBLE) ratio FROM l WHERE 200 * common >= 88 * (len(span) + len(name))"""
)
def fuzzy_names(t):
    """Names of clients and vendors that a misspelt vendor's name resembles."""
    names = t("clients").select(F.lower("name").alias("name")).unionByName(t("vendors").select(F.lower("name").alias("name")))
    spans = t("vendors").select(F.lower("name").alias("name")).where(F.length("name") > 4).select(F.expr("concat(substr(name, 1, 3), substr(name, 5))").alias("span"))
    return similar_names(spans, names).select("span", "name", F.round("ratio", 6).alias("ratio"))
