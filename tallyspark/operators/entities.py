"""Names in texts: to entities, to a question where several are meant, or to the one name that a misspelling resembles.

Every run of up to four words is looked up at once, by equi-joins on distinct runs: exact aliases, last names that several share, and,
for two capitalised words, a similarity join (deletion neighbourhoods, then the exact ratio). Which hits stand is an
ordered fold in each text: longer runs first, then from left to right, none over another.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST = 4
#: Least ratio (100 x twice the longest common subsequence over both lengths) of a misspelling.
LEAST_RATIO = 88
#: Ways to leave out letters of a text that are listed, beyond which its parts are; letters of a text beyond which pairs of letters are compared.
WAYS, LONG = 300, 40
# Words of questions that are no names, and how words of a text are told apart.
QUESTION_WORDS = (
    "how", "what", "who", "which", "when", "where", "why", "is", "are", "was", "were", "does", "did", "do", "has", "have", "compare", "show", "list", "give", "tell", "explain", "predict", "should",
    "between", "among", "nba", "the", "in", "of", "and", "or", "vs", "versus", "a",
)
_TOKEN = re.compile(r"[A-Za-zÀ-ÿ0-9][\wÀ-ÿ.'’]*")
_POSSESSIVE = re.compile(r"'s\b|'(?=\s|$)")


def folded(text: str) -> str:
    """How names are compared: no accents, lower case, no possessives, hyphens as spaces, no punctuation at the ends."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    plain = _POSSESSIVE.sub("", plain.lower().translate(str.maketrans("’-", "' ")))
    return " ".join(plain.split()).strip(' .,?!:;"')


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else folded(x))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("raw", T.StringType()), T.StructField("word", T.StringType())])))
def _words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: [{"raw": w, "word": folded(w)} for w in _TOKEN.findall(x or "")])


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, by one machine word's arithmetic for each letter of b."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    open_, whole = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        both = open_ & at.get(c, 0)
        open_ = (open_ + both | open_ - both) & whole
    return len(a) - open_.bit_count()


def _merged(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join by merging: keys and lists of names are many times larger in memory than their compressed files, by which Spark
    judges whether a side is small enough to go through the driver to all executors."""
    return rows.join(other.hint("merge"), on, how)


@F.pandas_udf(T.IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def _grams(names: DataFrame, name: str) -> DataFrame:
    """name and its pairs of neighbouring letters, numbered where one comes again (g, k)."""
    each = names.select(name, F.explode(F.expr(f"transform(sequence(1, length({name}) - 1), i -> substr({name}, i, 2))")).alias("gram"))
    counted = each.groupBy(name, "gram").agg(F.count("*").alias("n"))
    return counted.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.struct("gram", k.alias("k")))).alias("g"))


def _prefixes(names: DataFrame, name: str, common: DataFrame) -> DataFrame:
    """The rarest pairs of letters of each name, of which two names of the least ratio must share one. Names of l letters that are so
    similar are at most d = 3 l / 11 insertions and deletions apart, each of which changes two pairs at most, so they share all but 2 d of them."""
    rare = _merged(_grams(names, name), common, "g", "left").select(name, F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g").alias("g"))
    most = 2 * F.expr(f"(3 * length({name})) div 11") + 1
    first = rare.groupBy(name).agg(F.array_sort(F.collect_list("g")).alias("gs"))
    return first.select(name, F.explode(F.slice("gs", F.lit(1), most)).alias("g")).select(name, F.col("g.g").alias("g"))


def _left_out(text: str, n: int) -> Iterator[str]:
    return map("".join, combinations(text, len(text) - n))


@cache
def _meeting(long: int, first: bool) -> tuple[tuple[int, ...], tuple[tuple[int, int, bool, str], ...]]:
    """How many letters a text of so many is listed without, and which of its parts are listed: begin, end, whether without one letter, and the mark of the part."""
    whole, parts = set(), set()
    for other in range(2, LONG + 1):
        la, lb = (long, other) if first else (other, long)
        d = (100 - LEAST_RATIO) * (la + lb) // 100
        d -= (d - la - lb) % 2
        if d < abs(la - lb):
            continue
        da, db = (d + la - lb) // 2, (d - la + lb) // 2
        if max(comb(la, da), comb(lb, db)) <= WAYS:
            whole.add(da if first else db)
            continue
        k = d // 2 + 1
        for i in range(k):
            begin, end = la * i // k, la * (i + 1) // k
            n, mark = end - begin, f"{la}/{i}/"
            if first:
                parts.update((begin, end, less, mark) for less in {False, da > 0})
                continue
            for size in range(n - (da > 0), n + (db > 0) + 1):
                starts = [0] if i == 0 else [lb - size] if i == k - 1 else range(max(0, begin - da), min(begin + db, lb - size) + 1)
                parts.update((at, at + size, size > n, mark) for at in starts)
    return tuple(whole), tuple(parts)


def meeting_keys(text: str, first: bool) -> set[str]:
    """Keys of which a first text and a second one, of LONG letters at most, share one if their ratio is LEAST_RATIO or more.

    Texts of la and lb letters are so similar if d letters at most, da of the first and db of the second, are in one of them only. What
    is left of both is the same then: a key, if there are few ways to leave out so many. Else the first text is cut into d div 2 + 1
    parts, one of which has one letter at most in which it and its part of the second text differ, wherever that begins.
    """
    whole, parts = _meeting(len(text), first)
    keys = {x for n in whole for x in _left_out(text, n)}
    for begin, end, less, mark in parts:
        part = text[begin:end]
        if less:
            keys.update([mark + part[:k] + part[k + 1 :] for k in range(len(part))])
        else:
            keys.add(mark + part)
    return keys


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """The rows in as many tasks as shuffles have: names and questions are so short that few files hold them all, and their work is many times their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*by))


def _keyed(texts: DataFrame, text: str, first: bool) -> DataFrame:
    """text and a hash of each of its meeting keys (key)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                own = batch.column(0).slice(begin, 1000)
                found = [meeting_keys(x, first) for x in own.to_pylist()]
                at = pa.array([k for k, f in enumerate(found) for _ in range(len(f))], pa.int32())
                yield pa.RecordBatch.from_arrays([own.take(at), pa.array([x for f in found for x in f], pa.string())], names=[text, "key"])

    return _dealt(texts.select(text), text).mapInArrow(keys, f"`{text}` string, key string").select(text, F.xxhash64("key").alias("key"))


def similar_names(spans: DataFrame, names: DataFrame, span: str = "span", name: str = "name", least: int = LEAST_RATIO) -> DataFrame:
    """span, name and ratio of all pairs of distinct texts whose ratio is at least `least` (88 or more). Both need two letters; nulls are left out."""
    if least < LEAST_RATIO:
        raise ValueError(f"the filters hold from {LEAST_RATIO}")
    a, b = (df.select(c).where(F.length(c) > 1).distinct() for df, c in ((spans, span), (names, name)))
    short = _merged(_keyed(a.where(F.length(span) <= LONG), span, True), _keyed(b.where(F.length(name) <= LONG), name, False), "key").select(span, name)
    # Texts of more letters would have too many keys; what resembles one of them has 32 letters or more.
    c, d = (df.where(F.length(x) > LONG * LEAST_RATIO // (200 - LEAST_RATIO)) for df, x in ((a, span), (b, name)))
    common = _grams(d, name).groupBy("g").agg(F.count("*").alias("f"))
    long = _merged(_prefixes(c, span, common), _prefixes(d, name, common), "g").select(span, name).where(F.greatest(F.length(span), F.length(name)) > LONG)
    both = F.length(span) + F.length(name)
    room = (100 - least) * both  # in hundredths of letters that may be only in one of them
    met = short.unionByName(long).where(100 * F.abs(F.length(span) - F.length(name)) <= room)
    near = met.where(100 * F.levenshtein(span, name) <= room).distinct()
    ratio = 200 * _common(span, name) / both
    return near.select(span, name, ratio.alias("ratio")).where(F.col("ratio") >= least)


def spans_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Every run of one to four words: key, at, n, span (as names are compared), mention, first (its first word), and whether it
    begins with a capital, ends with a word that does, and has a question word."""
    words = _dealt(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").select("key", _words("text").alias("w"))
    runs = words.select("key", "w", F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("n")).where(F.col("n") <= F.size("w"))
    runs = runs.select("key", "n", F.posexplode(F.expr("transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))")).alias("at", "r"))
    upper = lambda c: c.rlike(r"^\p{Lu}")
    mention = F.rtrim(F.array_join("r.raw", " "), F.lit("?.,!"))
    return runs.select(
        "key", "at", "n", F.array_join("r.word", " ").alias("span"), mention.alias("mention"), F.col("r.word")[0].alias("first"), F.element_at("r.word", -1).alias("last"), upper(mention).alias("capital"),
        upper(F.element_at("r.raw", -1)).alias("last_capital"), upper(F.col("r.raw")[0]).alias("first_capital"), F.arrays_overlap("r.word", F.array(*map(F.lit, QUESTION_WORDS))).alias("asks"),
    )


def _cover(hits: Column) -> Column:
    """Of hits (n, at, ...) those that stand: longer ones first, from left to right, none over one that stands."""
    ordered = F.array_sort(hits, lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).otherwise(a["at"] - b["at"]))
    free = lambda taken, h: ~F.exists(taken, lambda t: (t["at"] < h["at"] + h["n"]) & (h["at"] < t["at"] + t["n"]))
    return F.aggregate(ordered, F.slice(hits, 1, 0), lambda taken, h: F.when(free(taken, h), F.concat(taken, F.array(h))).otherwise(taken))


def resolve(texts: DataFrame, entities: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, n, mention, ids (kind and id of each entity meant), how and ambiguous, for every mention that stands.

    entities: kind ('player' or 'team'), id, name, last (null for teams), recency. aliases: kind, id, alias, alias_kind; those of
    entities that are not there are left out. A mention is an alias ('last name' aliases only with a capital), else a last name, with or
    without an initial, that several players share ('shared name', only where its last word has a capital), else, of two
    capitalised words, a misspelling of one player's alias of several words ('fuzzy': the most similar alias, of equal ones the
    first by name, if one player has it). Several entities are ambiguous: ids then lists players from the newest, then by name, then
    teams by id. A question word alone is no mention. Texts are told apart by key; null and empty ones have no mentions.
    """
    known = _dealt(_merged(aliases, entities.select("kind", "id", "name", "recency"), ["kind", "id"]), "kind", "id")
    rank = (F.when(F.col("kind") == "player", 0).otherwise(1), F.when(F.col("kind") == "player", -F.coalesce("recency", F.lit(0))).otherwise(0), F.when(F.col("kind") == "player", F.col("name")), F.col("id"))
    entity = F.struct(*(c.alias(f"r{k}") for k, c in enumerate(rank)), "kind", "id")
    owners = known.groupBy(fold("alias").alias("span"), "kind", "id").agg(F.min(entity).alias("e"), F.min(F.when(F.col("alias_kind") != "last name", F.col("alias_kind"))).alias("how"))
    exact = owners.groupBy("span").agg(F.array_sort(F.collect_list(F.struct("e", "how"))).alias("owners"))
    lasts = _dealt(entities.where("kind = 'player' and last is not null and last <> ''"), "kind", "id").withColumns({"last": fold("last"), "letter": F.substring(fold("name"), 1, 1)})
    shared = lasts.groupBy("last").agg(F.array_sort(F.collect_list(F.struct(entity.alias("e"), "letter"))).alias("sharing"))

    found = _merged(spans_of(texts, key, text).where("span <> '' and not (n = 1 and asks)"), exact, "span", "left")
    found = _merged(found, shared.where(F.size("sharing") > 1), "last", "left")
    fit = F.filter("owners", lambda o: F.col("capital") | o["how"].isNotNull() | (o["e"]["kind"] == "team"))
    alike = F.filter("sharing", lambda s: (F.col("n") == 1) | (s["letter"] == F.substring("first", 1, 1)))
    initial = (F.col("n") == 1) | ((F.col("n") == 2) & F.col("first").rlike(r"^[a-z]\.?$"))
    found = found.withColumns({"fit": fit, "alike": F.when(initial & F.col("last_capital"), alike)})
    found = found.withColumn("candidate", (F.col("n") == 2) & F.col("first_capital") & F.col("last_capital") & ~F.col("asks"))
    plain = F.when(F.size("fit") > 0, F.transform("fit", lambda o: o["e"])).when(F.size("alike") > 1, F.transform("alike", lambda s: s["e"]))
    how = F.when(F.size("fit") == 1, F.coalesce(F.get("fit", F.lit(0))["how"], F.lit("last name"))).when(F.size("fit") > 1, "alias").when(F.size("alike") > 1, "shared name")
    found = found.withColumns({"es": plain, "how": how}).drop("owners", "sharing", "fit", "alike")

    players = owners.where("kind = 'player' and instr(span, ' ') > 0").groupBy(F.col("span").alias("name")).agg(F.count("*").alias("owned"), F.min("e").alias("e"))
    misspelt = similar_names(found.where("es is null and candidate").select("span"), players.select("name"))
    best = misspelt.groupBy("span").agg(F.min(F.struct(-F.col("ratio"), F.col("name"))).alias("b")).select("span", F.col("b.name").alias("name"))
    fuzzy = _merged(best, players.where("owned = 1"), "name").select("span", F.col("e").alias("resembles"))
    hits = _merged(found, fuzzy, "span", "left").where(F.col("es").isNotNull() | (F.col("candidate") & F.col("resembles").isNotNull()))
    hit = F.struct("n", "at", "mention", F.coalesce("es", F.array("resembles")).alias("es"), F.coalesce("how", F.lit("fuzzy")).alias("how"))
    stands = hits.groupBy("key").agg(F.collect_list(hit).alias("hits")).select("key", F.explode(_cover(F.col("hits"))).alias("h"))
    ids = F.transform("h.es", lambda e: F.struct(e["kind"].alias("kind"), e["id"].alias("id")))
    return stands.select(F.col("key").alias(key), F.col("h.at").alias("at"), F.col("h.n").alias("n"), F.col("h.mention").alias("mention"), ids.alias("ids"), F.col("h.how").alias("how"), (F.size("h.es") > 1).alias("ambiguous"))


def distinct_entities(mentions: DataFrame, key: str) -> DataFrame:
    """key, kind and ids: the entities that are meant without doubt, each once, in the order of their first mention."""
    each = mentions.where(~F.col("ambiguous")).select(F.col(key).alias("_key"), F.struct(-F.col("n"), F.col("at")).alias("_at"), F.col("ids")[0].alias("e"))
    first = each.groupBy("_key", F.col("e.kind").alias("kind"), F.col("e.id").alias("_id")).agg(F.min("_at").alias("_at"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_id"))), lambda x: x["_id"])
    return first.groupBy("_key", "kind").agg(ids.alias("ids")).withColumnRenamed("_key", key)
