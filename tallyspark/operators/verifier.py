"""No number without evidence: every number of a draft must state a result, an argument or a cited text, under the right name.

Statements meet evidence by an equi-join: a value is emitted under every number that it may be stated as (its rounding; a percentage
also as a fraction with two more decimals), as exact text, so nothing is compared in pairs. The evidence of a key for one number is one row,
so a statement meets one row at most. Names beside a number are looked up in the row itself, and only where a wrong one would matter, against
one map of phrases, whose size is that of the registry. A draft is read once, by one Arrow UDF; only the words beside a number go on with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import numbers_in, read_in, rounded_key

#: Words after a number, and before a colon, in which a name is sought.
AFTER, BEFORE = 5, 6
# Where a window ends, what a name before a colon is, words for quantities without digits.
_WINDOW = r"^[^\d,.;:!?()]*"
_COLON = r"([A-Za-z][A-Za-z %'-]{0,40}):\s*$"
_QUANTITY = r"(?i)(?<![\d.,])(?<![\d.,]\s)\b(dozens?|hundreds?|thousands?|millions?|billions?)\b"
_WORD = r"[A-Za-z%][A-Za-z%']*"


def _ways(values: DataFrame, key: str, *more: str) -> DataFrame:
    """statable() with repeated rows."""
    value, decimals = F.col("value"), F.col("decimals")
    as_number = F.struct(value.alias("v"), decimals.alias("d"))
    as_percent = F.array(F.struct((value * 100).alias("v"), decimals.alias("d")), F.struct(value.alias("v"), (decimals + 2).alias("d")))
    real = values.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(1e31)))
    way = F.explode(F.when(F.col("display") == "percent", as_percent).otherwise(F.array(as_number))).alias("w")
    ways = real.select(key, way, *more)
    return ways.select(key, rounded_key(F.col("w.v"), F.col("w.d")).alias("number"), F.col("w.d").alias("most"), *more).where("number is not null")


def statable(values: DataFrame, key: str, *more: str) -> DataFrame:
    """key, number (as numbers.canonical), most (decimals at most) and the columns more, for every way in which a value may be stated.
    values: key, value (double), display ('number' or 'percent', whose value is a fraction), decimals. Null and not finite values cannot be stated."""
    return _ways(values, key, *more).distinct()


def numbers_match(stated: DataFrame, values: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """keep, and matched: whether the row's number (value and decimals, as extract_numbers() has them) states one of its key's values. Rows of
    stated are told apart by keep."""
    ways = _ways(values, key).groupBy(F.col(key).alias("_key"), F.col("number").alias("_number")).agg(F.max("most").alias("_most"))
    met = stated.join(ways, (F.col(key) == F.col("_key")) & (F.col("value") == F.col("_number")), "left")
    # keep tells key and value, so these change no group; with them the rows lie as the join has dealt them.
    own = list(dict.fromkeys([key, "value", *keep]))
    return met.groupBy(*own).agg(F.coalesce(F.max(F.col("decimals") <= F.col("_most")), F.lit(False)).alias("_matched")).select(*keep, F.col("_matched").alias("matched"))


def phrase(text: Column) -> Column:
    """A name as the map of phrases has it: lower case, no hyphens and possessives, single spaces."""
    plain = F.translate(F.lower(text), "-’", " '")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"'s\b", ""), r"\s+", " "))


def lexicon(names: DataFrame) -> DataFrame:
    """One row with the map phrase -> columns that it can mean (names: phrase, column) and the longest phrase's number of words. The
    map has a registry's size."""
    each = names.select(phrase(F.col("phrase")).alias("p"), "column").groupBy("p").agg(F.array_sort(F.collect_set("column")).alias("c"))
    return each.agg(F.map_from_entries(F.collect_list(F.struct("p", "c"))).alias("_names"), F.coalesce(F.max(F.size(F.split("p", " "))), F.lit(0)).alias("_longest"))


def _given(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), for which value is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words_of(window: Column, most: int) -> Column:
    """The first words of the window."""
    return F.slice(F.regexp_extract_all(window, F.lit(_WORD), F.lit(0)), 1, most)


def first_name(words: Column, most: int) -> Column:
    """(raw, columns) of the first phrase of the map among the words (most at most), the longest at each word; null if there is none.
    Phrases of two letters count in capitals only."""
    spans = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i in range(1, most + 1) for n in range(most - i + 1, 0, -1)))

    def at(w: Column) -> Column:
        inside = F.filter(spans, lambda s: (s["n"] <= F.col("_longest")) & (s["i"] + s["n"] - 1 <= F.size(w)))
        # No word has a space or a hyphen, so the phrase of several words is their phrases in a row.
        named = F.transform(inside, lambda s: _given(F.array_join(F.slice(w["p"], s["i"], s["n"]), " "), lambda p: F.struct(s.alias("s"), p.alias("p"), F.element_at("_names", p).alias("columns"))))
        known = F.filter(named, lambda x: x["columns"].isNotNull())
        raw = F.transform(known, lambda x: F.struct(F.array_join(F.slice(w["raw"], x["s"]["i"], x["s"]["n"]), " ").alias("raw"), x["p"].alias("p"), x["columns"].alias("columns")))
        fit = F.filter(raw, lambda x: (F.length(F.replace(x["p"], F.lit(" "), F.lit(""))) > 2) | (x["raw"] == F.upper(x["raw"])))
        return F.get(F.transform(fit, lambda x: F.struct(x["raw"].alias("raw"), x["columns"].alias("columns"))), F.lit(0))

    return _given(F.transform(words, lambda w: F.struct(w.alias("raw"), phrase(w).alias("p"))), at)


def _literal(s: Column) -> Column:
    """What a mention is allowed by when an argument or a cited text has it: the same season or date, or the same size."""
    return F.when(s["token"], F.concat(F.lit("t"), s["text"])).otherwise(F.concat(F.lit("v"), F.ltrim(F.coalesce(s["value"], F.lit("0")), F.lit("-"))))


def check(drafts: DataFrame, values: DataFrame, literals: DataFrame, names: DataFrame, key: str = "key") -> DataFrame:
    """For every draft: key, ok, numbers, unmatched and mislabelled (texts, in the draft's order, words for quantities last).

    drafts: key and draft, one row a key; a null draft states nothing. values: key, value, display, decimals, column (null if it has no
    name). literals: key and text: resolved arguments and cited texts. names: phrase and column. A number is mislabelled if the
    words beside it name a metric and none that has this value; an empty lexicon finds none.
    """
    read = drafts.select(key, read_in("draft").alias("r"))
    said = read.select(key, F.col("r.text").alias("draft"), F.posexplode_outer("r.found").alias("at", "s"))
    after = words_of(F.regexp_extract(F.expr("substr(draft, s.end + 1)"), _WINDOW, 0), AFTER)
    head = F.expr("substr(draft, 1, s.start)")
    before = words_of(F.when(head.rlike(r":\s*$"), F.regexp_extract(head, _COLON, 1)), BEFORE)
    quantities = F.when(F.coalesce("at", F.lit(0)) == 0, F.regexp_extract_all("draft", F.lit(_QUANTITY), F.lit(1)))
    said = said.select(
        key, "at", F.col("s.text").alias("text"), F.col("s.value").alias("value"), F.col("s.decimals").alias("decimals"), F.col("s").isNotNull().alias("stated"),
        F.when(~F.col("s.exotic"), _literal(F.col("s"))).alias("literal"), after.alias("after"), before.alias("before"), quantities.alias("quantities"),
    )
    # What a literal allows, and what states a value, under the same text: a number's is its size.
    ways = _ways(values, key, "column").select(F.col(key).alias("_key"), F.concat(F.lit("v"), F.ltrim("number", F.lit("-"))).alias("_literal"), F.struct("number", "most", "column").alias("_way"))
    allowed = literals.select(F.col(key).alias("_key"), F.explode(numbers_in("text")).alias("a")).select("_key", _literal(F.col("a")).alias("_literal"), F.lit(None).cast(ways.schema["_way"].dataType).alias("_way"))
    evidence = ways.unionByName(allowed).groupBy("_key", "_literal").agg(F.collect_set("_way").alias("_ways"), F.count(F.when(F.col("_way").isNull(), 1)).alias("_allowed"))
    met = said.join(evidence, (F.col(key) == F.col("_key")) & (F.col("literal") == F.col("_literal")), "left")
    met = met.withColumn("hits", F.filter(F.coalesce("_ways", F.array().cast(evidence.schema["_ways"].dataType)), lambda w: (w["number"] == F.col("value")) & (F.col("decimals") <= w["most"])))
    met = met.withColumns({"hit": F.size("hits") > 0, "columns": F.transform("hits", lambda w: w["column"])}).crossJoin(F.broadcast(lexicon(names)))
    # A value without a name is under any name right.
    told = F.col("hit") & ~F.exists("columns", lambda c: c.isNull())
    named = met.withColumn("after", F.when(told, first_name(F.col("after"), AFTER)))
    named = named.withColumn("before", F.when(told & F.col("after").isNull(), first_name(F.col("before"), BEFORE)))
    strange = lambda c: ~F.arrays_overlap(F.col(f"{c}.columns"), F.col("columns"))
    wrong = F.when(F.col("after").isNotNull(), F.when(strange("after"), F.concat_ws(" ", "text", "after.raw"))).when(F.col("before").isNotNull() & strange("before"), F.concat(F.col("before.raw"), F.lit(": "), F.col("text")))
    missing = F.col("stated") & ~F.col("hit") & (F.coalesce("_allowed", F.lit(0)) == 0)
    judged = named.select(key, "at", "stated", "quantities", F.when(missing, F.col("text")).alias("no"), wrong.alias("wrong"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", c)))), lambda x: x[c])
    found = judged.groupBy(key).agg(F.any_value("quantities", True).alias("quantities"), F.count(F.when(F.col("stated"), 1)).alias("numbers"), ordered("no").alias("no"), ordered("wrong").alias("mislabelled"))
    return found.select(key, "numbers", F.concat("no", "quantities").alias("unmatched"), "mislabelled").select(key, ((F.size("unmatched") == 0) & (F.size("mislabelled") == 0)).alias("ok"), "numbers", "unmatched", "mislabelled")


def problems(checked: DataFrame, key: str = "key") -> DataFrame:
    """key, kind ('unmatched' or 'mislabelled') and what: a row for each number that may not be shown."""
    of = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("what")))
    each = F.concat(of("unmatched"), of("mislabelled"))
    return checked.select(key, F.explode(each).alias("p")).select(key, "p.*")


def finalized(first: DataFrame, retry: DataFrame, fallback: DataFrame, values: DataFrame, literals: DataFrame, names: DataFrame, key: str = "key") -> DataFrame:
    """key, text and status: the first draft if it is verified, else the second one if that is ('regenerated'), else the fallback, which
    is made of results only. retry is needed for keys whose first draft failed; others are not checked again."""
    one = first.join(check(first, values, literals, names, key).select(key, F.col("ok").alias("_one")), key)
    again = retry.join(one.where(~F.col("_one")).select(key), key, "left_semi")
    two = again.join(check(again, values, literals, names, key).select(key, F.col("ok").alias("_two")), key).select(key, F.col("draft").alias("_draft"), "_two")
    rows = one.join(two, key, "left").join(fallback.select(key, F.col("text").alias("_fallback")), key, "left")
    status = F.when(F.col("_one"), "verified").when(F.col("_two"), "regenerated").otherwise("fallback")
    return rows.select(key, F.when(F.col("_one"), F.col("draft")).when(F.col("_two"), F.col("_draft")).otherwise(F.col("_fallback")).alias("text"), status.alias("status"))
