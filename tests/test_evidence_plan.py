"""What checking drafts sends between tasks, and numbers read from long and odd texts as by plain patterns."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from tallyspark.functions.numbers import extract_numbers
from tallyspark.operators.verifier import check, numbers_match, phrase

ODD = ["1", "23", "456", "7", "00", ".", ",", "-", "+", "%", " ", "  ", "k", "M", " billion", "a", "-point", "3P", "2s", "2001-02", "½", "٣", "é", "x", "1,234", "1234567890123456789012345678901", "\n"]


def shuffles(df):
    return re.findall(r"Exchange hashpartitioning\((.*)", df._jdf.queryExecution().executedPlan().toString())


def frames(spark):
    values = spark.createDataFrame([("x", 2.5, "number", 1, "ppg"), ("x", 0.25, "percent", 1, "share")], "key string, value double, display string, decimals int, column string")
    literals = spark.createDataFrame([("x", "2001-02")], "key string, text string")
    names = spark.createDataFrame([("points per game", "ppg"), ("Share's", "share")], "phrase string, column string")
    return values, literals, names


def test_statements_and_evidence_are_shuffled_once(spark):
    values, literals, names = frames(spark)
    drafts = spark.createDataFrame([("x", "2.5 points per game")], "key string, draft string").repartition(2)
    # The lexicon's own one is of the registry's size.
    assert len([s for s in shuffles(check(drafts, values, literals, names)) if "key#" in s or "at#" in s]) <= 3
    stated = spark.createDataFrame([("x", "2.5", 1, "a")], "key string, value string, decimals int, text string")
    assert len(shuffles(numbers_match(stated, values, "key", ["key", "text"]))) <= 2


def test_a_long_draft(spark):
    values, literals, names = frames(spark)
    text = " ".join(["2.5 points per game, 25.0% share’s, share: 2.5; thousands"] * 300)
    got = check(spark.createDataFrame([("x", text), ("y", "no number but dozens"), ("z", None)], "key string, draft string"), values, literals, names)
    rows = {r.key: r for r in got.collect()}
    assert rows["x"].numbers == 900 and rows["x"].unmatched == ["thousands"] * 300 and rows["x"].mislabelled == ["share: 2.5"] * 300
    assert (rows["y"].numbers, rows["y"].unmatched, rows["y"].ok) == (0, ["dozens"], False) and rows["z"].ok


def test_phrases_of_words_are_phrases(spark):
    words = ["Player's", "a's%b", "%", "x'", "A's's", "B"]
    texts = spark.createDataFrame([(random.Random(k).choices(words, k=3),) for k in range(30)], "w array<string>")
    assert texts.where(phrase(F.array_join("w", " ")) != F.array_join(F.transform("w", phrase), " ")).count() == 0


def test_numbers_as_by_the_plain_pattern():
    number = re.compile(r"(?<![\w.])([+-]?)(\d{1,3}(?:,\d{3})+|\d+)?(\.\d+)?(%?)(?:\s?(k|K|M|bn|thousand|million|billion)\b)?(?!\d)")
    rng = random.Random(3)
    for _ in range(3000):
        text = unicodedata.normalize("NFKC", "".join(rng.choices(ODD, k=rng.randint(0, 9))))
        if re.search(r"\d{4}-\d{2}|-point|3P|2s", text):
            continue
        want = [(m[0].strip(), m.start(), m.end()) for m in number.finditer(text) if m[2] or m[3]]
        assert [(x["text"], x["start"], x["end"]) for x in extract_numbers(text) if not x["exotic"]] == want, text
