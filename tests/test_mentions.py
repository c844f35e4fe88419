"""Names in texts against a plain resolver that goes through the words one by one, and similar names against all pairs."""

import random
import re
from itertools import product

import pytest

from tallyspark.operators.entities import QUESTION_WORDS, common_length, distinct_entities, folded, resolve, similar_names


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 200 * plain_common(a, b) / (len(a) + len(b))


def plain(text, entities, aliases):
    """[(at, n, mention, ids, how, ambiguous)] in the order found."""
    known = {(e["kind"], e["id"]): e for e in entities}
    of, kinds = {}, {}
    for a in aliases:
        if (a["kind"], a["id"]) in known:
            of.setdefault(folded(a["alias"]), set()).add((a["kind"], a["id"]))
            kinds.setdefault((folded(a["alias"]), a["kind"], a["id"]), set()).add(a["alias_kind"])
    newest = lambda k: (-(known[k]["recency"] or 0), known[k]["name"], k[1])
    raw = re.findall(r"[A-Za-zÀ-ÿ0-9][\wÀ-ÿ.'’]*", text or "")
    words, used, out = [folded(r) for r in raw], set(), []
    for n in (4, 3, 2, 1):
        for i in range(len(words) - n + 1):
            run = words[i : i + n]
            if used & set(range(i, i + n)) or n == 1 and run[0] in QUESTION_WORDS:
                continue
            span, mention, ids, how = " ".join(run), " ".join(raw[i : i + n]).rstrip("?.,!"), [], None
            named = [k for k in of.get(span, ()) if k[0] == "team" or mention[:1].isupper() or kinds[span, *k] != {"last name"}]
            if named:
                ids = sorted((k for k in named if k[0] == "player"), key=newest) + sorted(k for k in named if k[0] == "team")
                how = "alias" if len(ids) > 1 else min(kinds[span, *ids[0]] - {"last name"}, default="last name")
            elif n <= 2 and raw[i + n - 1][:1].isupper() and (n == 1 or re.fullmatch(r"[a-z]\.?", run[0])):
                ids = sorted((k for k, e in known.items() if k[0] == "player" and e["last"] and folded(e["last"]) == run[-1] and (n == 1 or folded(e["name"]).startswith(run[0][0]))), key=newest)
                ids, how = (ids, "shared name") if len(ids) > 1 else ([], None)
            if not ids and n == 2 and raw[i][:1].isupper() and raw[i + 1][:1].isupper() and not set(run) & set(QUESTION_WORDS):
                close = sorted((-ratio(span, a), a) for a, ks in of.items() if " " in a and any(k[0] == "player" for k in ks) and ratio(span, a) >= 88)
                if close:
                    owners = [k for k in of[close[0][1]] if k[0] == "player"]
                    ids, how = (owners, "fuzzy") if len(owners) == 1 else ([], None)
            if ids:
                out.append((i, n, mention, ids, how, len(ids) > 1))
                used |= set(range(i, i + n))
    return out


def test_common_subsequences():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choices("abcd é", k=rng.randint(0, 70))) for _ in range(2))
        assert common_length(a, b) == plain_common(a, b)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé "])
def test_similar_names_are_all_found(spark, letters):
    rng = random.Random(len(letters))
    names = {"".join(rng.choices(letters, k=rng.randint(0, 16))) for _ in range(70)}
    spans = set()
    for n in names:
        spans.add("".join(c for c in n if rng.random() > 0.07))
        spans.add("".join(c + rng.choice(letters) * (rng.random() < 0.06) for c in n))
    got = similar_names(spark.createDataFrame([(s,) for s in [*spans, None]], "span string"), spark.createDataFrame([(n,) for n in [*names, None]], "name string")).collect()
    want = {(s, n) for s, n in product(spans, names) if len(s) > 1 and len(n) > 1 and ratio(s, n) >= 88}
    assert {(r.span, r.name) for r in got} == want and len(got) == len(want)
    assert all(r.ratio == pytest.approx(ratio(r.span, r.name)) for r in got)


def test_mentions(spark):
    entities = [("player", 11, "Ana Novák", "Novák", 2020), ("player", 13, "Bea Moss", "Moss", 2001), ("player", 22, "Bo Moss", "Moss", None), ("player", 31, "Gus O'Dea", "O'Dea", 1999), ("player", 40, "Will Free", "Free", 3), ("player", 41, "Ana Gulls", None, 3), ("team", 1, "Harbor Gulls", None, None), ("team", 2, "Ana", None, None)]
    aliases = [("player", 11, "Ana Novák", "full name"), ("player", 11, "Novák", "last name"), ("player", 31, "Gus O’Dea", "full name"), ("player", 40, "Will Free", "full name"), ("player", 40, "Free", "last name"), ("player", 13, "Bea Moss", "full name"), ("player", 22, "Bo Moss", "full name"), ("team", 1, "Harbor Gulls", "name"), ("team", 1, "Gulls", "name"), ("player", 41, "Gulls", "nickname"), ("player", 99, "Nobody Here", "full name"), ("team", 2, "The Ana", "name")]
    texts = ["How did Ana Novák and Moss do against the Harbor Gulls?", "moss on stones, B. Moss, b. moss", None, "", "free throws of Free", "Anna Novak vs Gus Odea's best", "Ana-Novak's Gulls", "Bea Mos Bo Moss!", "Who is The Ana", "Nobody Here. Who", "gus o'dea GULLS ana novak novak"]
    ef = spark.createDataFrame(entities, "kind string, id long, name string, last string, recency int")
    af = spark.createDataFrame(aliases, "kind string, id long, alias string, alias_kind string")
    tf = spark.createDataFrame(list(enumerate(texts)), "q int, text string")
    got = resolve(tf, ef, af, "q", "text")
    rows = {}
    for r in got.collect():
        rows.setdefault(r.q, []).append((r.at, r.n, r.mention, [tuple(e) for e in r.ids], r.how, r.ambiguous))
    e, a = ([r.asDict() for r in df.collect()] for df in (ef, af))
    want = {q: plain(t, e, a) for q, t in enumerate(texts)}
    assert {q: sorted(v) for q, v in rows.items()} == {q: sorted(v) for q, v in want.items() if v}
    assert {v[4] for vs in want.values() for v in vs} >= {"full name", "last name", "shared name", "fuzzy", "alias"}
    ids = {(r.q, r.kind): list(r.ids) for r in distinct_entities(got, "q").collect()}
    assert ids[0, "team"] == [1] and ids[10, "player"] == [31, 11]


def test_query_against_the_plain_resolver(spark):
    from tallyspark.plans import names as plans

    t = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    e, a = ([r.asDict() for r in df.collect()] for df in (plans._entities(t), plans._aliases(t)))
    want = {(r.id, at, n, mention, ",".join(f"{k}:{i}" for k, i in ids), how, amb) for r in plans._questions(t).collect() for at, n, mention, ids, how, amb in plain(r.text, e, a)}
    got = plans.entity_resolution(t).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
