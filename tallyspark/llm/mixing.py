"""Mixing sources to target weights by iterative proportional fitting.

The tokens of each cell (source, language, topic) are raked until the sums by source, by language and by topic all meet their
targets; each document is then sampled with a probability in proportion to its cell's factor. Documents are aggregated to
cells once; all rounds work on the small table of cells. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import SMALL_BYTES, forget, is_small, written

MARGINS = ("source", "lang", "topic")
ADDED = ("n_tokens", "topic", "weight", "probability", "sampled")
#: Denominator of the uniform draw.
_DRAWS = 1 << 53


def n_tokens(text: str = "text") -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def surface_topic(text: str = "text") -> Column:
    """What kind of text it is by its surface: the documents state no topic, and this stands in for one."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(t.contains("icensed under") | t.contains("Released under"), "licensed").when(t.contains(" | "), "listing").when(t.rlike(r"[#*$%&]{3}"), "symbols").when(t.rlike("@|[0-9]{3}"), "contact")
        .when(F.length(t) < 600, "note").otherwise("prose")
    )


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """A target share for each value of a margin: its share of the tokens to a power, made to sum to 1."""
    sums = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("p"))
    return sums.join(sums.agg(F.sum("p").alias("all"))).select(margin, (F.col("p") / F.col("all")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 200, tolerance: float = 1e-9, gathered: int = 20_000) -> DataFrame:
    """cells (the margins and tokens) with weight: shares of tokens, fitted to the targets (margin value, target; summing to 1).

    Cells without tokens are left out. Values without a target get weight 0. Rounds end when no margin is off by more than the
    tolerance; targets that no table can meet end after so many rounds, with a warning and the last margin exact. Up to
    `gathered` cells all rounds are one expression over one row; more cells stay a table, and a round is a job.
    """
    cells = cells.where("tokens > 0")
    for margin, target in targets.items():
        cells = cells.join(target.withColumnRenamed("target", f"{margin}_target"), margin, "left").fillna(0.0, [f"{margin}_target"])
    cells = written(cells, "cells")
    weights, off = _raked_row(cells, list(targets), rounds, tolerance) if cells.limit(gathered + 1).count() <= gathered else _raked_table(cells, list(targets), rounds, tolerance)
    if off is not None and off > tolerance:
        warnings.warn(f"after {rounds} rounds a margin is still off by {off:.3g}", stacklevel=2)
    return weights.select(*targets, "tokens", "weight")


def _raked_row(cells: DataFrame, margins: list[str], rounds: int, tolerance: float) -> tuple[DataFrame, float | None]:
    one = cells.groupBy().agg(F.array_sort(F.collect_list(F.struct(*margins, "tokens", *(f"{m}_target" for m in margins)))).alias("c")).where("size(c) > 0")
    for k, m in enumerate(margins):
        one = one.withColumn("v", F.expr(f"array_distinct(transform(c, x -> x.`{m}`))"))
        one = one.withColumn(f"of{k}", F.expr(f"transform(c, x -> cast(array_position(v, x.`{m}`) - 1 as int))"))
        one = one.withColumn(f"at{k}", F.expr(f"transform(v, (x, k) -> filter(sequence(0, size(c) - 1), i -> of{k}[i] = k))"))
        one = one.withColumn(f"to{k}", F.expr(f"transform(at{k}, x -> c[x[0]].`{m}_target`)"))
    body = "named_struct('w', s.w, 'off', 0D)"
    for k in range(len(margins)):
        # x: the state; f: a factor for each value of the margin
        factors = f"transform(at{k}, (p, j) -> coalesce(to{k}[j] / nullif(aggregate(p, 0D, (t, i) -> t + x.w[i]), 0D), 0D))"
        scaled = f"named_struct('w', transform(of{k}, (j, i) -> x.w[i] * f[j]), 'off', greatest(x.off, array_max(transform(filter(f, y -> y > 0), y -> abs(y - 1)))))"
        body = f"transform(array({body}), x -> transform(array({factors}), f -> {scaled})[0])[0]"
    start = "named_struct('w', transform(c, x -> x.tokens / aggregate(c, 0D, (t, y) -> t + y.tokens)), 'off', double('infinity'))"
    fitted = written(one.withColumn("s", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, r) -> case when s.off <= {tolerance} then s else {body} end)")).select("c", "s"), "weights")
    off = fitted.select("s.off").first()
    return fitted.select(F.explode(F.arrays_zip("c", F.col("s.w").alias("w"))).alias("x")).select(*(F.col("x.c")[m].alias(m) for m in margins), F.col("x.c.tokens").alias("tokens"), F.col("x.w").alias("weight")), off and off[0]


def _raked_table(cells: DataFrame, margins: list[str], rounds: int, tolerance: float) -> tuple[DataFrame, float | None]:
    weights = written(cells.join(F.broadcast(cells.groupBy().agg(F.sum("tokens").alias("all"))), F.lit(True)).withColumn("weight", F.col("tokens") / F.col("all")).drop("all"), "weights")
    for _ in range(rounds):
        step = weights.withColumn("off", F.lit(0.0))
        for m in margins:
            target = F.first(f"{m}_target")
            factor = step.groupBy(m).agg(F.coalesce(target / F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(0.0)).alias("factor"))
            x = F.when(F.col("factor") > 0, F.abs(F.col("factor") - 1)).otherwise(0.0)
            step = step.join(factor, m).withColumns({"weight": F.col("weight") * F.col("factor"), "off": F.greatest("off", x)}).drop("factor")
        before, weights = weights, written(step, "weights")
        forget(before)
        off = weights.agg(F.max("off")).first()[0]
        if off is None or off <= tolerance:
            break
    return weights, off


def mix(
    docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, key: str = "doc_id", text: str = "text", topic: Column | None = None, seed: int = 7, keep_text: bool = True
) -> DataFrame:
    """Every row of docs (without the text unless keep_text) with n_tokens, topic, weight (its cell's factor), probability and
    sampled.

    targets gives target shares by margin; without them the observed shares are tempered by powers. A document's probability
    is its cell's factor (fitted over observed tokens) over the largest factor, so the expected tokens of the sample meet
    all three targets; the draw is a hash of the key and the seed, so repeated rows share it. Null and empty sources,
    languages and keys count as one value. Texts without words have no weight of their own but are drawn like their cell;
    rows of cells without any token have probability 0. Columns whose names clash with an added column are replaced.
    Without the text, each text is read once; with it, the counts are taken twice and no text is written between.
    """
    powers = powers or dict.fromkeys(MARGINS, 0.9)
    kept = [c for c in docs.columns if c.lower() not in ADDED and (keep_text or c != text)]
    own = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(None)
    named = docs.select(own.alias("own"), F.col(key).cast("string").alias("drawn"), "source", "lang", n_tokens(text).alias("n_tokens"), (surface_topic(text) if topic is None else topic).alias("topic"))
    if not keep_text:
        named = written(named, "counted")
    values = [F.coalesce(F.col(m).cast("string"), F.lit("")).alias(f"_{m}") for m in MARGINS]
    cells = named.select(*values, "n_tokens").groupBy(*(f"_{m}" for m in MARGINS)).agg(F.sum("n_tokens").cast("double").alias("tokens"))
    cells = written(cells, "cells")
    wanted = {f"_{m}": targets[m].select(F.coalesce(F.col(m).cast("string"), F.lit("")).alias(f"_{m}"), "target") if targets else tempered(cells, f"_{m}", powers[m]) for m in MARGINS}
    fitted = rake(cells, wanted)
    all_tokens = fitted.agg(F.sum("tokens")).first()[0] or 1.0
    factor = written(fitted.select(*wanted, (F.col("weight") / (F.col("tokens") / F.lit(all_tokens))).alias("weight")), "factors")
    most = factor.agg(F.max("weight")).first()[0] or 1.0
    factor = factor.select(*wanted, F.round("weight", 9).alias("weight"), F.round(F.col("weight") / F.lit(most), 9).alias("probability"))
    # one row a cell, so the table is small next to the documents; Spark broadcasts it by its size or else joins by cell
    out = named.select("*", *values).join(F.broadcast(factor) if is_small(factor, SMALL_BYTES) else factor, list(wanted), "left").fillna(0.0, ["weight", "probability"])
    draw = F.xxhash64(F.coalesce(F.col("drawn"), F.lit("")), F.lit(seed)).bitwiseAND(F.lit(_DRAWS - 1)) / F.lit(float(_DRAWS))
    return out.select(*(F.col("own")[c].alias(c) for c in kept), "n_tokens", "topic", "weight", "probability", (draw < F.col("probability")).alias("sampled"))
