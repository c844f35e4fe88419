"""Results of queries: whether two are the same whatever their columns are called, and how cells are shown.

Columns are told by signatures: sums of the hashes of their rounded cells, which depend neither on the order of rows nor on partitions. All
signatures of a result, and all row signatures of a block of possible mappings, are one aggregation each; no rows come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import MOST_DECIMALS, rounded_key

#: Mappings that are tried, and so many of them in a pass.
MOST_MAPPINGS, AT_ONCE = 5_000, 50
#: Decimals of numbers without a rule.
STORED = 6
# Columns that are never shown, and rows of a table that is.
HIDDEN = ("player_id", "team_id", "franchise_id", "game_id", "season_number", "team_gp", "opponent_team_id")
SHOWN = 25


@dataclass(frozen=True)
class Rounding:
    """How a metric is shown: its decimals, and whether a fraction is shown as a percentage."""

    decimals: int
    percent: bool = False
    label: str | None = None


@dataclass(frozen=True)
class Match:
    """mapping: wanted column -> the other result's; None with the reason if there is none."""

    mapping: dict[str, str] | None
    reason: str = ""


def _cell(rows: DataFrame, name: str, rounding: Rounding | None) -> Column:
    """A cell as text in which equal values are equal: numbers as rounded (half up on their shortest form), times in ISO form; a null is a value of its own."""
    kind, c = rows.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        decimals = STORED if rounding is None else rounding.decimals + 2 * rounding.percent
        number = c.cast("double")
        key = rounded_key(number, F.lit(min(decimals, MOST_DECIMALS)))
        return F.concat(F.lit("n"), F.when(F.isnan(number) | (F.abs(number) >= F.lit(1e30)), number.cast("string")).otherwise(key))
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.concat(F.lit("j"), F.to_json(c))
    return F.concat(F.lit(kind.simpleString()[0]), c.cast("string"))


def _digests(rows: DataFrame, cells: dict[object, list[Column]]) -> tuple[int, dict[object, tuple]]:
    """The number of rows, and of every list of cells the order-free digest of its rows."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *cs).cast("decimal(38,0)")) for cs in cells.values() for seed in (1, 2)]
    found = rows.agg(F.count("*"), *sums).first()
    return found[0], {k: (found[1 + 2 * i], found[2 + 2 * i]) for i, k in enumerate(cells)}


def same_rows(want: DataFrame, got: DataFrame, columns: dict[str, Rounding | None] | None = None, position: tuple[str, str] | None = None) -> Match:
    """Whether every wanted column (all of them by default) is a column of its own in got, row for row, numbers rounded by their rule.

    Rows are multisets, or sequences if position names the columns that number the rows of want and of got. Which column is which is found: columns of equal digests are
    options, and mappings are tried by digests of whole rows, AT_ONCE in a pass; more than MOST_MAPPINGS of them are too many to tell."""
    there, other = (position or (None, None))
    columns = columns if columns is not None else {c: None for c in want.columns if c != there}
    names = [c for c in got.columns if c != other]
    at = lambda name: [F.col(f"`{name}`").cast("string")] if name else []
    mine = {c: _cell(want, c, r) for c, r in columns.items()}
    theirs = {(j, r): _cell(got, j, r) for j in names for r in set(columns.values())}
    n, wanted = _digests(want, {c: [x, *at(there)] for c, x in mine.items()} | {None: [*mine.values(), *at(there)]})
    m, found = _digests(got, {k: [x, *at(other)] for k, x in theirs.items()})
    if n != m:
        return Match(None, f"{m} rows, not {n}")
    if n == 0:
        return Match({})
    options = {c: [j for j in names if found[j, r] == wanted[c]] for c, r in columns.items()}
    for c, js in options.items():
        if not js:
            return Match(None, f"no column is {c}" + (" in this order" if position else ""))
    mappings: Iterator[tuple[str, ...]] = (p for p in product(*options.values()) if len(set(p)) == len(p))
    tried = 0
    while block := list(islice(mappings, AT_ONCE)):
        tried += len(block)
        if tried > MOST_MAPPINGS:
            return Match(None, "too many mappings to tell")
        _, rows = _digests(got, {p: [*(theirs[j, r] for j, r in zip(p, columns.values(), strict=True)), *at(other)] for p in block})
        for p in block:
            if rows[p] == wanted[None]:
                return Match(dict(zip(columns, p, strict=True)))
    return Match(None, "the columns agree, the rows do not")


def shown(rows: DataFrame, metrics: dict[str, Rounding]) -> DataFrame:
    """rows as they are shown: all text, without the hidden columns; metrics by their rounding, other numbers with at most one decimal, large ones with commas, null as n/a."""

    def text(name: str) -> Column:
        c, kind = F.col(f"`{name}`"), rows.schema[name].dataType
        exact = lambda x, k: x.cast("string").cast(f"decimal(38,{k})")
        if isinstance(kind, T.NumericType) and name in metrics:
            r, x = metrics[name], c.cast("double")
            if r.percent:
                said = F.concat(exact(x * 100, r.decimals).cast("string"), F.lit("%"))
            else:
                said = F.format_number(exact(x, 0), 0) if r.decimals == 0 else exact(x, r.decimals).cast("string")
        elif isinstance(kind, T.FloatType | T.DoubleType | T.DecimalType):
            said = F.when(c == F.floor(c), exact(c, 0).cast("string")).otherwise(exact(c, 1).cast("string"))
        elif isinstance(kind, T.IntegralType):
            said = F.when(F.abs(c.cast("decimal(20,0)")) >= 10_000, F.format_number(c, 0)).otherwise(c.cast("string"))
        elif isinstance(kind, T.BooleanType):
            said = F.when(c, "yes").otherwise("no")
        else:
            said = c.cast("string")
        return F.when(c.isNull(), "n/a").otherwise(said).alias(name)

    return rows.select(*(text(c) for c in rows.columns if c not in HIDDEN))


def text_table(rows: DataFrame, metrics: dict[str, Rounding], most: int = SHOWN) -> str:
    """The first rows, in their order, as a plain table; "No rows." if there are none. Only `most` rows come to the driver."""
    text = shown(rows, metrics)
    cells = [list(r) for r in text.limit(most).collect()]
    if not cells:
        return "No rows."
    heads = [(metrics[c].label or c) if c in metrics else c.replace("_", " ") for c in text.columns]
    widths = [max(len(r[k]) for r in [heads, *cells]) for k in range(len(heads))]
    line = lambda parts: " | ".join(p.ljust(w) for p, w in zip(parts, widths, strict=True))
    return "\n".join([line(heads), "-+-".join("-" * w for w in widths), *map(line, cells)])
