"""Typing of all-text columns, and codes derived from labels and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_int(c: str | Column) -> Column:
    """Text to integer by way of a number, halves to even; null if it is not a number."""
    return F.bround(_c(c).try_cast("double"), 0).try_cast("int")


def to_num(c: str | Column) -> Column:
    return _c(c).try_cast("double")


def season_label(start: str | Column) -> Column:
    """2024 -> 2024-25."""
    y = _c(start).cast("int")
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def season_start(label: str | Column) -> Column:
    return F.substring(_c(label), 1, 4).try_cast("int")


def season_of_id(season_id: str | Column) -> Column:
    """22024 -> 2024-25: the first digit is a kind of season."""
    return season_label(F.substring(_c(season_id), 2, 4))


# The kind of season by the first three characters of a game's id.
SEASON_TYPES = {"002": "Regular Season", "004": "Playoffs", "005": "PlayIn", "006": "Cup Final"}


def season_type(game_id: str | Column) -> Column:
    """By the id's prefix; null for any other."""
    out = F.lit(None).cast("string")
    for prefix, name in SEASON_TYPES.items():
        out = F.when(F.substring(_c(game_id), 1, 3) == prefix, F.lit(name)).otherwise(out)
    return out


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(_c(c)), F.lit(""))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as a double; null where b is 0."""
    return _c(a).cast("double") / F.nullif(_c(b).cast("double"), F.lit(0.0))


def masked(value: str | Column, start: str | Column, first: int | Column | None) -> Column:
    """The value from the first season in which it was tracked; null before, not 0. Without a first season it is never masked."""
    return _c(value) if first is None else F.when(_c(start) >= first, _c(value))


def periods(minutes: str | Column) -> Column:
    """Four quarters, and one more for each 25 player-minutes beyond 240; null under 240."""
    m = _c(minutes)
    return F.when(m >= 240, (4 + F.round((m - 240) / 25)).cast("int"))


def strip_accents(c: str | Column) -> Column:
    """Letters without their marks. Latin letters are replaced by a table of pairs, so it stays in the JVM."""
    out = _c(c)
    for plain, marked in ACCENTS.items():
        out = F.translate(out, marked, plain * len(marked))
    return out


# Latin letters by the plain letter that they are read as.
ACCENTS = {
    "a": "àáâãäåāăą", "c": "çćčĉċ", "d": "ďđ", "e": "èéêëēĕėęě", "g": "ğģĝġ", "i": "ìíîïīĭįı", "k": "ķ", "l": "ĺļľł", "n": "ñńņň", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşšș", "t": "ţťț", "u": "ùúûüūŭůűų", "y": "ýÿ", "z": "źżž",
    "A": "ÀÁÂÃÄÅĀĂĄ", "C": "ÇĆČĈĊ", "D": "ĎĐ", "E": "ÈÉÊËĒĔĖĘĚ", "G": "ĞĢĜĠ", "I": "ÌÍÎÏĪĬĮİ", "K": "Ķ", "L": "ĹĻĽŁ", "N": "ÑŃŅŇ", "O": "ÒÓÔÕÖØŌŎŐ", "R": "ŔŖŘ", "S": "ŚŜŞŠȘ", "T": "ŢŤȚ", "U": "ÙÚÛÜŪŬŮŰŲ", "Y": "ÝŸ", "Z": "ŹŻŽ",
}


def alias_norm(c: str | Column) -> Column:
    """How names are compared: lower case, no accents, points or doubled spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), r"[.'’]", ""), r"\s+", " "))
