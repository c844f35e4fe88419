"""Numbers, seasons and dates stated in texts, and when a stated number is a fair rounding of a value.

Reading a text is a small Python helper in an Arrow UDF (compatibility forms of Unicode and look-behind positions have no built-in);
whether statements fit values is an equi-join on exact decimals, see operators/verifier.py.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How seasons and dates, names of statistics with a digit, numbers, and their scales are written.
TOKEN = re.compile(r"(?<![\w.-])(\d{4}-\d{2}-\d{2}|\d{4}-\d{2})(?![\w-])")
STAT_NAME = re.compile(r"(?<![\w.-])(?:\d+-point(?:er)?s?\b|[23]P(?:T|M|A|%)?(?![\w])|[23]s\b)", re.I)
NUMBER = re.compile(r"(?<![\w.])([+-]?)(?=\.?\d)(\d{1,3}(?:,\d{3})+|\d+)?(\.\d+)?(%?)(?:\s?(k|K|M|bn|thousand|million|billion)\b)?(?!\d)")
SCALE = {"k": 3, "K": 3, "thousand": 3, "M": 6, "million": 6, "bn": 9, "billion": 9}
# Numbers as words, and phrases that are no claims though they hold one.
UNITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
IDIOMS = ("one of", "no one", "someone", "anyone", "everyone", "one-on-one", r"three-point(?:er)?s?", r"two-point(?:er)?s?", "three-pointers?", "triple-doubles?", "double-doubles?")

_VALUES = {w: k for k, w in enumerate(UNITS)} | {w: 10 * k for k, w in enumerate(TENS, 2)}
# The first letters of all of these are told at once, so that most words are passed over quickly.
_SPELLED = re.compile(rf"\b(?=[zotfsenad])(?:(?P<idiom>(?:{'|'.join(IDIOMS)})\b)|(?P<tens>{'|'.join(TENS)})(?:[- ](?P<unit>{'|'.join(UNITS)}))?\b|(?P<small>{'|'.join(UNITS)})\b)", re.I)
# What a text has that may hold a spelled-out number, a season or date, a statistic's name, a number: found quickly, and rare in most texts.
_STEMS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "zero", "eleven", "twelve", "twent", "thir", "fort", "fif")
_DATED, _NAMED, _DIGIT = re.compile(r"\d\d\d\d-\d\d"), re.compile(r"\d(?:-[pP]|[pPsS])"), re.compile(r"\d")


def with_digits(text: str) -> str:
    """The text with spelled-out numbers as digits; idioms stay, whatever number begins inside of them."""

    def digits(m: re.Match) -> str:
        if m["idiom"]:
            return m[0]
        return str(sum(_VALUES[m[g].lower()] for g in ("tens", "unit", "small") if m[g]))

    low = text.lower()
    return _SPELLED.sub(digits, text) if any(x in low for x in _STEMS) else text


def canonical(value: Decimal) -> str:
    """The number without trailing zeros, exponent or negative zero: equal numbers are equal texts."""
    plain = format(value, "f")
    plain = plain.rstrip("0").rstrip(".") if "." in plain else plain
    return "0" if plain in ("-0", "") else plain


def _plain(sign: str, whole: str, part: str, scale: str | None) -> str:
    """canonical() of a stated number; short ones without a scale need no Decimal."""
    if scale is None and len(whole) + len(part) < 28 and whole.isascii() and part.isascii():
        part = part.rstrip("0")
        plain = (whole.lstrip("0") or "0") + (part if len(part) > 1 else "")
        return f"-{plain}" if sign == "-" and plain != "0" else plain
    return canonical(Decimal(f"{sign}{whole or '0'}{part}").scaleb(SCALE.get(scale, 0)))


def _found(text: str) -> list[tuple]:
    """What a text in NFKC form states, in order, as tuples in the order of _KINDS."""
    found, rest = [], text
    if _DIGIT.search(text):
        if _DATED.search(text):
            found += [(m[1], None, 0, False, True, False, *m.span(1)) for m in TOKEN.finditer(text)]
            rest = TOKEN.sub(lambda m: " " * len(m[0]), rest)
        if _NAMED.search(rest):
            rest = STAT_NAME.sub(lambda m: " " * len(m[0]), rest)
        for m in NUMBER.finditer(rest):
            sign, whole, part, percent, scale = m.groups()
            value = _plain(sign, (whole or "").replace(",", ""), part or "", scale)
            found.append((m[0].strip(), value, 0 if scale or not part else len(part) - 1, bool(percent), False, False, *m.span()))
    if not text.isascii():
        found += [(c, None, 0, False, False, True, k, k + 1) for k, c in enumerate(rest) if not c.isascii() and c.isnumeric()]
    return sorted(found, key=lambda x: x[6])


def _normal(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def extract_numbers(text: str | None) -> list[dict]:
    """What the text states, in order: text, value (canonical; null for seasons and dates), decimals, percent, token (a season or date),
    exotic (a digit of another script, which fits nothing), start and end in the NFKC form of the text."""
    return [dict(zip(_KINDS, x, strict=True)) for x in _found(_normal(text or ""))]


_KINDS = {"text": T.StringType(), "value": T.StringType(), "decimals": T.IntegerType(), "percent": T.BooleanType(), "token": T.BooleanType(), "exotic": T.BooleanType(), "start": T.IntegerType(), "end": T.IntegerType()}
MENTIONS = T.ArrayType(T.StructType([T.StructField(k, v) for k, v in _KINDS.items()]))
_ARROW = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32())


def _mentions(found: list[list[tuple]]) -> pa.Array:
    """MENTIONS of a batch, built by column."""
    columns = list(zip(*(x for f in found for x in f), strict=True)) or [()] * len(_ARROW)
    rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, _ARROW, strict=True)], names=list(_KINDS))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), rows)


@F.arrow_udf(MENTIONS)
def _extract(texts: pa.Array) -> pa.Array:
    return _mentions([_found(_normal(x or "")) for x in texts.to_pylist()])


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("found", MENTIONS)]))
def _read(texts: pa.Array) -> pa.Array:
    read = [_normal(with_digits(x or "")) for x in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array(read, pa.string()), _mentions([_found(x) for x in read])], names=["text", "found"])


def numbers_in(text: str | Column) -> Column:
    """extract_numbers() of a column, in Arrow batches; null texts state nothing."""
    return _extract(text)


def read_in(text: str | Column) -> Column:
    """text (normalised, spelled-out numbers as digits) and found (its extract_numbers()) of a column."""
    return _read(text)


def half_up(x: float, decimals: int) -> Decimal:
    """Rounds the shortest decimal form of x, halves away from zero."""
    return Decimal(repr(x)).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP)


#: Decimals that a value may be shown with.
MOST_DECIMALS = 6


def rounded_key(value: Column, decimals: Column) -> Column:
    """The canonical text of a double's shortest decimal form rounded half up to so many decimals (0 to 6; else null)."""
    exact = lambda k: value.cast("string").cast(f"decimal(38,{k})").cast("string")
    key = F.when(decimals == 0, exact(0))
    for k in range(1, MOST_DECIMALS + 1):
        key = key.when(decimals == k, F.rtrim(F.rtrim(exact(k), F.lit("0")), F.lit(".")))
    return key
