"""Relative time in questions, by the clock of the data rather than the wall."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta


@dataclass(frozen=True)
class Clock:
    """The newest day of the data, its season's first year, and the first year of the newest season with finished playoffs."""

    today: date
    season: int
    finals: int


@dataclass(frozen=True)
class TimeRef:
    seasons: tuple[str, ...] = ()
    day: date | None = None
    season_type: str | None = None


def label(start: int) -> str:
    return f"{start}-{(start + 1) % 100:02d}"


# Small numbers as words.
_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten".split())}


def time_of(text: str, clock: Clock) -> TimeRef:
    """The first reference that matches, in a fixed order; nothing if none does."""
    low = text.lower()
    kind = "Playoffs" if re.search(r"\bplayoffs?\b|\bfinals\b", low) else None
    if re.search(r"\blast night\b|\byesterday\b", low):
        return TimeRef((label(clock.season),), clock.today if "last night" in low else clock.today - timedelta(days=1), kind)
    if re.search(r"\btoday\b|\btonight\b", low):
        return TimeRef((label(clock.season),), clock.today, kind)
    if m := re.search(r"\b((?:19|20)\d\d)[-–/](\d\d)\b", low):
        return TimeRef((label(int(m[1])),), None, kind)
    if m := re.search(r"\bsince\s+((?:19|20)\d\d)\b", low):
        return TimeRef(tuple(label(y) for y in range(int(m[1]), clock.season + 1)), None, kind)
    if m := re.search(r"\b(?:the\s+)?((?:19|20)?\d0)s\b", low):
        start = int(m[1]) if len(m[1]) == 4 else (1900 if int(m[1]) >= 40 else 2000) + int(m[1])
        return TimeRef(tuple(label(y) for y in range(start, min(start + 9, clock.season) + 1)), None, kind)
    if m := re.search(r"\blast\s+(\d+|" + "|".join(_WORDS) + r")\s+seasons\b", low):
        n = _WORDS.get(m[1], int(m[1]) if m[1].isdigit() else 0)
        return TimeRef(tuple(label(y) for y in range(clock.season - n + 1, clock.season + 1)), None, kind)
    if re.search(r"\blast season\b|\bprevious season\b", low):
        return TimeRef((label(clock.season - 1),), None, kind)
    if re.search(r"\blast finals\b", low):
        return TimeRef((label(clock.finals),), None, "Playoffs")
    if m := re.search(r"\bin\s+((?:19|20)\d\d)\b", low):
        return TimeRef((label(int(m[1]) - 1),), None, kind)
    if re.search(r"\bthis (?:season|year)\b|\bcurrent season\b", low):
        return TimeRef((label(clock.season),), None, kind)
    return TimeRef((), None, kind)
