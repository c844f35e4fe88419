"""Comparison of results and of runs: row sets, a paired test, a bootstrap by family, a stable split."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter


def row_sets_equal(got: list[dict], want: list[dict], columns: dict[str, str], ordered: bool = False, decimals: int = 6) -> bool:
    """Whether two results agree in the mapped columns (wanted name -> got name), numbers rounded."""

    def cell(x):
        return round(float(x), decimals) if isinstance(x, int | float) and not isinstance(x, bool) else x

    a = [tuple(cell(r.get(g)) for g in columns.values()) for r in got]
    b = [tuple(cell(r.get(w)) for w in columns) for r in want]
    return a == b if ordered else Counter(a) == Counter(b)


def mcnemar(before: list[bool], after: list[bool]) -> float:
    """The one-sided exact probability of as many losses among the changed cases if losses and gains were as likely."""
    lost = sum(x and not y for x, y in zip(before, after, strict=True))
    gained = sum(y and not x for x, y in zip(before, after, strict=True))
    n = lost + gained
    return sum(math.comb(n, k) for k in range(lost, n + 1)) / 2**n


def family_bootstrap(passed: dict[str, list[bool]], rounds: int = 2000, seed: int = 0, level: float = 0.95) -> tuple[float, float, float]:
    """The share passed, with an interval from families drawn with replacement."""
    families = [passed[k] for k in sorted(passed)]
    share = sum(map(sum, families)) / sum(map(len, families))
    draw = random.Random(seed)
    found = []
    for _ in range(rounds):
        own = draw.choices(families, k=len(families))
        found.append(sum(map(sum, own)) / sum(map(len, own)))
    found.sort()
    tail = (1 - level) / 2
    return share, found[int(tail * rounds)], found[min(rounds - 1, int((1 - tail) * rounds))]


def held_out(family: str, salt: str, part: float = 0.30) -> bool:
    """Whether a family belongs to the held-out part, for good."""
    return int.from_bytes(hashlib.sha256(f"{salt}:{family}".encode()).digest()[:8], "big") < part * 2**64
