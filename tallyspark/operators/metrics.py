"""The metric compiler: aggregates declared as data become fused DataFrame aggregations.

All metrics of one base and grain are computed in a single aggregation, each metric's own filter inside its aggregates, and
joined once to the spine of entities, rather than one scan and join a metric.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AGGREGATE = re.compile(r"\b(sum|count|count_if|max|min|avg)\(([^()]*)\)")


@dataclass(frozen=True)
class Metric:
    """value is SQL of aggregates over the rows of base that pass where."""

    name: str
    base: str
    value: str
    grains: tuple[str, ...] = ("season", "career")
    unit: str = "count"
    decimals: int = 0
    where: str | None = None
    qualification: str | None = None
    requires: tuple[str, ...] = ()
    higher_is_better: bool = True
    aliases: tuple[str, ...] = field(default=())

    def column(self) -> Column:
        """The fused aggregate. A metric with a filter of its own is null where no row passes it, not 0."""
        if self.where is None:
            return F.expr(self.value).alias(self.name)
        inside = _AGGREGATE.sub(lambda m: f"{m[0]} filter (where {self.where})", self.value)
        return F.expr(f"case when count_if({self.where}) > 0 then {inside} end").alias(self.name)


class Registry:
    def __init__(self, metrics: list[Metric]):
        self.metrics: dict[str, Metric] = {}
        names: set[str] = set()
        for m in metrics:
            for n in (m.name, *m.aliases):
                if n in names:
                    raise ValueError(f"two metrics are named {n}")
                names.add(n)
            if not re.search(r"\b(sum|count|count_if|max|min|avg)\(", m.value):
                raise ValueError(f"{m.name} aggregates nothing")
            self.metrics[m.name] = m

    def __getitem__(self, name: str) -> Metric:
        if name in self.metrics:
            return self.metrics[name]
        for m in self.metrics.values():
            if name in m.aliases:
                return m
        raise KeyError(f"no metric {name}; there are {', '.join(sorted(self.metrics))}")

    def at(self, grain: str) -> list[Metric]:
        return [m for m in self.metrics.values() if grain in m.grains]


@dataclass(frozen=True)
class Base:
    """The rows that metrics are computed from at a grain, and the columns by which they meet the spine."""

    rows: DataFrame
    keys: tuple[str, ...]
    only: str | None = None  # a condition on the spine: elsewhere the metrics are null


def compile_metrics(spine: DataFrame, bases: dict[str, Base], metrics: list[Metric]) -> DataFrame:
    """The spine with one column for each metric. Only the bases that the metrics name are read, each once."""
    out = spine
    for name in dict.fromkeys(m.base for m in metrics):
        base = bases[name]
        own = [m for m in metrics if m.base == name]
        sums = base.rows.groupBy(*base.keys).agg(*(m.column() for m in own))
        out = out.join(sums, list(base.keys), "left")
        if base.only:
            out = out.withColumns({m.name: F.when(F.expr(base.only), F.col(m.name)) for m in own})
    return out.select(*spine.columns, *(m.name for m in metrics))


def rounded(c: str, metric: Metric) -> Column:
    """The shown value: fractions as percentages, halves up at the metric's decimals."""
    x = F.col(c).cast("double")
    return F.round(x * 100, metric.decimals) if metric.unit == "percent" else F.round(x, metric.decimals)
