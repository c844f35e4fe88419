"""Cards that describe a table: each column with its type and its least distinct values, found in one scan.

A task keeps the k least distinct values of every column while it reads (an Arrow step with bounded state) and sends one row; the
rows of all tasks are merged. No column is sorted or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXAMPLES = 3
#: Letters of an example.
SHOWN = 40


def _orderable(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType | T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType | T.BooleanType)


def least_distinct(rows: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """One row: for every column of a simple type the array of its k least distinct values that are neither null nor NaN, in order."""
    fields = [f for f in rows.schema.fields if _orderable(f.dataType)]
    out = T.StructType([T.StructField(f"c{i}", T.ArrayType(f.dataType)) for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Array] | None = None
        for b in batches:
            if kept is None:
                kept = [c.slice(0, 0) for c in b.columns]
            for i, c in enumerate(b.columns):
                c = c.filter(pc.is_valid(c))
                if pa.types.is_floating(c.type):
                    c = c.filter(pc.invert(pc.is_nan(c)))
                both = pc.unique(pa.concat_arrays([kept[i], pc.unique(c)]))
                kept[i] = both.take(pc.array_sort_indices(both)[:k])
        if kept is not None:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in kept]
            yield pa.RecordBatch.from_arrays(lists, names=[f.name for f in out.fields])

    each = rows.select(*(F.col(f"`{f.name}`") for f in fields)).mapInArrow(run, out)
    merge = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k)
    return each.agg(*(merge(f"c{i}").alias(f.name) for i, f in enumerate(fields)))


def column_cards(rows: DataFrame, view: str, described: dict[str, str] | None = None, k: int = EXAMPLES) -> DataFrame:
    """column, type, examples and card (text) of every column of rows, and first the view's own (column null). The same data gives the same cards.
    described: by column, a sentence about it."""
    described = described or {}
    simple = {f.name for f in rows.schema.fields if _orderable(f.dataType)}
    found = least_distinct(rows, k)
    empty = F.array().cast("array<string>")
    cards = []
    for name, kind in rows.dtypes:
        texts = F.transform(F.col(f"`{name}`"), lambda x: F.substring(x.cast("string"), 1, SHOWN)) if name in simple else empty
        examples = F.array_join(texts, ", ")
        head = f"Column {name} ({kind}) of view {view}." + (f" {described[name]}" if name in described else "")
        cards.append(F.struct(F.lit(name).alias("column"), F.lit(kind).alias("type"), examples.alias("examples"), F.concat(F.lit(f"{head} Examples: "), examples).alias("card")))
    own = F.struct(F.lit(None).cast("string").alias("column"), F.lit("view").alias("type"), F.lit("").alias("examples"), F.lit(f"View {view} ({len(rows.columns)} columns): {', '.join(rows.columns)}").alias("card"))
    return found.select(F.explode(F.array(own, *cards)).alias("c")).select("c.*")


def tool_cards(schemas: dict[str, dict], questions: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(name, card) of every tool from its argument schema: a line for each argument, and questions that it answers."""
    out = []
    for name in sorted(schemas):
        schema, lines = schemas[name], []
        for arg, spec in schema.get("properties", {}).items():
            values = spec.get("enum") or spec.get("items", {}).get("enum")
            kind = (f"one of {len(values)} values" if len(values) > 8 else f"one of {', '.join(map(str, values))}") if values else spec.get("type", "")
            lines.append(f"- {arg}{' (required)' if arg in schema.get('required', []) else ''}: {kind}" + (f" - {spec['description']}" if spec.get("description") else ""))
        out.append((f"tool:{name}", "\n".join([f"Tool {name}: {schema.get('description', '')}", "Arguments:", *lines, "Example questions: " + " | ".join(questions.get(name, []))])))
    return out
