"""Raw nested JSON responses to all-text landing tables, behind contracts.

A response file holds {key, endpoint, season, params, fetched_at, response}; the response holds result sets of headers and rows.
Each result set becomes one table of text columns with where each row came from.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVENANCE = ("_key", "_partition", "_file", "_fetched_at", "_params")
_SETS = "array<struct<name string, headers array<string>, rowSet array<array<string>>>>"
_DOCUMENT = f"key string, endpoint string, season string, params string, fetched_at string, response struct<resultSets {_SETS}, resultSet {_SETS}>"


class ContractError(ValueError):
    """A response that does not have the agreed form."""


def read_raw(spark: SparkSession, path: str, files: Column | None = None) -> DataFrame:
    """The documents under a folder of JSON files, one row a file: key, endpoint, season, params (JSON text), fetched_at, sets,
    file. A file that is not JSON gives nulls. files: a condition on _metadata (path, name, size, time of a file), by which other files are not even opened."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    text = (text if files is None else text.where(files)).select("value", F.col("_metadata.file_path").alias("file"))
    sets = F.from_json(F.get_json_object("value", "$.response.resultSets"), _SETS)
    single = F.from_json(F.concat(F.lit("["), F.get_json_object("value", "$.response.resultSet"), F.lit("]")), _SETS)
    get = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    return text.select(get("key"), get("endpoint"), get("season"), get("params"), get("fetched_at"), F.coalesce(sets, single).alias("sets"), "file")


def cell_text(c: Column) -> Column:
    """The landed text of a cell: whole numbers without a decimal part, else as written; null stays null."""
    return F.when(c.rlike(r"^-?\d+\.0+$"), F.regexp_replace(c, r"\.0+$", "")).otherwise(c)


def flatten(raw: DataFrame, endpoint: str, result_set: str, headers: list[str]) -> DataFrame:
    """The rows of one result set of one endpoint: PROVENANCE and a text column for each header. A header that a response lacks
    is null in its rows; a row whose width differs from its headers fails the query."""
    sets = raw.where(F.col("endpoint") == endpoint).select("*", F.explode("sets").alias("set")).where(F.col("set.name") == result_set)
    rows = sets.select("*", F.explode("set.rowSet").alias("row"))
    ragged = F.size("row") != F.size("set.headers")
    message = F.concat(F.lit(f"{endpoint}/{result_set}: a row is not as wide as its headers in "), F.col("file"))
    rows = rows.withColumn("row", F.when(ragged, F.raise_error(message).cast("array<string>")).otherwise(F.col("row")))
    cells = F.map_from_arrays("set.headers", "row")
    return rows.withColumn("cells", cells).select(
        F.col("key").alias("_key"), F.col("season").alias("_partition"), F.col("file").alias("_file"), F.col("fetched_at").alias("_fetched_at"), F.col("params").alias("_params"),
        *(cell_text(F.element_at("cells", F.lit(h))).alias(h) for h in headers),
    )


def headers_of(raw: DataFrame, endpoint: str, result_set: str, most: int = 1000) -> list[str]:
    """All headers that the responses show for a result set, in the order first seen (by file); their number is checked."""
    sets = raw.where(F.col("endpoint") == endpoint).select("file", F.explode("sets").alias("set")).where(F.col("set.name") == result_set)
    seen = sets.select("file", F.posexplode("set.headers").alias("at", "header")).groupBy("header").agg(F.min(F.struct("file", "at")).alias("first"))
    found = seen.orderBy("first").limit(most + 1).collect()
    if len(found) > most:
        raise ContractError(f"{endpoint}/{result_set} shows more than {most} headers")
    return [r["header"] for r in found]


def land(raw: DataFrame, wanted: dict[str, list[str]], out: str, keep: Column | None = None) -> dict[str, DataFrame]:
    """Writes each endpoint's listed result sets as Parquet, partitioned by key, and reads them back. A result set without any
    response gets an empty table. keep: a condition on a document's key, endpoint, season, params, fetched_at and file; the rows of others are neither flattened nor landed."""
    spark = raw.sparkSession
    raw = raw if keep is None else raw.where(keep)
    tables = {}
    for endpoint, sets in wanted.items():
        for name in sets:
            table = f"{endpoint}__{name}".lower()
            df = flatten(raw, endpoint, name, headers_of(raw, endpoint, name))
            df.write.mode("overwrite").parquet(f"{out}/{table}")
            tables[table] = spark.read.schema(df.schema).parquet(f"{out}/{table}")
    return tables


@dataclass(frozen=True)
class Contract:
    """variants: for each result set its legal header lists with the JSON kinds of each cell; keys: columns never null."""

    endpoint: str
    variants: dict[str, list[tuple[tuple[str, ...], tuple[str, ...]]]] = field(default_factory=dict)
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def check(self, document: str) -> None:
        """Raises ContractError unless a document's result sets are exactly one of the variants."""
        body = json.loads(document)["response"]
        sets = {s["name"]: s for s in body.get("resultSets") or [body["resultSet"]]}
        for name, variants in self.variants.items():
            if name not in sets:
                raise ContractError(f"{self.endpoint}: no result set {name}")
            headers, rows = tuple(sets[name]["headers"]), sets[name]["rowSet"]
            kinds = next((k for h, k in variants if h == headers), None)
            if kinds is None:
                raise ContractError(f"{self.endpoint}/{name}: headers are not of a known variant: {', '.join(headers)[:200]}")
            for i, row in enumerate(rows):
                if len(row) != len(headers):
                    raise ContractError(f"{self.endpoint}/{name}: row {i} has {len(row)} cells, not {len(headers)}")
                for header, kind, cell in zip(headers, kinds, row, strict=True):
                    if cell is None:
                        if header in self.keys.get(name, ()):
                            raise ContractError(f"{self.endpoint}/{name}: row {i} has no {header}")
                    elif kind_of(cell) not in kind.split("|"):
                        raise ContractError(f"{self.endpoint}/{name}: row {i}, {header} is {kind_of(cell)}, not {kind}")

    @classmethod
    def observed(cls, endpoint: str, documents: list[str], keys: dict[str, tuple[str, ...]] | None = None) -> Contract:
        """The contract that sample documents show."""
        variants: dict[str, dict[tuple, list[set]]] = {}
        for d in documents:
            body = json.loads(d)["response"]
            for s in body.get("resultSets") or [body["resultSet"]]:
                kinds = variants.setdefault(s["name"], {}).setdefault(tuple(s["headers"]), [set() for _ in s["headers"]])
                for row in s["rowSet"]:
                    for k, cell in zip(kinds, row, strict=True):
                        if cell is not None:
                            k.add(kind_of(cell))
        return cls(endpoint, {n: [(h, tuple("|".join(sorted(k)) or "string|number|boolean" for k in kinds)) for h, kinds in v.items()] for n, v in variants.items()}, keys or {})


def kind_of(cell) -> str:
    return "boolean" if isinstance(cell, bool) else "number" if isinstance(cell, int | float) else "string" if isinstance(cell, str) else "other"


def schedule_counts(raw: DataFrame, text: str = "value") -> DataFrame:
    """Finished games of counted kinds by date, from schedule documents: day, n."""
    kind = "array<struct<gameDate string, games array<struct<gameId string, gameStatus int>>>>"
    days = raw.select(F.explode(F.from_json(F.get_json_object(text, "$.response.leagueSchedule.gameDates"), kind)).alias("d"))
    games = days.select(F.col("d.gameDate").alias("day"), F.explode("d.games").alias("g"))
    return games.where((F.col("g.gameStatus") == 3) & F.substring("g.gameId", 1, 3).isin("002", "004", "005", "006")).groupBy("day").agg(F.count("*").alias("n"))
