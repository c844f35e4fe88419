"""Hand-kept CSV seeds with agreed types: every row that does not fit is reported by its file and line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The seeds, their columns and types.
SEEDS = {
    "award_timing": "award string, known_at string",
    "known_boxscore_gaps": "game_id string, team_id int",
    "known_player_career_gaps": "player_id int, endpoint string, class string, season string, season_type string",
    "known_stint_total_gaps": "player_id int, season string, season_type string, difference string, note string",
    "known_team_record_gaps": "team_id int, season string, games_missing int, note string",
    "player_alias_seed": "alias string, player_name string, kind string",
    "records_curated": "record string, record_kind string, stat string, player string, value string, source_url string, valid_from string, note string",
    "season_schedule": "season_start int, max_games int, note string",
    "stat_availability": "stat string, first_season string, first_season_start int, source string, note string",
    "team_alias_seed": "alias string, team_abbreviation string",
    "tiebreaker_games": "game_id string, season string, game_date date, note string",
}


class SeedError(ValueError):
    """A seed whose header or rows are not as agreed."""


def parsed(spark: SparkSession, path: str, types: str) -> DataFrame:
    """_line, _bad (the line, if it does not fit) and the columns of a CSV file, in its order of columns; those without an agreed type are text. A file is read as a whole:
    these are files that people keep. Cells may be quoted, but hold no line ends; empty cells are null."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    first = lines.where("at = 0").first()
    header = [h.strip().strip('"').removeprefix("﻿") for h in (first["line"] if first else "").split(",")]
    agreed = dict(t.split(" ") for t in types.split(", "))
    missing = [c for c in agreed if c not in header]
    if missing or len(set(header)) < len(header):
        raise SeedError(f"{path}: the header {', '.join(header)} " + (f"lacks {', '.join(missing)}" if missing else "repeats a column"))
    schema = ", ".join(f"`{h}` {agreed.get(h, 'string')}" for h in header)
    rows = lines.where("at > 0 and trim(line) <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "dateFormat": "yyyy-MM-dd", "emptyValue": "", "nullValue": ""}
    read = rows.select((F.col("at") + 1).alias("_line"), F.from_csv("line", f"{schema}, `_bad` string", options).alias("r"))
    return read.select("_line", F.col("r._bad").alias("_bad"), *(F.col(f"r.`{h}`").alias(h) for h in header))


def read_seed(spark: SparkSession, path: str, name: str, shown: int = 20) -> DataFrame:
    """The rows of <path>/<name>.csv; SeedError with the lines (the first `shown` of them) that do not fit."""
    rows = parsed(spark, f"{path.rstrip('/')}/{name}.csv", SEEDS[name])
    bad = rows.where(F.col("_bad").isNotNull()).select("_line", "_bad").orderBy("_line").limit(shown).collect()
    if bad:
        raise SeedError(f"{name}: " + "; ".join(f"line {r['_line']}: {r['_bad']}" for r in bad))
    return rows.drop("_line", "_bad")


def read_seeds(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All seeds by name."""
    return {name: read_seed(spark, path, name) for name in SEEDS}
