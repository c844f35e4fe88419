"""Many checks of a table in one pass over it, also while it is written; what a fresh snapshot must be like; checks of the domain."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Teams of a season, of which half are in the first conference; games that a team may be off the median; days a season's newest game may be old.
TEAMS, OFF_MEDIAN, DAYS_OLD = 30, 3, 3
#: Games of a regular season, where nothing else is said, and the first day from which box scores can prove a record.
SCHEDULE, PROVABLE = 82, "1996-10-01"


def _violations(checks: dict[str, Column]) -> list[Column]:
    return [F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in checks.items()]


def in_one_pass(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check and violations (rows of which the condition is not true, null included) of all checks, in one aggregation."""
    each = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks))
    return rows.agg(*_violations(checks)).select(F.explode(each).alias("c")).select("c.*")


def write_checked(rows: DataFrame, path: str, checks: dict[str, Column], **options: str) -> dict[str, int]:
    """Writes rows as Parquet to path (which must not exist) and counts every check's violations in the same job, as observed metrics. The table is written
    beside its place and moved there only if nothing is violated; else it is deleted and the counts are the error's message."""
    spark = rows.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place):
        raise FileExistsError(path)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    seen = Observation()
    rows.observe(seen, F.count("*").alias("_rows"), *_violations(checks)).write.options(**options).parquet(beside)
    found = dict(seen.get)
    staged = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)
    if any(found[n] for n in checks):
        fs.delete(staged, True)
        raise ValueError(f"{path}: " + ", ".join(f"{n}: {found[n]}" for n in checks if found[n]))
    if not fs.rename(staged, place):
        raise OSError(f"cannot move {beside} to {path}")
    return found


def freshness(games: DataFrame, box: DataFrame, team_seasons: DataFrame, player_seasons: DataFrame, shots: DataFrame, manifest: dict, in_season: bool = True) -> DataFrame:
    """id and ok of each freshness case; off season only those that always hold. A condition over an empty table that has no value is not ok.

    games: game, date. box: game, team (one row a player and game). team_seasons: season, season_type, conference, wins, losses, gp.
    player_seasons: season, season_type, points_per_game. shots: date. manifest: as_of and latest (dates as text), season, season_type,
    first_conference, registry and registry_here. Each table is aggregated once; the newest day's games meet their box scores by key.
    """
    day, latest = F.lit(manifest["as_of"]).cast("date"), F.lit(manifest["latest"]).cast("date")
    newest = F.max("date")
    g = games.agg((newest >= F.date_sub(day, DAYS_OLD)).alias("F01"), (newest == latest).alias("F02"), (F.count(F.when(F.col("date") > day, 1)) == 0).alias("F07"))
    sides = box.groupBy("game").agg(F.count_distinct("team").alias("sides"))
    b = games.where(F.col("date") == latest).select("game").join(sides, "game", "left").agg((F.count(F.when(F.coalesce("sides", F.lit(0)) < 2, 1)) == 0).alias("F03"))
    now = (F.col("season") == manifest["season"]) & (F.col("season_type") == manifest["season_type"])
    t = team_seasons.where(now).agg(
        ((F.count("*") == TEAMS) & (F.count(F.when(F.col("conference") == manifest["first_conference"], 1)) == TEAMS // 2)).alias("F04"), (F.sum("wins") == F.sum("losses")).alias("F05"), F.median("gp").alias("m"), F.max("gp").alias("most"), F.min("gp").alias("least")
    )
    t = t.select("F04", "F05", (F.greatest(F.col("most") - F.col("m"), F.col("m") - F.col("least")) <= OFF_MEDIAN).alias("F09"))
    p = player_seasons.where(now & F.col("points_per_game").isNotNull()).agg((F.count("*") > 0).alias("F06"))
    s = shots.where(F.col("date") == latest).agg((F.count("*") > 0).alias("F08"))
    one = g.crossJoin(b).crossJoin(t).crossJoin(p).crossJoin(s).withColumn("F10", F.lit(manifest["registry"] == manifest["registry_here"]))  # of one row each
    ids = [f"F{k:02d}" for k in range(1, 11) if in_season or k in (2, 3, 7, 10)]
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.coalesce(i, F.lit(False)).alias("ok")) for i in ids))).alias("c")).select("c.*")


def records_without_game(records: DataFrame, players: DataFrame, box: DataFrame, stats: list[str]) -> DataFrame:
    """Single-game records since PROVABLE whose named player has no game up to that day with exactly that value. records: record, record_kind, player, stat, value
    (text), valid_from (text or date); players: player_id, name; box: player_id, game_date and stats. Games meet records by player and value."""
    due = records.where((F.col("record_kind") == "single_game") & (F.col("valid_from").cast("date") >= F.lit(PROVABLE).cast("date")))
    named = due.join(players.select("player_id", F.col("name").alias("player")), "player")
    scores = F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("_value")) for s in stats))
    first = box.select("player_id", "game_date", F.inline(scores)).groupBy("player_id", "stat", "_value").agg(F.min("game_date").alias("_first"))
    proof = first.withColumnRenamed("stat", "_stat").withColumnRenamed("player_id", "_id")
    same = (F.col("player_id") == F.col("_id")) & (F.col("stat") == F.col("_stat")) & (F.expr("try_cast(value as double)") == F.col("_value")) & (F.col("_first") <= F.col("valid_from").cast("date"))
    return named.join(proof, same, "left_anti").select("record", "player", "value")


def current_teams(teams: DataFrame, expected: int = TEAMS) -> DataFrame:
    """A row with n and names if not exactly so many current teams with names of their own are there. teams: is_current, full_name."""
    return teams.where("is_current").agg(F.count("*").alias("n"), F.count_distinct("full_name").alias("names")).where((F.col("n") != expected) | (F.col("names") != expected))


def over_schedule(team_seasons: DataFrame, schedule: DataFrame, season_type: str, games: int = SCHEDULE) -> DataFrame:
    """Team seasons with more games than the season's schedule. schedule: season_start, max_games of the seasons that differ."""
    rows = team_seasons.where(F.col("season_type") == season_type).join(schedule.select(F.col("season_start").alias("_s"), "max_games"), F.col("season_start") == F.col("_s"), "left")
    return rows.withColumn("max_games", F.coalesce("max_games", F.lit(games))).where("gp > max_games").select("team", "season_start", "gp", "max_games")


def team_records_off(team_seasons: DataFrame, source: DataFrame, known: DataFrame, season_type: str) -> DataFrame:
    """Team seasons whose wins or losses are not the source's (team, season_start, gp, wins, losses), unless known (team, season_start, games_missing) explains exactly the games missing."""
    keys = ["team", "season_start"]
    other = source.select(*keys, F.col("gp").alias("source_gp"), F.col("wins").alias("source_wins"), F.col("losses").alias("source_losses"))
    off = team_seasons.where(F.col("season_type") == season_type).join(other, keys).where("wins <> source_wins or losses <> source_losses")
    explained = known.select(*keys, F.col("games_missing").alias("_missing"))
    return off.join(explained, keys, "left").where("_missing is null or source_gp - gp <> _missing").select(*keys, "wins", "losses", "source_wins", "source_losses")
