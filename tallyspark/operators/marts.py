"""The dataflow from landing tables to staging, marts and semantic views, each node a function of the frames before it.

Landing tables hold text; staging types it and keeps the newest fetch; marts hold one row for each natural key. as_of keeps a
kind of season only if all its games are up to the date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import blank_to_null, masked, periods, ratio, season_of_id, season_start, season_type, strip_accents, to_int, to_num
from .metrics import Base, compile_metrics
from .registry import METRICS, VERSION
from .series import eras
from .shaping import first_by, first_seasons, gated, latest_batch_per, latest_per, pair_rows, top_ranked, total_or_single, union_by_name

Frames = dict[str, DataFrame]

# The counted columns of a box score, and of a season row.
BOX = ("fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "oreb", "dreb", "reb", "ast", "stl", "blk", "tov", "pf", "pts")
REGULAR = "Regular Season"


def _ints(names, rename: dict[str, str] | None = None) -> list[Column]:
    return [to_int((rename or {}).get(n, n.upper())).alias(n) for n in names]


def _param(name: str) -> Column:
    return F.get_json_object("_params", f"$.{name}")


# --- staging ---------------------------------------------------------------------------------------------------------------


def stg_team_game(f: Frames) -> DataFrame:
    rows = latest_per(f["leaguegamelog_t__leaguegamelog"], ["GAME_ID", "TEAM_ID"], "_fetched_at", [F.col("_file")])
    return rows.select(
        F.col("GAME_ID").alias("game_id"), season_of_id("SEASON_ID").alias("season"), season_type("GAME_ID").alias("season_type"), F.col("GAME_DATE").cast("date").alias("game_date"), to_int("TEAM_ID").alias("team_id"),
        F.col("TEAM_ABBREVIATION").alias("team_abbreviation"), F.col("TEAM_NAME").alias("team_name"), F.col("MATCHUP").alias("matchup"), F.col("MATCHUP").like("% vs. %").alias("is_home"), blank_to_null("WL").alias("wl"),
        *_ints(("minutes", *BOX, "plus_minus"), {"minutes": "MIN"}), F.col("_fetched_at").try_cast("timestamp").alias("fetched_at"),
    )


def stg_player_game(f: Frames) -> DataFrame:
    """A player listed under both teams keeps the row that reconciles its team's score, then more points, more minutes, lower team."""
    rows = latest_per(f["leaguegamelog_p__leaguegamelog"], ["GAME_ID", "PLAYER_ID", "TEAM_ID"], "_fetched_at", [F.col("_file")]).select(
        F.col("GAME_ID").alias("game_id"), season_of_id("SEASON_ID").alias("season"), season_type("GAME_ID").alias("season_type"), F.col("GAME_DATE").cast("date").alias("game_date"), to_int("PLAYER_ID").alias("player_id"),
        F.col("PLAYER_NAME").alias("player_name"), to_int("TEAM_ID").alias("team_id"), F.col("MATCHUP").alias("matchup"), blank_to_null("WL").alias("wl"), *_ints(("minutes", *BOX, "plus_minus"), {"minutes": "MIN"}),
        F.col("_fetched_at").try_cast("timestamp").alias("fetched_at"),
    )
    twice = rows.groupBy("game_id", "player_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    others = rows.join(twice, ["game_id", "player_id"], "left_anti").groupBy("game_id", "team_id").agg(F.sum("pts").alias("_others"))
    stated = f["stg_team_game"].select("game_id", "team_id", F.col("pts").alias("_stated"))
    rows = rows.join(others, ["game_id", "team_id"], "left").join(stated, ["game_id", "team_id"], "left")
    fits = F.col("_others") + F.col("pts") == F.col("_stated")
    order = [fits.desc_nulls_last(), F.col("pts").desc_nulls_last(), F.col("minutes").desc_nulls_last(), F.col("team_id")]
    return first_by(rows, ["game_id", "player_id"], order).drop("_others", "_stated")


def stg_player_season_rows(f: Frames) -> DataFrame:
    parts = []
    for name, kind in (("SeasonTotalsRegularSeason", REGULAR), ("SeasonTotalsPostSeason", "Playoffs")):
        rows = latest_batch_per(f[f"playercareerstats__{name.lower()}"], ["_key"], "_fetched_at")
        parts.append(rows.withColumn("season_type", F.lit(kind)))
    return union_by_name(parts).select(
        to_int("PLAYER_ID").alias("player_id"), F.col("SEASON_ID").alias("season"), season_start("SEASON_ID").alias("season_start"), "season_type", to_int("TEAM_ID").alias("team_id"), F.col("TEAM_ABBREVIATION").alias("team_abbreviation"),
        (to_int("TEAM_ID") == 0).alias("is_total_row"), to_num("PLAYER_AGE").cast("int").alias("player_age"), *_ints(("gp", "gs")), to_num("MIN").alias("minutes"), *_ints(BOX),
    )


def stg_player_career_totals(f: Frames) -> DataFrame:
    parts = []
    for name, kind in (("CareerTotalsRegularSeason", REGULAR), ("CareerTotalsPostSeason", "Playoffs")):
        parts.append(latest_batch_per(f[f"playercareerstats__{name.lower()}"], ["_key"], "_fetched_at").withColumn("season_type", F.lit(kind)))
    return union_by_name(parts).select(to_int("PLAYER_ID").alias("player_id"), "season_type", to_int("GP").alias("gp"), to_num("MIN").alias("minutes"), *_ints(("fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "reb", "ast", "stl", "blk", "tov", "pts")))


def stg_players(f: Frames) -> DataFrame:
    roster = latest_per(f["commonallplayers__commonallplayers"], ["PERSON_ID"], "_fetched_at", [F.col("_file")])
    info = latest_per(f["commonplayerinfo__commonplayerinfo"], ["PERSON_ID"], "_fetched_at", [F.col("_file")]).select(
        "PERSON_ID", *(F.col(c).alias(f"i_{c}") for c in ("FIRST_NAME", "LAST_NAME", "BIRTHDATE", "POSITION", "DRAFT_YEAR"))
    )
    whole = F.col("DISPLAY_FIRST_LAST")
    return roster.join(info, "PERSON_ID", "left").select(
        to_int("PERSON_ID").alias("player_id"), whole.alias("name"),
        F.coalesce(blank_to_null("i_FIRST_NAME"), blank_to_null(F.when(whole.contains(" "), F.substring_index(whole, " ", 1)))).alias("first_name"),
        F.coalesce(blank_to_null("i_LAST_NAME"), F.trim(F.split_part("DISPLAY_LAST_COMMA_FIRST", F.lit(","), F.lit(1)))).alias("last_name"),
        F.substring("i_BIRTHDATE", 1, 10).try_cast("date").alias("birth_date"), blank_to_null("i_POSITION").alias("position"), to_int("FROM_YEAR").alias("from_year"), to_int("TO_YEAR").alias("to_year"),
        (to_int("ROSTERSTATUS") == 1).alias("active"), (F.col("GAMES_PLAYED_FLAG") == "Y").alias("played"), blank_to_null("i_DRAFT_YEAR").alias("draft_year"),
    )


def _advanced(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    rows = latest_batch_per(rows, ["_key"], "_fetched_at")
    return rows.select(to_int(key.upper()).alias(key), _param("Season").alias("season"), _param("SeasonType").alias("season_type"), to_int("GP").alias("gp"), *(to_num(c).alias(n) for n, c in columns.items()))


def stg_player_advanced(f: Frames) -> DataFrame:
    names = {"usg_pct": "USG_PCT", "ts_pct_published": "TS_PCT", "efg_pct_published": "EFG_PCT", "off_rating": "OFF_RATING", "def_rating": "DEF_RATING", "net_rating": "NET_RATING", "pace": "PACE", "pie": "PIE"}
    return _advanced(f["leaguedashplayerstats_adv__leaguedashplayerstats"], "player_id", names)


def stg_team_advanced(f: Frames) -> DataFrame:
    names = {"off_rating": "OFF_RATING", "def_rating": "DEF_RATING", "net_rating": "NET_RATING", "pace": "PACE", "ts_pct_published": "TS_PCT", "poss": "POSS"}
    return _advanced(f["leaguedashteamstats_adv__leaguedashteamstats"], "team_id", names)


def stg_team_year(f: Frames) -> DataFrame:
    rows = latest_batch_per(f["teamyearbyyearstats__teamstats"], ["_key"], "_fetched_at")
    return rows.select(
        to_int("TEAM_ID").alias("team_id"), F.col("TEAM_CITY").alias("city"), F.col("TEAM_NAME").alias("name"), F.col("YEAR").alias("season"), season_start("YEAR").alias("season_start"),
        *_ints(("gp", "wins", "losses", "conf_rank", "div_rank", "po_wins", "po_losses")), F.nullif(F.col("NBA_FINALS_APPEARANCE"), F.lit("N/A")).alias("finals_result"), to_int("PTS").alias("pts"),
    )


def stg_standings(f: Frames) -> DataFrame:
    rows = latest_batch_per(f["leaguestandingsv3__standings"], ["_key"], "_fetched_at")
    names = {"conference_rank": "PlayoffRank", "league_rank": "LeagueRank", "wins": "WINS", "losses": "LOSSES", "longest_win_streak": "LongWinStreak", "longest_loss_streak": "LongLossStreak"}
    return rows.select(
        to_int("TeamID").alias("team_id"), season_of_id("SeasonID").alias("season"), F.col("Conference").alias("conference"), F.col("Division").alias("division"), *(to_int(c).alias(n) for n, c in names.items()),
        F.col("HOME").alias("home_record"), F.col("ROAD").alias("road_record"),
    )


def stg_franchise_history(f: Frames) -> DataFrame:
    parts = [latest_batch_per(f[f"franchisehistory__{n}"], ["_key"], "_fetched_at").withColumn("defunct", F.lit(n == "defunctteams")) for n in ("franchisehistory", "defunctteams")]
    rows = union_by_name(parts).select(
        to_int("TEAM_ID").alias("team_id"), F.col("TEAM_CITY").alias("city"), F.col("TEAM_NAME").alias("name"), to_int("START_YEAR").alias("start_year"), to_int("END_YEAR").alias("end_year"), to_int("YEARS").alias("years"),
        to_int("LEAGUE_TITLES").alias("league_titles"), "defunct",
    )
    w = Window.partitionBy("team_id").orderBy(F.col("years").desc_nulls_last(), F.col("start_year").asc_nulls_last(), "name")
    return rows.withColumn("is_franchise_row", F.row_number().over(w) == 1).drop("years")


def stg_awards(f: Frames) -> DataFrame:
    rows = latest_batch_per(f["playerawards__playerawards"], ["_key"], "_fetched_at")
    blanks = {"team_name": "TEAM", "team_number": "ALL_NBA_TEAM_NUMBER", "conference": "CONFERENCE", "month": "MONTH", "week": "WEEK", "award_type": "TYPE", "subtype1": "SUBTYPE1", "subtype2": "SUBTYPE2"}
    return rows.select(to_int("PERSON_ID").alias("player_id"), F.col("DESCRIPTION").alias("award"), F.col("SEASON").alias("season"), season_start("SEASON").alias("season_start"), *(blank_to_null(c).alias(n) for n, c in blanks.items()))


def stg_shots(f: Frames) -> DataFrame:
    rows = latest_batch_per(f["shotchartdetail__shot_chart_detail"], ["_key"], "_fetched_at")
    names = {"game_event_id": "GAME_EVENT_ID", "player_id": "PLAYER_ID", "team_id": "TEAM_ID", "period": "PERIOD", "minutes_remaining": "MINUTES_REMAINING", "seconds_remaining": "SECONDS_REMAINING", "distance_ft": "SHOT_DISTANCE", "x": "LOC_X", "y": "LOC_Y"}
    words = {"action_type": "ACTION_TYPE", "shot_type": "SHOT_TYPE", "zone": "SHOT_ZONE_BASIC", "zone_area": "SHOT_ZONE_AREA", "zone_range": "SHOT_ZONE_RANGE"}
    return rows.select(
        F.col("GAME_ID").alias("game_id"), _param("Season").alias("season"), season_type("GAME_ID").alias("season_type"), F.to_date("GAME_DATE", "yyyyMMdd").alias("game_date"),
        *(to_int(c).alias(n) for n, c in names.items()), *(F.col(c).alias(n) for n, c in words.items()), (F.col("SHOT_MADE_FLAG") == "1").alias("made"),
    )


def int_season_type_status(f: Frames, as_of: str | None) -> DataFrame:
    rows = f["stg_team_game"].where(F.col("season_type").isNotNull()).groupBy("season", "season_type").agg(F.min("game_date").alias("first_game_date"), F.max("game_date").alias("last_game_date"), F.count_distinct("game_id").alias("games"))
    cut = F.lit(as_of).cast("date")
    inside = (F.col("first_game_date") <= cut) & (F.col("last_game_date") > cut)
    return rows.withColumns({"season_start": season_start("season"), "included": F.lit(as_of is None) | F.coalesce(F.col("last_game_date") <= cut, F.lit(False)), "straddles_cutoff": F.coalesce(inside, F.lit(False))})


# --- marts -----------------------------------------------------------------------------------------------------------------

_PERIOD = ["season", "season_type"]


def games(f: Frames) -> DataFrame:
    rows = f["stg_team_game"].join(F.broadcast(f["tiebreaker_games"].select("game_id", F.lit("Tiebreaker").alias("_kind"))), "game_id", "left")  # a seed of a few rows
    rows = rows.withColumn("season_type", F.coalesce("_kind", "season_type")).where(~(F.col("wl").isNull() & (F.coalesce("minutes", F.lit(0)) == 0)))
    status = f["int_season_type_status"]
    # tiebreakers are no kind of season of their own: they are cut by their dates
    ties = rows.where(F.col("_kind").isNotNull() & (F.lit(f["_as_of"] is None) | (F.col("game_date") <= F.lit(f["_as_of"]).cast("date")))).withColumn("_g", F.col("_kind"))
    rows = gated(rows.withColumn("_g", F.coalesce("_kind", "season_type")), status.select("season", F.col("season_type").alias("_g"), "included"), ["season", "_g"]).unionByName(ties)
    shared = rows.groupBy("game_id").agg(F.min("season").alias("season"), F.min("season_type").alias("season_type"), F.min("game_date").alias("game_date"), F.max("minutes").alias("minutes"))
    paired = pair_rows(rows, "game_id", "team_id", "is_home", ["team_id", "pts"]).join(shared, "game_id")
    home, away = F.col("home_pts"), F.col("away_pts")
    return paired.select(
        "game_id", "season", season_start("season").alias("season_start"), "season_type", "game_date", "home_team_id", "away_team_id", "home_pts", "away_pts",
        F.when(home > away, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("winner_team_id"), F.abs(home - away).alias("margin"), periods("minutes").alias("periods"), (F.col("minutes") > 240).alias("overtime"),
        "is_neutral", (F.substring("game_id", 1, 3) == "006").alias("is_cup_final"),
    )


def _tracked(columns, first: dict[str, int]) -> dict[str, Column]:
    return {c: masked(c, "season_start", first.get(c)).alias(c) for c in columns}


def player_game(f: Frames) -> DataFrame:
    kinds = f["games"].select("game_id", F.col("season_type").alias("_kind"))
    rows = f["stg_player_game"].join(kinds, "game_id").withColumns({"season_type": F.col("_kind"), "season_start": season_start("season")})
    rows = rows.withColumns(_tracked(("minutes", *BOX, "plus_minus"), f["_first"]))
    return rows.select("game_id", "player_id", "team_id", "season", "season_start", "season_type", "game_date", "matchup", "wl", "minutes", *BOX, "plus_minus")


def player_season(f: Frames) -> DataFrame:
    """The source's own total row for players of several teams, else the only row; stints are never summed."""
    keys = ["player_id", *_PERIOD]
    rows = gated(f["stg_player_season_rows"], f["int_season_type_status"], _PERIOD)
    teams = rows.where(~F.col("is_total_row")).groupBy(*keys).agg(F.count("*").alias("team_count"))
    stints = rows.where(~F.col("is_total_row")).select(*keys, "team_id").distinct().withColumn("_listed", F.lit(1))
    log = f["stg_player_game"].join(stints, [*keys, "team_id"], "left")
    first = log.groupBy(*keys, "team_id").agg(F.min("game_date").alias("_first"))
    last = first_by(log.join(first, [*keys, "team_id"]), keys, [F.col("game_date").desc(), F.col("_listed").desc_nulls_last(), F.col("_first").desc(), F.col("game_id").desc()]).select(*keys, F.col("team_id").alias("last_team_id"))
    rows = total_or_single(rows, keys, "is_total_row").join(teams, keys, "left").join(last, keys, "left")
    rows = rows.withColumns(_tracked(("gs", "minutes", *BOX), f["_first"]))
    return rows.select("player_id", "season", "season_start", "season_type", "team_count", "last_team_id", "player_age", "gp", "gs", "minutes", *BOX)


def player_season_stint(f: Frames) -> DataFrame:
    rows = gated(f["stg_player_season_rows"].where(~F.col("is_total_row")), f["int_season_type_status"], _PERIOD).withColumns(_tracked(("gs", "minutes", *BOX), f["_first"]))
    return rows.select("player_id", "season", "season_start", "season_type", "team_id", "team_abbreviation", "player_age", "gp", "gs", "minutes", *BOX)


def team_season(f: Frames) -> DataFrame:
    settled, keys = ~F.col("is_neutral"), ["team_id", *_PERIOD]
    entries = F.array(
        F.struct(F.col("home_team_id").alias("team_id"), F.lit("home").alias("role"), F.col("home_pts").alias("own"), F.col("away_pts").alias("opp")),
        F.struct(F.col("away_team_id").alias("team_id"), F.lit("road").alias("role"), F.col("away_pts").alias("own"), F.col("home_pts").alias("opp")),
    )
    rows = f["games"].select("season", "season_start", "season_type", "is_neutral", F.explode(entries).alias("r")).select("*", "r.*")
    won, lost = F.col("own") > F.col("opp"), F.col("own") < F.col("opp")
    home, road = settled & (F.col("role") == "home"), settled & (F.col("role") == "road")
    count = lambda cond, name: F.count_if(cond).alias(name)
    record = rows.groupBy("team_id", "season", "season_start", "season_type").agg(
        F.count("*").alias("gp"), count(won, "wins"), count(lost, "losses"), count(won & home, "home_wins"), count(lost & home, "home_losses"),
        count(won & road, "road_wins"), count(lost & road, "road_losses"), count(F.col("is_neutral"), "neutral_games"), F.sum("own").alias("pts"), F.sum("opp").alias("opp_pts"),
    )
    kinds = f["games"].select("game_id", F.col("season_type").alias("_kind"))
    box = f["stg_team_game"].join(kinds, "game_id").withColumn("season_type", F.col("_kind"))
    counted = [c for c in BOX if c in ("fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "reb", "ast", "tov")]
    sums = box.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counted))
    settled_table = gated(f["stg_standings"].withColumn("season_type", F.lit(REGULAR)), f["int_season_type_status"], _PERIOD)
    table = settled_table.select("team_id", "season", "season_type", "conference", "division", "conference_rank", "league_rank")
    year = f["stg_team_year"].select("team_id", "season", F.col("conf_rank").alias("_rank")).withColumn("season_type", F.lit(REGULAR))
    advanced = f["stg_team_advanced"].select(*keys, "off_rating", "def_rating", "net_rating", "pace")
    out = record.join(sums, keys, "left").join(table, keys, "left").join(year, keys, "left").join(advanced, keys, "left")
    out = out.withColumns({"franchise_id": F.col("team_id"), "win_pct": ratio("wins", "gp"), "conference_rank": F.coalesce("conference_rank", "_rank")})
    return out.drop("_rank")


def team_titles(f: Frames) -> DataFrame:
    done = f["int_season_type_status"].where("season_type = 'Playoffs' and included").select("season")
    rows = f["stg_team_year"].join(done, "season", "left_semi")
    name = F.concat_ws(" ", "city", "name")
    champions = rows.where("finals_result = 'LEAGUE CHAMPION'").select(F.col("team_id").alias("franchise_id"), "team_id", "season", "season_start", name.alias("champion_name"))
    losers = rows.where("finals_result = 'FINALS APPEARANCE'").select("season", F.col("team_id").alias("opponent_team_id"), name.alias("opponent_name"))
    return champions.join(losers, "season", "left")


def player_titles(f: Frames) -> DataFrame:
    won = f["team_titles"].select("season", "season_start", F.col("team_id"), "franchise_id")
    played = f["player_season_stint"].where("season_type = 'Playoffs' and gp > 0").select("player_id", "season", "team_id")
    return played.join(won, ["season", "team_id"]).select("player_id", "season", "season_start", "franchise_id").distinct()


def awards(f: Frames) -> DataFrame:
    status = f["int_season_type_status"].groupBy("season").agg(F.coalesce(F.bool_or(F.when(F.col("season_type") == REGULAR, F.col("included"))), F.lit(False)).alias("_regular"), F.coalesce(F.bool_or(F.when(F.col("season_type") == "Playoffs", F.col("included"))), F.lit(False)).alias("_over"))
    rows = f["stg_awards"].join(F.broadcast(f["award_timing"]), "award", "left").join(status, "season")  # a seed of a few rows
    known = F.when(F.col("known_at") == "regular_season_end", F.col("_regular")).otherwise(F.col("_over"))
    return rows.where(known).select("player_id", "season", "season_start", "award", "award_type", "team_name", "team_number", "conference", "month", "week")


# The records that box scores give, by statistic.
RECORDS = {"pts": "Most points in a game", "fg3m": "Most 3-pointers made in a game", "reb": "Most rebounds in a game", "ast": "Most assists in a game"}


def records(f: Frames) -> DataFrame:
    """The ten best games of a regular season by statistic, ties included, and the curated records known by the cutoff."""
    rows = f["player_game"].where(F.col("season_type") == REGULAR)
    top = top_ranked(rows, {label: stat for stat, label in RECORDS.items()}, 10, ["player_id", "game_id", "game_date", "season", "season_type"])
    stat = F.element_at(F.create_map(*(F.lit(x) for pair in RECORDS.items() for x in reversed(pair))), F.col("record"))
    top = top.select("record", F.lit("single_game").alias("record_kind"), stat.alias("stat"), "player_id", "game_id", "game_date", "season", "season_type", "value", F.col("game_date").alias("valid_from"), F.lit("nba_api leaguegamelog").alias("source"))
    people = f["players"].select("player_id", F.col("name").alias("player"))
    hand = f["records_curated"].join(people, "player", "left").select("record", "record_kind", "stat", "player_id", to_num("value").alias("value"), F.col("valid_from").try_cast("date").alias("valid_from"), F.col("source_url").alias("source"))
    if f["_as_of"] is not None:
        hand = hand.where(F.col("valid_from") <= F.lit(f["_as_of"]).cast("date"))
    return top.unionByName(hand, allowMissingColumns=True)


def players(f: Frames) -> DataFrame:
    rookie = f["player_season"].where(F.col("season_type") == REGULAR).groupBy("player_id").agg(F.min("season").alias("rookie_season"))
    rows = f["stg_players"].join(rookie, "player_id", "left").where(F.col("played") | F.col("rookie_season").isNotNull())
    return rows.select("player_id", "name", "first_name", "last_name", "birth_date", "position", "from_year", "to_year", "active", "draft_year", "rookie_season")


def player_aliases(f: Frames) -> DataFrame:
    """One row for each player and normalised spelling: the full name first, then by spelling, curated ones first, and kind. A
    curated alias belongs to its best-known holder, the one with most seasons."""
    p = f["players"]
    one = lambda column, kind, rows=p: rows.select("player_id", column.alias("alias"), F.lit(kind).alias("kind"), F.lit(False).alias("_curated"))
    alone = p.join(p.groupBy("last_name").agg(F.count("*").alias("n")).where("n = 1").select("last_name"), "last_name", "left_semi")
    seed = f["player_alias_seed"].join(p.select("player_id", F.col("name").alias("player_name"), "from_year", "to_year"), "player_name")
    seed = first_by(seed, ["alias"], [(F.col("to_year") - F.col("from_year")).desc_nulls_last(), F.col("player_id")]).select("player_id", "alias", "kind", F.lit(True).alias("_curated"))
    plain, last = strip_accents("name"), strip_accents("last_name")
    sources = [
        one(F.col("name"), "full name"), one(plain, "accent-free", p.where(plain != F.col("name"))), one(strip_accents(F.replace("name", F.lit("."), F.lit(""))), "no periods", p.where(F.col("name").contains("."))),
        one(F.col("last_name"), "last name", alone), one(last, "last name", alone.where(last != F.col("last_name"))), seed,
    ]
    rows = reduce(DataFrame.unionByName, sources).withColumn("alias_norm", F.lower(strip_accents("alias")))
    return first_by(rows, ["player_id", "alias_norm"], [(F.col("kind") == "full name").desc(), F.col("alias"), F.col("_curated").desc(), F.col("kind")]).select("player_id", "alias", "alias_norm", "kind")


def teams(f: Frames) -> DataFrame:
    years = f["stg_team_year"].withColumn("franchise_id", F.col("team_id"))
    spans = eras(years, ["team_id", "franchise_id"], "season_start", ["city", "name"])
    newest = years.agg(F.max("season_start").alias("_newest"))
    return spans.join(F.broadcast(newest)).select(  # one row
        "team_id", "franchise_id", "city", "name", F.concat_ws(" ", "city", "name").alias("full_name"), F.col("first_step").alias("first_season_start"), F.col("last_step").alias("last_season_start"),
        F.make_date("first_step", F.lit(8), F.lit(1)).alias("valid_from"), F.make_date(F.col("last_step") + 1, F.lit(7), F.lit(31)).alias("valid_to"), (F.col("last_step") == F.col("_newest")).alias("is_current"),
    )


def team_aliases(f: Frames) -> DataFrame:
    """Names of today's teams, their abbreviation in the newest season's last game, and curated nicknames, in this order."""
    t = f["teams"].where("is_current")
    log = f["stg_team_game"]
    newest = log.agg(F.max("season").alias("season"))  # one row
    short = log.join(F.broadcast(newest), "season", "left_semi").groupBy("team_id").agg(F.max_by("team_abbreviation", "game_id").alias("abbreviation"))
    seed = f["team_alias_seed"].join(short, F.col("team_abbreviation") == F.col("abbreviation")).select("team_id", "alias", F.lit("nickname").alias("kind"), F.lit(4).alias("_order"))
    names = ((t, "full_name", "full name"), (t, "name", "name"), (t, "city", "city"), (short, "abbreviation", "abbreviation"))
    sources = [rows.select("team_id", F.col(c).alias("alias"), F.lit(kind).alias("kind"), F.lit(k).alias("_order")) for k, (rows, c, kind) in enumerate(names)]
    rows = reduce(DataFrame.unionByName, [*sources, seed]).withColumn("alias_norm", F.lower("alias"))
    return first_by(rows, ["team_id", "alias_norm"], [F.col("_order"), F.col("alias")]).select("team_id", "alias", "alias_norm", "kind")


def franchises(f: Frames) -> DataFrame:
    rows = f["stg_franchise_history"].where("is_franchise_row")
    return rows.select(F.col("team_id").alias("franchise_id"), F.concat_ws(" ", "city", "name").alias("current_name"), "start_year", "end_year", "defunct")


def player_advanced(f: Frames) -> DataFrame:
    return gated(f["stg_player_advanced"], f["int_season_type_status"], _PERIOD).withColumn("season_start", season_start("season"))


def shots(f: Frames) -> DataFrame:
    return gated(f["stg_shots"], f["int_season_type_status"], _PERIOD)


def stat_availability(f: Frames) -> DataFrame:
    return f["seed_availability"].select("stat", "first_season", to_int("first_season_start").alias("first_season_start"), "note")


STAGING = (stg_team_game, stg_player_game, stg_player_season_rows, stg_player_career_totals, stg_players, stg_player_advanced, stg_team_advanced, stg_team_year, stg_standings, stg_franchise_history, stg_awards, stg_shots)
MARTS = (stat_availability, games, player_game, player_season, player_season_stint, team_season, team_titles, player_titles, awards, players, records, player_aliases, teams, team_aliases, franchises, player_advanced, shots)


def build(landing: Frames, seeds: Frames, as_of: str | None = None, keep=lambda name, df: df) -> Frames:
    """All staging and mart frames. keep(name, df) may write each mart and give back what was written; a cutoff inside a kind
    of season is an error."""
    f: Frames = {**landing, **seeds, "_as_of": as_of}
    for node in STAGING:
        f[node.__name__] = keep(node.__name__, node(f))
    f["int_season_type_status"] = keep("int_season_type_status", int_season_type_status(f, as_of))
    inside = f["int_season_type_status"].where("straddles_cutoff").limit(1).collect()
    if inside:
        raise ValueError(f"the cutoff {as_of} falls inside {inside[0]['season_type']} {inside[0]['season']}")
    f["stat_availability"] = stat_availability(f)
    f["_first"] = first_seasons(f["stat_availability"])  # a small dictionary
    for node in MARTS[1:]:
        f[node.__name__] = keep(node.__name__, node(f))
    return f


# --- semantic views --------------------------------------------------------------------------------------------------------


def _era(rows: DataFrame, f: Frames, team: str, name: str) -> DataFrame:
    """rows with the full name that a team had in the season."""
    t = f["teams"].select(F.col("team_id").alias("_t"), F.col("first_season_start").alias("_from"), F.col("last_season_start").alias("_to"), F.col("full_name").alias(name))
    return rows.join(t, (F.col(team) == F.col("_t")) & F.col("season_start").between(F.col("_from"), F.col("_to")), "left").drop("_t", "_from", "_to")


def semantic(f: Frames) -> Frames:
    """The twenty views: seven of metrics at their grain, the enriched marts, and the registry itself."""
    spark = f["games"].sparkSession
    ps, pk = f["player_season"], ("player_id", "season", "season_type")
    by_player = {
        "player_season": Base(ps, pk), "player_advanced": Base(f["player_advanced"], pk), "player_game": Base(f["player_game"], pk), "shots": Base(f["shots"], pk),
    }
    career = {n: Base(b.rows, ("player_id", "season_type")) for n, b in by_player.items()}
    regular = f"season_type = '{REGULAR}'"
    career |= {"awards": Base(f["awards"], ("player_id",), regular), "player_titles": Base(f["player_titles"], ("player_id",), regular)}
    ts, tk = f["team_season"], ("team_id", "season", "season_type")
    games_of_team = ts.select(*tk, F.col("gp").alias("team_gp"))
    people = f["players"].select("player_id", F.col("name").alias("player_name"), "rookie_season")
    names = people.drop("rookie_season")
    team_name = lambda rows, team="team_id", name="team_name": _era(rows, f, team, name)
    spine = team_name(ps.withColumnRenamed("last_team_id", "team_id").join(people, "player_id").join(games_of_team, list(tk), "left"))
    spine = spine.select("player_id", "player_name", "season", "season_start", "season_type", "team_count", "team_id", "team_name", "gp", "team_gp", (F.col("rookie_season") == F.col("season")).alias("is_rookie_season"))
    sums = ps.join(names, "player_id").groupBy("player_id", "player_name", "season_type").agg(F.count("*").alias("seasons"), F.min("season").alias("first_season"), F.max("season").alias("last_season"))
    league = ts.groupBy("season", "season_start", "season_type").agg(F.countDistinct("team_id").alias("teams"), *(F.sum(c).alias(c) for c in ("pts", "gp", "fga", "fg3a")))
    kinds = ts.select("season_type").distinct()
    stint = f["player_season_stint"]
    sk = ("player_id", "season", "season_type", "team_id")
    stints = team_name(stint.select(*sk, "season_start", "gp").join(names, "player_id").join(games_of_team, list(tk), "left"))
    stints = stints.select("player_id", "player_name", "season", "season_start", "season_type", "team_id", "team_name", "gp", "team_gp")
    log = f["player_game"].join(names, "player_id").select("game_id", "player_id", "player_name", "team_id", "season", "season_type", "game_date", "matchup", "wl", "minutes", *BOX, "plus_minus")
    of_team = team_name(ts.select(*tk, "season_start", "conference", "division", "conference_rank", "league_rank", "gp", "neutral_games"))
    all_time = f["franchises"].select("franchise_id", F.col("current_name").alias("team_name")).join(F.broadcast(kinds))  # a few kinds of season
    titles = f["team_titles"].select("franchise_id")
    out = {
        "sem_player_season_stats": compile_metrics(spine, by_player, METRICS.at("season")),
        "sem_player_career_stats": compile_metrics(sums, career, METRICS.at("career")),
        "sem_player_stint_stats": compile_metrics(stints, {"player_season": Base(stint, sk)}, METRICS.at("stint")),
        "sem_player_game_log": compile_metrics(log, {"player_game": Base(f["player_game"].select("game_id", "player_id", "pts"), ("game_id", "player_id"))}, METRICS.at("game")),
        "sem_team_season_stats": compile_metrics(of_team, {"team_season": Base(ts, tk)}, METRICS.at("team_season")),
        "sem_team_all_time_stats": compile_metrics(all_time, {"team_season": Base(ts, ("franchise_id", "season_type")), "team_titles": Base(titles, ("franchise_id",))}, METRICS.at("team_all_time")),
        "sem_league_season_stats": compile_metrics(league.select("season", "season_start", "season_type", "teams"), {"league_season": Base(league, ("season", "season_type"))}, METRICS.at("league_season")),
        "sem_games": team_name(team_name(f["games"], "home_team_id", "home_team_name"), "away_team_id", "away_team_name"), "sem_shots": f["shots"].join(names, "player_id"), "sem_awards": f["awards"].join(names, "player_id"),
        "sem_records": f["records"].join(names, "player_id", "left"), "sem_player_titles": f["player_titles"].join(names, "player_id"),
    }
    for name in ("players", "player_aliases", "team_aliases", "teams", "franchises", "stat_availability", "team_titles"):
        out[f"sem_{name}"] = f[name]
    out["sem_registry_info"] = spark.createDataFrame([(VERSION, len(METRICS.metrics))], "registry_version string, metric_count int")
    return out
