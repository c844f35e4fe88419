"""A small made-up league as landing tables: two seasons, four teams, and the cases that the dataflow must get right."""

from __future__ import annotations

import itertools
import random

T = {1: ("Harbor", "Gulls", "HAR"), 2: ("Mesa", "Foxes", "MES"), 3: ("Delta", "Kites", "DEL"), 4: ("Summit", "Owls", "SUM")}
META = "_key string, _partition string, _file string, _fetched_at string, _params string"
BOX = "FGM FGA FG3M FG3A FTM FTA OREB DREB REB AST STL BLK TOV PF PTS PLUS_MINUS".split()
GAME = ["SEASON_ID", "TEAM_ID", "TEAM_ABBREVIATION", "TEAM_NAME", "GAME_ID", "GAME_DATE", "MATCHUP", "WL", "MIN", *BOX]
PLAYER_GAME = ["SEASON_ID", "PLAYER_ID", "PLAYER_NAME", "TEAM_ID", "GAME_ID", "GAME_DATE", "MATCHUP", "WL", "MIN", *BOX]
SEASON = ["PLAYER_ID", "SEASON_ID", "TEAM_ID", "TEAM_ABBREVIATION", "PLAYER_AGE", "GP", "GS", "MIN", *BOX[:-1]]
CAREER = ["PLAYER_ID", "TEAM_ID", "GP", "GS", "MIN", *BOX[:-1]]
PEOPLE = {10 * t + k: f"{f} {n}" for t, names in {1: [("Ana", "Novák"), ("Bo", "Lind"), ("Cy", "Moss")], 2: [("Di", "Ruiz"), ("Ed", "Moss"), ("Flo", "Day")], 3: [("Gus", "O'Dea"), ("Hal", "Ito"), ("Ike", "Bay")], 4: [("Jo", "St. Cyr"), ("Kim", "Poe"), ("Lu", "Vance")]}.items() for k, (f, n) in enumerate(names, 1)}
SWAP = 23  # changes from team 2 to team 3 after the first half of 2023-24


def line(r: random.Random, minutes: int) -> dict[str, int]:
    x = {"FG3M": r.randint(0, 4), "FTM": r.randint(0, 6)}
    two = r.randint(1, 9)
    x |= {"FGM": two + x["FG3M"], "FG3A": x["FG3M"] + r.randint(0, 4), "FTA": x["FTM"] + r.randint(0, 2), "OREB": r.randint(0, 4), "DREB": r.randint(0, 8)}
    x |= {"FGA": x["FGM"] + r.randint(0, 9), "REB": x["OREB"] + x["DREB"], "AST": r.randint(0, 12), "STL": r.randint(0, 3), "BLK": r.randint(0, 3), "TOV": r.randint(0, 4), "PF": r.randint(0, 5), "PTS": 2 * two + 3 * x["FG3M"] + x["FTM"], "PLUS_MINUS": r.randint(-10, 10)}
    return x | {"MIN": minutes}


def league() -> tuple[dict[str, tuple[list[str], list[tuple]]], dict]:
    """Landing tables by name (columns, rows of text), and what a test needs to know."""
    r = random.Random(7)
    teams, people, facts = [], [], {"player": {}, "games": {}}
    n = itertools.count(1)

    def play(season: int, kind: str, home: int, away: int, day: str, over: bool = False, neutral: bool = False):
        game = f"{kind}{season % 100:02d}{next(n):05d}"
        scores = {}
        for t in (home, away):
            own = [p for p in PEOPLE if p // 10 == t and p != SWAP]
            if (t == 2 and day < "2024-01-01") or (t == 3 and day >= "2024-01-01"):
                own.append(SWAP)
            lines = {p: line(r, 30) for p in own}
            scores[t] = (sum(x["PTS"] for x in lines.values()), lines)
        if scores[home][0] == scores[away][0]:
            p = next(iter(scores[home][1]))
            scores[home][1][p]["PTS"] += 1
            scores[home][1][p]["FTM"] += 1
            scores[home] = (scores[home][0] + 1, scores[home][1])
        for t, other in ((home, away), (away, home)):
            sign = "@" if neutral or t == away else "vs."
            shared = {"SEASON_ID": f"2{season}", "TEAM_ID": t, "GAME_ID": game, "GAME_DATE": day, "MATCHUP": f"{T[t][2]} {sign} {T[other][2]}", "WL": "W" if scores[t][0] > scores[other][0] else "L"}
            total = {k: sum(x[k] for x in scores[t][1].values()) for k in BOX}
            teams.append(shared | total | {"TEAM_ABBREVIATION": T[t][2], "TEAM_NAME": " ".join(T[t][:2]), "MIN": 265 if over else 240, "_f": "2024-06-01"})
            for p, x in scores[t][1].items():
                people.append(shared | x | {"PLAYER_ID": p, "PLAYER_NAME": PEOPLE[p], "_f": "2024-06-01"})
                kinds = {"002": "Regular Season", "004": "Playoffs"}
                if kind in kinds:
                    facts["player"].setdefault((p, season, kinds[kind], t), []).append(x)
        facts["games"][game] = (home, away, scores[home][0], scores[away][0])
        return game

    for season in (2022, 2023):
        days = [f"{season}-11-{d:02d}" for d in range(1, 29)] + [f"{season + 1}-02-{d:02d}" for d in range(1, 29)]
        pairs = [(a, b) for a in T for b in T if a != b]
        for k, day in enumerate(days[::2]):
            a, b = pairs[k % len(pairs)]
            play(season, "002", a, b, day, over=k == 3, neutral=k == 5)
        for k in range(4):
            play(season, "004", 1 if season == 2022 else 3, 2, f"{season + 1}-05-{k + 1:02d}")
    facts["cup"] = play(2023, "006", 1, 4, "2023-12-09")
    # an older fetch with other values, a game that was not played, a player listed for both teams
    facts["stale"] = teams[0]["GAME_ID"]
    teams.append(teams[0] | {"PTS": 1, "_f": "2024-05-01"})
    for t, other, sign in ((1, 2, "vs."), (2, 1, "@")):
        teams.append({"SEASON_ID": "22023", "TEAM_ID": t, "TEAM_ABBREVIATION": T[t][2], "TEAM_NAME": "x", "GAME_ID": "0022399999", "GAME_DATE": "2024-04-01", "MATCHUP": f"{T[t][2]} {sign} {T[other][2]}", "WL": None, "MIN": 0, **dict.fromkeys(BOX, 0), "_f": "2024-06-01"})
    first = people[0]
    facts["twice"] = (first["GAME_ID"], first["PLAYER_ID"], first["TEAM_ID"])
    other = next(x for x in facts["games"][first["GAME_ID"]][:2] if x != first["TEAM_ID"])
    people.append(first | {"TEAM_ID": other, "PTS": first["PTS"] + 50})
    out = {"leaguegamelog_t__leaguegamelog": (GAME, teams), "leaguegamelog_p__leaguegamelog": (PLAYER_GAME, people)}

    rows = {"Regular Season": [], "Playoffs": []}
    for (p, season, kind), games in _by(facts["player"]).items():
        parts = {t: facts["player"][p, season, kind, t] for t in games}
        for t, xs in [*parts.items(), *([(0, [x for v in parts.values() for x in v])] if len(parts) > 1 else [])]:
            rows[kind].append({"PLAYER_ID": p, "SEASON_ID": f"{season}-{(season + 1) % 100}", "TEAM_ID": t, "TEAM_ABBREVIATION": "TOT" if t == 0 else T[t][2], "PLAYER_AGE": "27.0", "GP": len(xs), "GS": len(xs), "_f": "2024-06-01", "_k": str(p)} | {k: sum(x[k] for x in xs) for k in ("MIN", *BOX[:-1])})
    rows["Regular Season"].append(rows["Regular Season"][0] | {"PTS": 9999, "_f": "2024-01-01"})  # an older response
    out["playercareerstats__seasontotalsregularseason"] = (SEASON, rows["Regular Season"])
    out["playercareerstats__seasontotalspostseason"] = (SEASON, rows["Playoffs"])
    for name, kind in (("careertotalsregularseason", "Regular Season"), ("careertotalspostseason", "Playoffs")):
        mine = [x for x in rows[kind] if x["_f"] == "2024-06-01"]
        totals = []
        for p in {x["PLAYER_ID"] for x in mine}:
            own = [x for x in mine if x["PLAYER_ID"] == p and (x["TEAM_ID"] == 0 or not any(y["PLAYER_ID"] == p and y["SEASON_ID"] == x["SEASON_ID"] and y["TEAM_ID"] == 0 for y in mine))]
            totals.append({"PLAYER_ID": p, "TEAM_ID": 0, "_f": "2024-06-01", "_k": str(p)} | {k: sum(x[k] for x in own) for k in ("GP", "GS", "MIN", *BOX[:-1])})
        out[f"playercareerstats__{name}"] = (CAREER, totals)
    f = {"_f": "2024-06-01"}
    out["commonallplayers__commonallplayers"] = (
        ["PERSON_ID", "DISPLAY_LAST_COMMA_FIRST", "DISPLAY_FIRST_LAST", "ROSTERSTATUS", "FROM_YEAR", "TO_YEAR", "GAMES_PLAYED_FLAG"],
        [f | {"PERSON_ID": p, "DISPLAY_LAST_COMMA_FIRST": f"{x.split(' ', 1)[1]}, {x.split(' ')[0]}", "DISPLAY_FIRST_LAST": x, "ROSTERSTATUS": 1, "FROM_YEAR": 2022 - (p == 25) * 5, "TO_YEAR": 2023, "GAMES_PLAYED_FLAG": "Y"} for p, x in PEOPLE.items()]
        + [f | {"PERSON_ID": 99, "DISPLAY_LAST_COMMA_FIRST": "Never, Was", "DISPLAY_FIRST_LAST": "Was Never", "ROSTERSTATUS": 0, "FROM_YEAR": 2022, "TO_YEAR": 2022, "GAMES_PLAYED_FLAG": "N"}],
    )
    out["commonplayerinfo__commonplayerinfo"] = (["PERSON_ID", "FIRST_NAME", "LAST_NAME", "BIRTHDATE", "POSITION", "DRAFT_YEAR"], [f | {"PERSON_ID": 11, "FIRST_NAME": "Ana", "LAST_NAME": "Novák", "BIRTHDATE": "1999-01-02T00:00:00", "POSITION": "Guard", "DRAFT_YEAR": "2021"}])
    adv = {"USG_PCT": 0.2, "TS_PCT": 0.5, "EFG_PCT": 0.5, "OFF_RATING": 110.5, "DEF_RATING": 108, "NET_RATING": 2.5, "PACE": 99, "PIE": 0.1, "POSS": 5000}
    p = {"_p": '{"Season": "2023-24", "SeasonType": "Regular Season"}'}
    out["leaguedashplayerstats_adv__leaguedashplayerstats"] = (["PLAYER_ID", "GP", *adv], [f | p | adv | {"PLAYER_ID": x, "GP": 10} for x in PEOPLE])
    out["leaguedashteamstats_adv__leaguedashteamstats"] = (["TEAM_ID", "GP", *adv], [f | p | adv | {"TEAM_ID": x, "GP": 14} for x in T])
    years = []
    for t, (city, name, _) in T.items():
        for y in (2022, 2023):
            title = {(1, 2022): "LEAGUE CHAMPION", (2, 2022): "FINALS APPEARANCE", (3, 2023): "LEAGUE CHAMPION", (2, 2023): "FINALS APPEARANCE"}.get((t, y), "N/A")
            years.append(f | {"_k": str(t), "TEAM_ID": t, "TEAM_CITY": city, "TEAM_NAME": "Old Owls" if t == 4 and y == 2022 else name, "YEAR": f"{y}-{(y + 1) % 100}", "GP": 14, "WINS": 7, "LOSSES": 7, "CONF_RANK": t, "DIV_RANK": 1, "PO_WINS": 0, "PO_LOSSES": 0, "NBA_FINALS_APPEARANCE": title, "PTS": 1})
    out["teamyearbyyearstats__teamstats"] = (["TEAM_ID", "TEAM_CITY", "TEAM_NAME", "YEAR", "GP", "WINS", "LOSSES", "CONF_RANK", "DIV_RANK", "PO_WINS", "PO_LOSSES", "NBA_FINALS_APPEARANCE", "PTS"], years)
    table = {"Conference": "East", "Division": "Coast", "PlayoffRank": 1, "LeagueRank": 1, "WINS": 7, "LOSSES": 7, "LongWinStreak": 3, "LongLossStreak": 2, "HOME": "4-3", "ROAD": "3-4"}
    out["leaguestandingsv3__standings"] = (["TeamID", "SeasonID", *table], [f | table | {"TeamID": t, "SeasonID": "22023", "PlayoffRank": None if t == 4 else t, "Conference": "East" if t < 3 else "West", "LeagueRank": t} for t in T])
    out["franchisehistory__franchisehistory"] = (["TEAM_ID", "TEAM_CITY", "TEAM_NAME", "START_YEAR", "END_YEAR", "YEARS", "LEAGUE_TITLES"], [f | {"TEAM_ID": t, "TEAM_CITY": c, "TEAM_NAME": m, "START_YEAR": 2022, "END_YEAR": 2023, "YEARS": 2, "LEAGUE_TITLES": 0} for t, (c, m, _) in T.items()] + [f | {"TEAM_ID": 4, "TEAM_CITY": "Summit", "TEAM_NAME": "Old Owls", "START_YEAR": 2022, "END_YEAR": 2022, "YEARS": 1, "LEAGUE_TITLES": 0}])
    out["franchisehistory__defunctteams"] = (out["franchisehistory__franchisehistory"][0], [f | {"TEAM_ID": 50, "TEAM_CITY": "Gone", "TEAM_NAME": "Ghosts", "START_YEAR": 1950, "END_YEAR": 1953, "YEARS": 4, "LEAGUE_TITLES": 0}])
    awards = [(11, "NBA Most Valuable Player", "2022-23"), (11, "NBA Most Valuable Player", "2023-24"), (21, "NBA All-Star", "2023-24"), (31, "Finals Prize", "2023-24")]
    out["playerawards__playerawards"] = (["PERSON_ID", "DESCRIPTION", "SEASON", "TEAM", "ALL_NBA_TEAM_NUMBER", "CONFERENCE", "MONTH", "WEEK", "TYPE", "SUBTYPE1", "SUBTYPE2"], [f | {"PERSON_ID": a, "DESCRIPTION": b, "SEASON": c, "TEAM": " ", "TYPE": "Award", "_k": str(a)} for a, b, c in awards])
    zones = [("Restricted Area", "2PT Field Goal", "Layup"), ("Left Corner 3", "3PT Field Goal", "Step Back Jump shot"), ("Mid-Range", "2PT Field Goal", "Jump Shot")]
    game = next(iter(facts["games"]))
    out["shotchartdetail__shot_chart_detail"] = (
        ["GAME_ID", "GAME_EVENT_ID", "PLAYER_ID", "TEAM_ID", "PERIOD", "MINUTES_REMAINING", "SECONDS_REMAINING", "ACTION_TYPE", "SHOT_TYPE", "SHOT_ZONE_BASIC", "SHOT_ZONE_AREA", "SHOT_ZONE_RANGE", "SHOT_DISTANCE", "LOC_X", "LOC_Y", "SHOT_MADE_FLAG", "GAME_DATE"],
        [f | {"_p": '{"Season": "2022-23"}', "GAME_ID": game, "GAME_EVENT_ID": k, "PLAYER_ID": 11 if k % 2 else 21, "TEAM_ID": 1, "PERIOD": 1, "MINUTES_REMAINING": 3, "SECONDS_REMAINING": 2, "ACTION_TYPE": zones[k % 3][2], "SHOT_TYPE": zones[k % 3][1], "SHOT_ZONE_BASIC": zones[k % 3][0], "SHOT_ZONE_AREA": "a", "SHOT_ZONE_RANGE": "b", "SHOT_DISTANCE": "13.5", "LOC_X": 1, "LOC_Y": 2, "SHOT_MADE_FLAG": 1 if k % 4 == 0 else 0, "GAME_DATE": "20221101"} for k in range(60) if not (k % 2 == 0 and k % 3 == 1)],
    )
    return out, facts


def _by(found: dict) -> dict[tuple, list]:
    out: dict[tuple, list] = {}
    for p, season, kind, t in found:
        out.setdefault((p, season, kind), []).append(t)
    return out


def frames(spark):
    """The landing tables and seeds as frames, and the facts."""
    tables, facts = league()
    landing = {}
    for name, (columns, rows) in tables.items():
        text = [tuple([x.get("_k", "k"), "2024", "f.json", x["_f"], x.get("_p", "{}")] + [None if x.get(c) is None else str(x[c]) for c in columns]) for x in rows]
        landing[name] = spark.createDataFrame(text, META + "".join(f", {c} string" for c in columns)).coalesce(1)
    seeds = {
        "tiebreaker_games": spark.createDataFrame([("0029999999",)], "game_id string"), "award_timing": spark.createDataFrame([("NBA Most Valuable Player", "regular_season_end"), ("NBA All-Star", "regular_season_end")], "award string, known_at string"),
        "records_curated": spark.createDataFrame([("career_triple_doubles", "career", "triple_doubles", "Ana Novák", "40", "http://x", "2020-01-01")], "record string, record_kind string, stat string, player string, value string, source_url string, valid_from string"),
        "player_alias_seed": spark.createDataFrame([("The Net", "Ana Novák", "nickname")], "alias string, player_name string, kind string"), "team_alias_seed": spark.createDataFrame([("the birds", "HAR")], "alias string, team_abbreviation string"),
        "seed_availability": spark.createDataFrame([("stl", "2023-24", "2023", None), ("pts", None, None, None)], "stat string, first_season string, first_season_start string, note string"),
    }
    return landing, seeds, facts
