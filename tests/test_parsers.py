from datetime import date, datetime

import pytest

from snaplake.plans.parsers import PARSERS
from snaplake.sources.snapshots import read_snapshots
from snaplake.tables import TABLES
from tests.payloads import PAYLOADS, SUMMARIES, athlete, group


@pytest.fixture
def parse(spark, land):
    def run(name, payload=None):
        table = TABLES[name]
        root = land(table, PAYLOADS[name] if payload is None else payload)
        return PARSERS[name](read_snapshots(spark, table, root))

    return run


def keyed(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", list(TABLES))
def test_schema_keys_and_audit(parse, name):
    df, table = parse(name), TABLES[name]
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in table.schema]
    rows = df.collect()
    keys = [tuple(r[k] for k in table.keys) for r in rows]
    assert rows and len(set(keys)) == len(keys) and all(None not in k for k in keys)
    for role, name_ in table.audit:
        assert all(r[name_] is not None for r in rows), role
    assert rows[0][table.file_column].endswith(".json")


def test_teams(parse):
    rows = keyed(parse("teams"), "team_id")
    herons = rows["501"]
    assert (herons["abbreviation"], herons["color"], herons["alternate_color"], herons["is_active"]) == ("HER", "#0b5f7c", "#fefefe", True)
    assert rows["502"]["color"] is None and rows["503"]["is_active"] is False


def test_players(parse):
    rows = keyed(parse("players"), "player_id")
    brook = rows["8001"]
    assert (brook["height_in"], brook["weight_lbs"], brook["experience_years"], brook["hand"]) == (68, 171, 9, "left")
    assert brook["date_of_birth"] == date(1995, 2, 3)
    assert [brook[f"birth_{part}"] for part in ("city", "state", "country")] == ["Lowmere", "LM", None]
    assert rows["8002"]["birth_city"] is None and rows["8002"]["date_of_birth"] is None


def test_rosters(parse):
    rows = keyed(parse("rosters"), "player_id")
    assert set(rows) == {"8003", "8004", "8005"}
    dunn = rows["8003"]
    assert (dunn["season"], dunn["season_type"], dunn["team_id"]) == (2031, 3, "502")
    assert (dunn["position"], dunn["position_name"], dunn["college"]) == ("LB", "Linebacker", "Hillside")
    assert (dunn["height_in"], dunn["weight_lbs"], dunn["age"], dunn["experience_years"]) == (74, 233, 27, 5)
    assert rows["8005"]["roster_group"] == "injured" and rows["8005"]["position"] is None


def test_standings(parse):
    rows = keyed(parse("standings"), "team_id")
    herons = rows["501"]
    numbers = {
        "wins": 7, "losses": 5, "ties": 1, "win_percent": 0.577, "points_for": 241, "points_against": 259,
        "point_differential": -18, "games_behind": 1.5, "playoff_seed": 4, "division_wins": 2, "division_losses": 3,
    }
    assert {name: herons[name] for name in numbers} == numbers and herons["streak"] == "L2"
    records = {"overall": "7-5-1", "home": "4-2", "road": "3-3-1", "division": "2-3", "conference": "5-4"}
    assert {name: herons[f"{name}_record"] for name in records} == records
    assert rows["503"]["conference"] == "INL" and rows["503"]["wins"] is None and rows["503"]["streak"] is None


def test_schedules(parse):
    rows = keyed(parse("schedules"), "game_id")
    played, coming = rows["9001"], rows["9002"]
    assert played["game_ts_utc"] == datetime(2031, 11, 2, 18, 5)
    assert [played[f"{side}_team_abbreviation"] for side in ("home", "away")] == ["HER", "ELK"]
    assert [played[f"{side}_score"] for side in ("home", "away")] == [23, 26]
    assert coming["game_ts_utc"] == datetime(2031, 12, 7, 21, 0, 45)
    assert coming["home_score"] is None and coming["away_score"] is None and coming["completed"] is False


def test_games(parse):
    game = parse("games").first()
    assert [game[c] for c in ("home_team_id", "home_score", "away_team_id", "away_score")] == ["501", 23, "502", 26]
    assert [game[c] for c in ("venue", "venue_city", "attendance")] == ["Pier Field", "Lowmere", 41250]


def test_game_team_stats(parse):
    rows = keyed(parse("game_team_stats"), "team_id")
    elks, herons = rows["502"], rows["501"]
    assert (elks["home_away"], herons["home_away"]) == ("away", "home")
    want = {
        "third_down_conversions": 6, "third_down_attempts": 15, "pass_completions": 22, "pass_attempts": 36, "total_yards": 355,
        "sacks": 3, "sack_yards_lost": 19, "penalties": 5, "penalty_yards": 38, "yards_per_play": 5.6349206349,
        "interceptions_thrown": 2, "turnovers": 3, "possession_seconds": 1930,
    }
    assert {name: elks[name] for name in want} == want
    assert (herons["third_down_conversions"], herons["third_down_attempts"], herons["possession_seconds"]) == (7, 14, 1670)
    assert herons["first_downs_penalty"] is None
    assert (herons["red_zone_scores"], herons["red_zone_attempts"]) == (2, None)


def test_player_game_stats(parse):
    rows = keyed(parse("player_game_stats"), "player_id")
    want = {
        "8014": {
            "player_name": "Oz Pryce", "jersey": "14", "team_abbreviation": "ELK", "pass_completions": 22, "pass_attempts": 36,
            "passing_yards": 263, "passing_tds": 2, "sacks_taken": 3, "sack_yards_lost": 19, "qbr": 58.1, "passer_rating": 84.7,
            "fumbles": 2, "fumbles_lost": 1, "fumbles_recovered": 0, "interceptions_thrown": 2, "def_interceptions": None,
            "rushing_yards": None,
        },
        "8015": {"def_interceptions": 2, "interceptions_thrown": None},
        "8010": {
            "rushing_attempts": 2, "rushing_yards": 11, "rushing_long": 9, "receptions": 5, "targets": 8, "receiving_long": 27,
        },
        "8011": {"rushing_yards": 88},
        "8013": {"def_sacks": 1.5},
        "8012": {
            "field_goals_made": 3, "field_goal_attempts": 4, "field_goal_long": 47, "extra_points_made": 2,
            "extra_point_attempts": 2, "kicking_points": 11,
        },
    }
    assert {who: {name: rows[who][name] for name in stats} for who, stats in want.items()} == want


def test_player_placeholders_and_short_arrays(parse):
    passing = group("passing", ("completions/passingAttempts", "adjQBR", "QBRating"), athlete("8020", "S", "1", "8/11", "--"))
    nobody = {"name": "rushing", "keys": ["rushingYards"], "athletes": None}
    record = {**SUMMARIES[0], "boxscore": {"players": [{"team": {"id": "501"}, "statistics": [passing, nobody]}]}}
    row = parse("player_game_stats", [record]).first()
    assert (row["pass_completions"], row["pass_attempts"], row["qbr"], row["passer_rating"]) == (8, 11, None, None)


def test_injury_news(parse):
    rows = keyed(parse("injury_news"), "id")
    dated = rows[7001]
    assert dated["created_at"] == datetime(2031, 11, 5, 7, 40, 11) and dated["player_id"] == 8010
    assert (dated["title"], dated["description"], dated["categories"]) == ("Ankle report", "Full practice.", ["Health", "Brief"])
    assert rows[7002]["created_at"] is None
