"""The nine parsers over derived landing records: build the landing record, parse, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snaplake.operators.landing import (
    land_players,
    land_rosters,
    land_schedule,
    land_standings,
    land_summaries,
    land_teams,
    require_entries,
)
from snaplake.operators.latest import dedupe_latest
from snaplake.plans.parsers import PARSERS
from snaplake.tables import TABLES
from snaplake.workload import landing
from snaplake.workload.registry import FILE_COLUMNS, plain, query


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Landing records of a table, through the builder that would have landed them."""
    if name == "teams":
        return land_teams(landing.team_responses(spark, sf_dir), FILE_COLUMNS)
    if name == "players":
        return land_players(landing.player_pages(spark, sf_dir), FILE_COLUMNS)
    if name == "rosters":
        return land_rosters(landing.roster_responses(spark, sf_dir), FILE_COLUMNS)
    if name == "standings":
        responses = landing.standings_responses(spark, sf_dir)
        return require_entries(land_standings(responses, FILE_COLUMNS))
    if name == "schedules":
        return land_schedule(landing.schedule_events(spark, sf_dir))
    if name == "games":
        return land_summaries(landing.game_responses(spark, sf_dir), FILE_COLUMNS)
    if name == "game_team_stats":
        return landing.team_box_records(spark, sf_dir)
    if name == "player_game_stats":
        return landing.player_box_records(spark, sf_dir)
    return landing.news_payloads(spark, sf_dir)


def parsed(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Rows of a table, or just some columns; several versions of a key are all there."""
    rows = PARSERS[name](landed(spark, sf_dir, name))
    return rows.select(*columns) if columns else rows


def current(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The newest version of each key, with the named columns only.

    Columns are cut before the versions are compared, so the shuffle carries what is asked for.
    """
    table = TABLES[name]
    needed = [*table.keys, *columns, table.file_column, table.snapshot_column]
    rows = parsed(spark, sf_dir, name, *dict.fromkeys(needed))
    return dedupe_latest(rows, table)


def _fields(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return plain(parsed(spark, sf_dir, name, *(f.name for f in TABLES[name].fields)))


@query("parse_teams", """
    SELECT CAST(s_suppkey AS VARCHAR) AS team_id, concat('s:20~t:', s_suppkey) AS uid,
        replace(lower(s_name), '#', '-') AS slug, concat('T', s_suppkey) AS abbreviation,
        concat('City ', s_nationkey) AS location, concat('Name ', s_suppkey) AS name,
        s_name AS display_name, concat('S', s_suppkey) AS short_display_name,
        CASE WHEN s_nationkey <> 0 THEN '#' || printf('%06x', s_suppkey) END AS color,
        CASE WHEN s_nationkey <> 1 THEN '#ffffff' END AS alternate_color,
        s_acctbal >= 0 AS is_active
    FROM supplier
""")
def parse_teams(spark, sf_dir):
    return _fields(spark, sf_dir, "teams")


@query("parse_players", """
    SELECT CAST(c_custkey AS VARCHAR) AS player_id, concat('a:', c_custkey) AS uid, md5(c_name) AS guid,
        split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
        c_name AS full_name, c_name AS display_name, substr(c_name, 1, 1) AS short_name,
        CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 100 AS VARCHAR) END AS jersey,
        CAST(60 + c_custkey % 20 AS BIGINT) AS height_in, CAST(trunc(c_acctbal) AS BIGINT) AS weight_lbs,
        CAST(20 + c_custkey % 20 AS BIGINT) AS age,
        CASE WHEN c_nationkey % 4 = 0 THEN concat(1960 + c_custkey % 40, '-0', 1 + c_custkey % 9, '-1',
            c_custkey % 9) END AS date_of_birth,
        CASE WHEN c_mktsegment <> 'MACHINERY' THEN concat('City ', c_nationkey) END AS birth_city,
        CASE WHEN c_mktsegment <> 'MACHINERY' THEN concat('S', c_nationkey) END AS birth_state,
        CASE WHEN c_mktsegment <> 'MACHINERY' AND c_nationkey < 12 THEN 'USA' END AS birth_country,
        CAST(c_custkey % 20 AS BIGINT) AS experience_years,
        CASE WHEN c_custkey % 3 = 0 THEN 'left' ELSE 'right' END AS hand, c_acctbal > 0 AS active
    FROM customer
""")
def parse_players(spark, sf_dir):
    return _fields(spark, sf_dir, "players")


@query("parse_rosters", """
    SELECT CAST(2015 + s_nationkey % 10 AS BIGINT) AS season, CAST(2 AS BIGINT) AS season_type,
        CAST(s_suppkey AS VARCHAR) AS team_id, concat('T', s_suppkey) AS team_abbreviation,
        concat(s_suppkey, g.mark, i) AS player_id, concat(s_name, ' ', i) AS full_name,
        g.name AS roster_group, upper(substr(g.name, 1, 2)) AS position, g.name AS position_name,
        CAST(i AS VARCHAR) AS jersey, CAST(20 + i AS BIGINT) AS age, CAST(70 + i AS BIGINT) AS height_in,
        CASE WHEN i <> 2 THEN CAST(200 + i // 4 AS BIGINT) END AS weight_lbs,
        CASE WHEN i <> 1 THEN CAST(i AS BIGINT) END AS experience_years,
        concat('College ', s_nationkey) AS college,
        CASE WHEN s_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status
    FROM supplier
    CROSS JOIN (VALUES ('offense', '-o'), ('defense', '-d')) AS g(name, mark)
    CROSS JOIN generate_series(1, 4) AS s(i)
    WHERE i <= CASE g.name WHEN 'offense' THEN 2 + s_suppkey % 3 ELSE 2 END
""")
def parse_rosters(spark, sf_dir):
    return _fields(spark, sf_dir, "rosters")


@query("parse_standings", """
    SELECT CAST(2015 + c_custkey % 10 AS BIGINT) AS season, CAST(2 + c_custkey % 2 AS BIGINT) AS season_type,
        CASE WHEN c_nationkey % 2 = 0 THEN 'AFC' ELSE 'NFC' END AS conference,
        concat(c_custkey, '-', i) AS team_id, concat('T', c_custkey, '-', i) AS team_abbreviation,
        c_name AS team_name, CAST(c_custkey % 18 + i AS BIGINT) AS wins,
        CAST(17 - c_custkey % 18 AS BIGINT) AS losses,
        CASE WHEN c_nationkey <> 3 THEN CAST(0 AS BIGINT) END AS ties,
        CAST(c_custkey % 18 AS DOUBLE) / 16 AS win_percent,
        CAST(c_custkey % 500 AS BIGINT) AS points_for, CAST(c_nationkey * 10 AS BIGINT) AS points_against,
        CAST(c_custkey % 500 - c_nationkey * 10 AS BIGINT) AS point_differential,
        CAST(c_custkey % 4 AS DOUBLE) / 2 AS games_behind,
        CASE WHEN c_mktsegment <> 'FURNITURE' THEN CAST(c_custkey % 16 + 1 AS BIGINT) END AS playoff_seed,
        concat(CASE WHEN c_acctbal < 0 THEN 'L' ELSE 'W' END, c_custkey % 6) AS streak,
        CAST(i AS BIGINT) AS division_wins, CAST(c_nationkey % 6 AS BIGINT) AS division_losses,
        CAST(NULL AS BIGINT) AS division_ties,
        concat(c_custkey % 18 + i, '-', 17 - c_custkey % 18) AS overall_record,
        concat(c_custkey % 9, '-', c_nationkey % 9) AS home_record,
        concat(c_nationkey % 9, '-', c_custkey % 9) AS road_record,
        concat(i, '-', c_nationkey % 6) AS division_record,
        concat(c_custkey % 12, '-', i) AS conference_record
    FROM customer CROSS JOIN generate_series(1, 3) AS s(i)
    WHERE i <= 1 + c_custkey % 3
""")
def parse_standings(spark, sf_dir):
    return _fields(spark, sf_dir, "standings")


# Pieces the schedule and game twins share.
_HOME, _AWAY = "(o_custkey % 32)", "((o_custkey + 1 + o_orderkey % 31) % 32)"
_HOME_SCORE = "CAST(floor(o_totalprice) AS BIGINT) % 50"
_AWAY_SCORE = "CAST(floor(o_totalprice / 50) AS BIGINT) % 45"
_GAME_CORE = """
    CAST(o_orderkey AS VARCHAR) AS game_id,
    CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) <= 2 THEN 1 ELSE 0 END AS BIGINT) AS season,
    CAST(1 + o_custkey % 3 AS BIGINT) AS season_type, CAST(month(o_orderdate) AS BIGINT) AS week,
    CASE o_orderstatus WHEN 'F' THEN 'STATUS_FINAL' WHEN 'P' THEN 'STATUS_IN_PROGRESS'
        ELSE 'STATUS_SCHEDULED' END AS status,
    concat('detail ', o_orderstatus) AS status_detail, o_orderstatus = 'F' AS completed
"""


def _venue(team: str) -> str:
    has = "o_orderpriority <> '2-HIGH'"
    return f"""
        CASE WHEN {has} THEN concat('Stadium ', {team}) END AS venue,
        CASE WHEN {has} THEN concat('City ', {team}) END AS venue_city,
        CASE WHEN {has} THEN concat('S', {team} % 10) END AS venue_state,
        o_orderpriority = '1-URGENT' AS neutral_site"""


def _scheduled_score(score: str) -> str:
    return f"CASE WHEN o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW' THEN {score} END"


@query("parse_schedules", f"""
    SELECT {_GAME_CORE},
        CASE o_orderpriority WHEN '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') || ' 12:00:00'
            WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y-%m-%d') || ' 20:25:30'
            WHEN '3-MEDIUM' THEN NULL
            ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 18:00:00' END AS game_ts_utc,
        CAST({_HOME} AS VARCHAR) AS home_team_id, concat('T', {_HOME}) AS home_team_abbreviation,
        concat('Team ', {_HOME}) AS home_team_name, {_scheduled_score(_HOME_SCORE)} AS home_score,
        CAST({_AWAY} AS VARCHAR) AS away_team_id, concat('T', {_AWAY}) AS away_team_abbreviation,
        concat('Team ', {_AWAY}) AS away_team_name, {_scheduled_score(_AWAY_SCORE)} AS away_score,
        {_venue(_HOME)}
    FROM orders
""")
def parse_schedules(spark, sf_dir):
    return _fields(spark, sf_dir, "schedules")


GAMES_SQL = f"""
    SELECT {_GAME_CORE},
        strftime(o_orderdate, '%Y-%m-%d ') || lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || ':30:00'
            AS game_ts_utc,
        CAST({_HOME} AS VARCHAR) AS home_team_id,
        CASE WHEN o_orderstatus <> 'O' THEN {_HOME_SCORE} END AS home_score,
        CAST({_AWAY} AS VARCHAR) AS away_team_id,
        CASE WHEN o_orderstatus <> 'O' THEN {_AWAY_SCORE} END AS away_score,
        {_venue(_HOME)}, CAST(o_custkey * 10 AS BIGINT) AS attendance
    FROM orders
"""


@query("parse_games", GAMES_SQL)
def parse_games(spark, sf_dir):
    return _fields(spark, sf_dir, "games")


_N, _Q = "l_linenumber", "CAST(l_quantity AS BIGINT)"
_BOX_HOME, _BOX_AWAY = "(l_suppkey % 32)", "((l_suppkey % 32 + 1 + l_partkey % 31) % 32)"
_LINE_FILE = (
    "concat('line-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',"
    " strftime(l_shipdate, '%Y%m%d'))"
)


def _team_box(side: str, team: str, k: int) -> str:
    counts = {
        "first_downs": f"{_Q} % 30 + {k}",
        "first_downs_passing": _N,
        "first_downs_rushing": f"{_N} + {k}",
        "first_downs_penalty": f"CASE WHEN {_N} <> 7 THEN 1 END",
        "third_down_conversions": _N,
        "third_down_attempts": f"{_N} + 5",
        "fourth_down_conversions": f"CASE WHEN {_N} = 1 THEN 1 ELSE 0 END",
        "fourth_down_attempts": f"CASE WHEN {_N} <> 1 THEN {_N} END",
        "total_offensive_plays": f"{_Q} + 20",
        "total_yards": f"{_Q} * 7 + {k}",
        "total_drives": f"{_N} + 8",
        "net_passing_yards": f"{_Q} * 3",
        "pass_completions": _Q,
        "pass_attempts": f"{_Q} + 10",
        "interceptions_thrown": f"{_N} % 3",
        "sacks": f"{_N} % 4",
        "sack_yards_lost": _Q,
        "rushing_yards": f"{_Q} * 2 - 20",
        "rushing_attempts": f"{_N} + 15",
        "red_zone_scores": f"{_N} % 3",
        "red_zone_attempts": _N,
        "penalties": _N,
        "penalty_yards": f"{_N} * 5",
        "turnovers": f"{_N} % 5",
        "fumbles_lost": f"CASE WHEN l_returnflag <> 'R' THEN {_N} % 2 END",
        "defensive_touchdowns": str(k),
        "possession_seconds": f"CASE WHEN l_linestatus <> 'O' OR {_N} <> 3 THEN {_Q} * 60 + {_N} * 7 END",
    }
    rates = {
        "yards_per_play": "l_discount",
        "yards_per_pass": "l_tax",
        "yards_per_rush_attempt": "CASE WHEN l_returnflag <> 'N' THEN l_quantity END",
    }
    columns = [f"CAST({sql} AS BIGINT) AS {name}" for name, sql in counts.items()]
    columns += [f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in rates.items()]
    return f"""
        SELECT CAST(l_orderkey AS VARCHAR) AS game_id, CAST({team} AS VARCHAR) AS team_id,
            concat('T', {team}) AS team_abbreviation, '{side}' AS home_away, {', '.join(columns)},
            l_shipdate AS _snapshot_at, {_LINE_FILE} AS _source_file
        FROM lineitem"""


TEAM_BOX_SQL = _team_box("away", _BOX_AWAY, 0) + " UNION ALL " + _team_box("home", _BOX_HOME, 1)


@query("parse_game_team_stats", f"SELECT * EXCLUDE (_snapshot_at, _source_file) FROM ({TEAM_BOX_SQL})")
def parse_game_team_stats(spark, sf_dir):
    return _fields(spark, sf_dir, "game_team_stats")


_PLAYER_RATES = ("passer_rating", "qbr", "def_sacks", "tackles_for_loss")


def _player_box(who: str, team: str, values: dict[str, str]) -> str:
    identity = {"game_id", "player_id", "player_name", "jersey", "team_id", "team_abbreviation",
                "season", "season_type", "week"}
    names = [f.name for f in TABLES["player_game_stats"].fields if f.name not in identity]
    stats = [
        f"CAST({values.get(n, 'NULL')} AS {'DOUBLE' if n in _PLAYER_RATES else 'BIGINT'}) AS {n}"
        for n in names
    ]
    return f"""
        SELECT CAST(l_orderkey AS VARCHAR) AS game_id, {who} AS player_id,
            concat('Player ', {who}) AS player_name, CAST({_N} AS VARCHAR) AS jersey,
            CAST({team} AS VARCHAR) AS team_id, concat('T', {team}) AS team_abbreviation,
            CAST(year(l_shipdate) - CASE WHEN month(l_shipdate) <= 2 THEN 1 ELSE 0 END AS BIGINT) AS season,
            CAST(1 + l_orderkey % 3 AS BIGINT) AS season_type, CAST(month(l_shipdate) AS BIGINT) AS week,
            {', '.join(stats)}, l_shipdate AS _snapshot_at, {_LINE_FILE} AS _source_file
        FROM lineitem"""


_PASSER = {
    "pass_completions": _Q, "pass_attempts": f"{_Q} + 9", "passing_yards": f"{_Q} * 8",
    "passing_tds": f"{_N} % 4", "interceptions_thrown": f"{_N} % 3", "sacks_taken": _N,
    "sack_yards_lost": _Q, "qbr": "CASE WHEN l_returnflag <> 'A' THEN l_quantity END",
    "passer_rating": "l_tax", "rushing_attempts": _N, "rushing_yards": f"{_Q} - 10",
    "rushing_tds": f"{_N} % 2", "rushing_long": _Q, "fumbles": f"{_N} % 2",
}
_RECEIVER = {
    "receptions": _N, "receiving_yards": f"{_Q} * 4", "receiving_tds": f"{_N} % 3",
    "receiving_long": _Q, "targets": f"{_N} + 4", "tackles_total": f"{_N} + 3", "tackles_solo": _N,
    "def_sacks": f"{_N} % 3 + 0.5", "tackles_for_loss": "l_discount", "passes_defended": f"{_N} % 2",
    "def_tds": "0", "def_interceptions": f"{_N} % 2", "def_interception_yards": _Q,
    "def_interception_tds": "0",
}
_KICKER = {
    "receptions": "1", "receiving_yards": _Q, "receiving_tds": "0", "receiving_long": _Q, "targets": "2",
    "kick_returns": _N, "kick_return_yards": f"{_Q} + 5", "kick_return_tds": f"{_N} % 2",
    "punt_returns": "2", "punt_return_tds": "0", "field_goals_made": f"{_N} % 3",
    "field_goal_attempts": _N, "field_goal_long": _Q, "extra_points_made": "4",
    "extra_point_attempts": "4", "kicking_points": f"{_N} % 3 * 3 + 4", "punts": f"{_N} % 6",
    "punt_yards": f"{_Q} * 9", "punts_inside_20": f"{_N} % 3",
}

PLAYER_BOX_SQL = " UNION ALL ".join((
    _player_box("concat('p', l_partkey)", _BOX_AWAY, _PASSER),
    _player_box("concat('s', l_suppkey)", _BOX_HOME, _RECEIVER),
    _player_box("concat('k', l_partkey % 97)", _BOX_HOME, _KICKER),
))


@query("parse_player_game_stats", f"SELECT * EXCLUDE (_snapshot_at, _source_file) FROM ({PLAYER_BOX_SQL})")
def parse_player_game_stats(spark, sf_dir):
    return _fields(spark, sf_dir, "player_game_stats")


NEWS_SQL = """
    SELECT doc_id AS id, CAST(doc_id % 50 AS BIGINT) AS player_id, upper(source) AS team_id,
        concat(lang, ' report from ', source) AS title, trim(text) AS description,
        concat(n_chars, ' characters') AS impact, concat('author ', lang) AS author,
        concat(lang, ',', source) AS categories, concat('https://x/', doc_id) AS link,
        'NFL' AS sport_id,
        CASE WHEN source <> 'src13' THEN TIMESTAMP '2024-01-01' + to_seconds(doc_id * 600) END AS created_at
    FROM documents
"""


@query("parse_injury_news", f"""
    SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at) FROM ({NEWS_SQL})
""")
def parse_injury_news(spark, sf_dir):
    return _fields(spark, sf_dir, "injury_news")


def _latest_sql(source: str, keys: str, columns: str) -> str:
    """The newest version of each key, as SQL."""
    return f"""
        SELECT {columns} FROM ({source})
        QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY _snapshot_at DESC, _source_file DESC) = 1"""


def team_box_latest(columns: str) -> str:
    return _latest_sql(TEAM_BOX_SQL, "game_id, team_id", columns)


def player_box_latest(columns: str) -> str:
    return _latest_sql(PLAYER_BOX_SQL, "game_id, player_id", columns)


@query("latest_game_team_stats", team_box_latest("* EXCLUDE (_snapshot_at, _source_file)"))
def latest_game_team_stats(spark, sf_dir):
    names = [f.name for f in TABLES["game_team_stats"].fields]
    return current(spark, sf_dir, "game_team_stats", *names).select(*names)


@query("latest_player_game_stats", player_box_latest("* EXCLUDE (_snapshot_at, _source_file)"))
def latest_player_game_stats(spark, sf_dir):
    names = [f.name for f in TABLES["player_game_stats"].fields]
    return current(spark, sf_dir, "player_game_stats", *names).select(*names)
