"""The nine tables. Names, paths, types and order are the data contract (fixed values)."""

from __future__ import annotations

from pyspark.sql import functions as F

from snaplake.functions.nested import (
    aligned_value,
    athlete_starts,
    entries_by_athlete,
    entry_where,
    group_entries,
    head,
    members,
)
from snaplake.functions.scalars import (
    clock_seconds,
    either,
    hex_color,
    instant,
    leading_date,
    lowered,
    pair_part,
    real,
    trimmed,
    whole,
    zoneless_instant,
)
from snaplake.spec import (
    COUNT, DAY, FLAG, INSTANT, RATE, TEXT, TEXTS, Field, Table, col, each, key, let,
)

# --------------------------------------------------------------------------------------
# Read schemas of the landing files (fixed values). Only what a recipe reads is declared;
# fields whose JSON type varies are read as text.
# --------------------------------------------------------------------------------------

TEAM_REF = "STRUCT<id:STRING, abbreviation:STRING, displayName:STRING>"
STATUS = "STRUCT<type:STRUCT<name:STRING, state:STRING, completed:BOOLEAN, detail:STRING>>"
VENUE = "STRUCT<fullName:STRING, address:STRUCT<city:STRING, state:STRING>>"
STATS = "ARRAY<STRUCT<name:STRING, value:STRING, displayValue:STRING>>"

TEAMS_RAW = """
    id STRING, uid STRING, slug STRING, abbreviation STRING, location STRING, name STRING,
    nickname STRING, displayName STRING, shortDisplayName STRING, color STRING,
    alternateColor STRING, isActive BOOLEAN
"""

PLAYERS_RAW = """
    id STRING, uid STRING, guid STRING, firstName STRING, lastName STRING, fullName STRING,
    displayName STRING, shortName STRING, jersey STRING, height DOUBLE, weight DOUBLE, age INT,
    dateOfBirth STRING, birthPlace STRUCT<city:STRING, state:STRING, country:STRING>,
    experience STRUCT<years:INT>, hand STRUCT<type:STRING>, active BOOLEAN
"""

ROSTERS_RAW = f"""
    season STRUCT<year:INT, type:INT>, team {TEAM_REF},
    athletes ARRAY<STRUCT<position:STRING, items:ARRAY<STRUCT<
        id:STRING, fullName:STRING, jersey:STRING, age:INT, height:DOUBLE, weight:DOUBLE,
        experience:STRUCT<years:INT>, college:STRUCT<name:STRING>,
        position:STRUCT<abbreviation:STRING, name:STRING>, status:STRUCT<name:STRING>>>>>
"""

STANDINGS_RAW = f"""
    children ARRAY<STRUCT<name:STRING, abbreviation:STRING, standings:STRUCT<
        season:INT, seasonType:INT, entries:ARRAY<STRUCT<team:{TEAM_REF}, stats:{STATS}>>>>>
"""

SCHEDULES_RAW = f"""
    id STRING, date STRING, season STRUCT<year:INT>, seasonType STRUCT<type:INT>,
    week STRUCT<number:INT>,
    competitions ARRAY<STRUCT<date:STRING, neutralSite:BOOLEAN, venue:{VENUE}, status:{STATUS},
        competitors:ARRAY<STRUCT<homeAway:STRING, team:{TEAM_REF},
            score:STRUCT<value:DOUBLE, displayValue:STRING>>>>>
"""

SUMMARIES_RAW = f"""
    game_id STRING,
    header STRUCT<season:STRUCT<year:INT, type:INT>, week:INT,
        competitions:ARRAY<STRUCT<date:STRING, neutralSite:BOOLEAN, status:{STATUS},
            competitors:ARRAY<STRUCT<homeAway:STRING, score:STRING, team:{TEAM_REF}>>>>>,
    gameInfo STRUCT<venue:{VENUE}, attendance:BIGINT>,
    boxscore STRUCT<teams:ARRAY<STRUCT<homeAway:STRING, team:{TEAM_REF}, statistics:{STATS}>>>
"""

PLAYER_BOX_RAW = f"""
    game_id STRING, header STRUCT<season:STRUCT<year:INT, type:INT>, week:INT>,
    boxscore STRUCT<players:ARRAY<STRUCT<team:{TEAM_REF}, statistics:ARRAY<STRUCT<
        name:STRING, keys:ARRAY<STRING>, athletes:ARRAY<STRUCT<
            athlete:STRUCT<id:STRING, displayName:STRING, jersey:STRING>,
            stats:ARRAY<STRING>>>>>>>>
"""

INJURY_RAW = """
    sport STRING, title STRING, description STRING, count BIGINT,
    items ARRAY<STRUCT<id:BIGINT, created:STRING, created_formated:STRING, author:STRING,
        player_id:BIGINT, team_id:STRING, title:STRING, sport_id:STRING,
        categories:ARRAY<STRING>, link:STRING, desc:STRING, impact:STRING>>,
    limit BIGINT, public_api BOOLEAN, tier STRING
"""

# --------------------------------------------------------------------------------------
# Helpers for the recipes
# --------------------------------------------------------------------------------------


def _score_once_started(side: str):
    """A schedule repeats 0 before kickoff; a score counts once the game has left state 'pre'."""
    return F.when(F.col("comp.status.type.state") != "pre", whole(f"{side}.score.value"))


# A stat is picked from its list by name first and converted afterwards, as ``shown <name>`` for
# display texts and ``exact <name>`` for values, so each list is searched once per stat and only
# for the stats a query asks for. A player's stats are named ``<group>/<key>``.


def _picked(kind: str, name: str):
    return F.col(f"`{kind} {name}`")


def _count(name: str, kind: str = "shown"):
    return whole(_picked(kind, name))


def _rate(name: str, kind: str = "exact"):
    return real(_picked(kind, name))


def _text(name: str, kind: str = "shown"):
    return _picked(kind, name)


def _pair_part(name: str, kind: str, separator: str, part: int):
    return pair_part(_picked(kind, name), separator, part)


def _clock(name: str, kind: str = "shown"):
    return clock_seconds(_picked(kind, name))


_PICKING = (_count, _rate, _text, _pair_part, _clock)


def _wanted(fields: tuple[Field, ...]) -> dict[tuple[str, str], None]:
    """(kind, name) of every stat the fields convert."""
    wanted = {}
    for f in fields:
        reader, *args = f.recipe
        if reader in _PICKING:
            wanted[(args[1] if len(args) > 1 else reader.__defaults__[0], args[0])] = None
    return wanted


def _picks(fields: tuple[Field, ...]):
    """The step that picks team stats out of the arrays of ``_stat_lists``."""
    return let(**{
        f"{kind} {name}": (aligned_value, "names", kind, name) for kind, name in _wanted(fields)
    })


def _player_picks(fields: tuple[Field, ...]):
    """The steps that find a player's entry in each stat group and pick the stats from it."""
    split = {name: name.split("/", 1) for _, name in _wanted(fields)}
    entries = {
        f"in_{group}": (aligned_value, "groups", "player.own", group) for group, _ in split.values()
    }
    picks = {
        f"shown {name}": (aligned_value, f"in_{group}.keys", f"in_{group}.stats", stat)
        for name, (group, stat) in split.items()
    }
    return let(**entries), let(**picks)


def _counts(kind: str = "shown", **names: str) -> tuple[Field, ...]:
    """Several BIGINT stats: column=name in the feed."""
    return tuple(col(column, COUNT, _count, name, kind) for column, name in names.items())


def _group_counts(group: str, **names: str) -> tuple[Field, ...]:
    return _counts(**{column: f"{group}/{name}" for column, name in names.items()})


def _pair(name: str, separator: str, first: str, second: str) -> tuple[Field, ...]:
    return (
        col(first, COUNT, _pair_part, name, "shown", separator, 1),
        col(second, COUNT, _pair_part, name, "shown", separator, 2),
    )


def _stat_lists(entries: str, **others: tuple):
    """A list of {name, value, displayValue} as three parallel arrays.

    ``others`` are the small values of the same record that are still needed, so that the record
    itself is not copied along.
    """
    return let(
        names=(members, entries, "name"),
        shown=(members, entries, "displayValue"),
        exact=(members, entries, "value"),
        **others,
    )


def _first_athlete():
    return head("player.own")["athlete"]


def _game_core(season: str, season_type: str, week: str, *kickoff) -> tuple[Field, ...]:
    return (
        col("season", COUNT, season),
        col("season_type", COUNT, season_type, note="1 preseason, 2 regular season, 3 playoffs"),
        col("week", COUNT, week, note="starts over with each season type"),
        col("game_ts_utc", INSTANT, *kickoff, note="kickoff, UTC"),
        col("status", TEXT, "comp.status.type.name"),
        col("status_detail", TEXT, "comp.status.type.detail"),
        col("completed", FLAG, "comp.status.type.completed"),
    )


def _kickoff():
    return instant(either("comp.date", "date"))


# --------------------------------------------------------------------------------------
# Tables
# --------------------------------------------------------------------------------------

TEAMS = Table(
    name="teams",
    prefix="espn/teams",
    raw=TEAMS_RAW,
    note="One row per franchise",
    fields=(
        key("team_id", TEXT, "id", note="opaque id of the franchise"),
        col("uid", TEXT),
        col("slug", TEXT),
        col("abbreviation", TEXT, note="short code such as KC"),
        col("location", TEXT),
        col("name", TEXT),
        col("display_name", TEXT, "displayName", note="location and name"),
        col("short_display_name", TEXT, "shortDisplayName"),
        col("color", TEXT, hex_color, "color", note="#rrggbb in lower case"),
        col("alternate_color", TEXT, hex_color, "alternateColor", note="#rrggbb in lower case"),
        col("is_active", FLAG, "isActive"),
    ),
)

PLAYERS = Table(
    name="players",
    prefix="espn/players",
    raw=PLAYERS_RAW,
    note="One row per athlete of the season index, retired ones included",
    fields=(
        key("player_id", TEXT, "id", note="opaque id of the athlete"),
        col("uid", TEXT),
        col("guid", TEXT),
        col("first_name", TEXT, "firstName"),
        col("last_name", TEXT, "lastName"),
        col("full_name", TEXT, "fullName"),
        col("display_name", TEXT, "displayName"),
        col("short_name", TEXT, "shortName"),
        col("jersey", TEXT, note="number as printed, may be missing"),
        col("height_in", COUNT, whole, "height", note="inches"),
        col("weight_lbs", COUNT, whole, "weight", note="pounds"),
        col("age", COUNT),
        col("date_of_birth", DAY, leading_date, "dateOfBirth"),
        col("birth_city", TEXT, "birthPlace.city"),
        col("birth_state", TEXT, "birthPlace.state"),
        col("birth_country", TEXT, "birthPlace.country"),
        col("experience_years", COUNT, "experience.years"),
        col("hand", TEXT, lowered, "hand.type", note="left or right"),
        col("active", FLAG),
    ),
)

ROSTERS = Table(
    name="rosters",
    partitions=("season",),
    prefix="espn/rosters",
    raw=ROSTERS_RAW,
    note="One row per season, team and player ever listed; the current roster is the team's newest snapshot",
    steps=(each("grp", "athletes"), let(group_name=("grp.position",)), each("p", "grp.items")),
    fields=(
        key("season", COUNT, "season.year"),
        col("season_type", COUNT, "season.type"),
        key("team_id", TEXT, "team.id"),
        col("team_abbreviation", TEXT, "team.abbreviation"),
        key("player_id", TEXT, "p.id"),
        col("full_name", TEXT, "p.fullName"),
        col("roster_group", TEXT, "group_name", note="offense, defense, specialTeam and so on"),
        col("position", TEXT, "p.position.abbreviation"),
        col("position_name", TEXT, "p.position.name"),
        col("jersey", TEXT, "p.jersey"),
        col("age", COUNT, "p.age"),
        col("height_in", COUNT, whole, "p.height"),
        col("weight_lbs", COUNT, whole, "p.weight"),
        col("experience_years", COUNT, "p.experience.years"),
        col("college", TEXT, "p.college.name"),
        col("status", TEXT, "p.status.name"),
    ),
)

_STANDING_FIELDS = (
    key("season", COUNT, "conf_season"),
    key("season_type", COUNT, "conf_season_type"),
    col("conference", TEXT, "conf_name"),
    key("team_id", TEXT, "team.id"),
    col("team_abbreviation", TEXT, "team.abbreviation"),
    col("team_name", TEXT, "team.displayName"),
    *_counts("exact", wins="wins", losses="losses", ties="ties"),
    col("win_percent", RATE, _rate, "winPercent"),
    *_counts(
        "exact",
        points_for="pointsFor",
        points_against="pointsAgainst",
        point_differential="pointDifferential",
    ),
    col("games_behind", RATE, _rate, "gamesBehind"),
    col("playoff_seed", COUNT, _count, "playoffSeed", "exact"),
    col("streak", TEXT, _text, "streak"),
    *_counts(
        "exact",
        division_wins="divisionWins",
        division_losses="divisionLosses",
        division_ties="divisionTies",
    ),
    col("overall_record", TEXT, _text, "overall", note="wins-losses[-ties]"),
    col("home_record", TEXT, _text, "Home"),
    col("road_record", TEXT, _text, "Road"),
    col("division_record", TEXT, _text, "vs. Div."),
    col("conference_record", TEXT, _text, "vs. Conf."),
)

STANDINGS = Table(
    name="standings",
    partitions=("season",),
    prefix="espn/standings",
    raw=STANDINGS_RAW,
    note="One row per team and season type",
    steps=(
        each("conf", "children"),
        let(
            conf_name=("conf.abbreviation",),
            conf_season=("conf.standings.season",),
            conf_season_type=("conf.standings.seasonType",),
        ),
        each("e", "conf.standings.entries"),
        _stat_lists("e.stats", team=("e.team",)),
        _picks(_STANDING_FIELDS),
    ),
    fields=_STANDING_FIELDS,
)

SCHEDULES = Table(
    name="schedules",
    partitions=("season",),
    prefix="espn/schedules",
    raw=SCHEDULES_RAW,
    note="One row per scheduled game",
    steps=(
        let(comp=(head, "competitions")),
        let(
            home=(entry_where, "comp.competitors", "homeAway", "home"),
            away=(entry_where, "comp.competitors", "homeAway", "away"),
        ),
    ),
    fields=(
        key("game_id", TEXT, "id"),
        *_game_core("season.year", "seasonType.type", "week.number", _kickoff),
        col("home_team_id", TEXT, "home.team.id"),
        col("home_team_abbreviation", TEXT, "home.team.abbreviation"),
        col("home_team_name", TEXT, "home.team.displayName"),
        col("home_score", COUNT, _score_once_started, "home", note="NULL before kickoff"),
        col("away_team_id", TEXT, "away.team.id"),
        col("away_team_abbreviation", TEXT, "away.team.abbreviation"),
        col("away_team_name", TEXT, "away.team.displayName"),
        col("away_score", COUNT, _score_once_started, "away", note="NULL before kickoff"),
        col("venue", TEXT, "comp.venue.fullName"),
        col("venue_city", TEXT, "comp.venue.address.city"),
        col("venue_state", TEXT, "comp.venue.address.state"),
        col("neutral_site", FLAG, "comp.neutralSite"),
    ),
)

GAMES = Table(
    name="games",
    partitions=("season",),
    prefix="espn/game_summaries",
    raw=SUMMARIES_RAW,
    note="One row per game that has kicked off",
    steps=(
        let(comp=(head, "header.competitions")),
        let(
            home=(entry_where, "comp.competitors", "homeAway", "home"),
            away=(entry_where, "comp.competitors", "homeAway", "away"),
        ),
    ),
    fields=(
        key("game_id", TEXT),
        *_game_core("header.season.year", "header.season.type", "header.week", instant, "comp.date"),
        col("home_team_id", TEXT, "home.team.id"),
        col("home_score", COUNT, whole, "home.score"),
        col("away_team_id", TEXT, "away.team.id"),
        col("away_score", COUNT, whole, "away.score"),
        col("venue", TEXT, "gameInfo.venue.fullName"),
        col("venue_city", TEXT, "gameInfo.venue.address.city"),
        col("venue_state", TEXT, "gameInfo.venue.address.state"),
        col("neutral_site", FLAG, "comp.neutralSite"),
        col("attendance", COUNT, "gameInfo.attendance"),
    ),
)

_TEAM_BOX_FIELDS = (
    key("game_id", TEXT),
    key("team_id", TEXT, "team.id"),
    col("team_abbreviation", TEXT, "team.abbreviation"),
    col("home_away", TEXT, "side"),
    *_counts(
        first_downs="firstDowns",
        first_downs_passing="firstDownsPassing",
        first_downs_rushing="firstDownsRushing",
        first_downs_penalty="firstDownsPenalty",
    ),
    *_pair("thirdDownEff", "-", "third_down_conversions", "third_down_attempts"),
    *_pair("fourthDownEff", "-", "fourth_down_conversions", "fourth_down_attempts"),
    *_counts(total_offensive_plays="totalOffensivePlays", total_yards="totalYards"),
    col("yards_per_play", RATE, _rate, "yardsPerPlay"),
    *_counts(total_drives="totalDrives", net_passing_yards="netPassingYards"),
    *_pair("completionAttempts", "/", "pass_completions", "pass_attempts"),
    col("yards_per_pass", RATE, _rate, "yardsPerPass"),
    col("interceptions_thrown", COUNT, _count, "interceptions", note="listed twice, the first counts"),
    *_pair("sacksYardsLost", "-", "sacks", "sack_yards_lost"),
    *_counts(rushing_yards="rushingYards", rushing_attempts="rushingAttempts"),
    col("yards_per_rush_attempt", RATE, _rate, "yardsPerRushAttempt"),
    *_pair("redZoneAttempts", "-", "red_zone_scores", "red_zone_attempts"),
    *_pair("totalPenaltiesYards", "-", "penalties", "penalty_yards"),
    *_counts(
        turnovers="turnovers",
        fumbles_lost="fumblesLost",
        defensive_touchdowns="defensiveTouchdowns",
    ),
    col("possession_seconds", COUNT, _clock, "possessionTime"),
)

GAME_TEAM_STATS = Table(
    name="game_team_stats",
    prefix="espn/game_summaries",
    raw=SUMMARIES_RAW,
    note="Box score of one team in one game",
    steps=(
        each("t", "boxscore.teams"),
        _stat_lists("t.statistics", team=("t.team",), side=("t.homeAway",)),
        _picks(_TEAM_BOX_FIELDS),
    ),
    fields=_TEAM_BOX_FIELDS,
)

_PLAYER_BOX_FIELDS = (
    key("game_id", TEXT),
    key("player_id", TEXT, "player.id"),
    col("player_name", TEXT, "athlete.displayName"),
    col("jersey", TEXT, "athlete.jersey"),
    col("team_id", TEXT, "team.id"),
    col("team_abbreviation", TEXT, "team.abbreviation"),
    col("season", COUNT, "header.season.year"),
    col("season_type", COUNT, "header.season.type", note="1 preseason, 2 regular season, 3 playoffs"),
    col("week", COUNT, "header.week"),
    *_pair("passing/completions/passingAttempts", "/", "pass_completions", "pass_attempts"),
    *_group_counts(
        "passing",
        passing_yards="passingYards",
        passing_tds="passingTouchdowns",
        interceptions_thrown="interceptions",
    ),
    *_pair("passing/sacks-sackYardsLost", "-", "sacks_taken", "sack_yards_lost"),
    col("passer_rating", RATE, _rate, "passing/QBRating", "shown"),
    col("qbr", RATE, _rate, "passing/adjQBR", "shown"),
    *_group_counts(
        "rushing",
        rushing_attempts="rushingAttempts",
        rushing_yards="rushingYards",
        rushing_tds="rushingTouchdowns",
        rushing_long="longRushing",
    ),
    *_group_counts(
        "receiving",
        receptions="receptions",
        targets="receivingTargets",
        receiving_yards="receivingYards",
        receiving_tds="receivingTouchdowns",
        receiving_long="longReception",
    ),
    *_group_counts(
        "fumbles",
        fumbles="fumbles", fumbles_lost="fumblesLost", fumbles_recovered="fumblesRecovered",
    ),
    *_group_counts("defensive", tackles_total="totalTackles", tackles_solo="soloTackles"),
    col("def_sacks", RATE, _rate, "defensive/sacks", "shown", note="half sacks count .5"),
    col("tackles_for_loss", RATE, _rate, "defensive/tacklesForLoss", "shown"),
    *_group_counts(
        "defensive",
        passes_defended="passesDefended", qb_hits="QBHits", def_tds="defensiveTouchdowns",
    ),
    *_group_counts(
        "interceptions",
        def_interceptions="interceptions",
        def_interception_yards="interceptionYards",
        def_interception_tds="interceptionTouchdowns",
    ),
    *_group_counts(
        "kickReturns",
        kick_returns="kickReturns",
        kick_return_yards="kickReturnYards",
        kick_return_tds="kickReturnTouchdowns",
    ),
    *_group_counts(
        "puntReturns",
        punt_returns="puntReturns",
        punt_return_yards="puntReturnYards",
        punt_return_tds="puntReturnTouchdowns",
    ),
    *_pair("kicking/fieldGoalsMade/fieldGoalAttempts", "/", "field_goals_made", "field_goal_attempts"),
    col("field_goal_long", COUNT, _count, "kicking/longFieldGoalMade"),
    *_pair("kicking/extraPointsMade/extraPointAttempts", "/", "extra_points_made", "extra_point_attempts"),
    col("kicking_points", COUNT, _count, "kicking/totalKickingPoints"),
    *_group_counts(
        "punting",
        punts="punts", punt_yards="puntYards", punts_inside_20="puntsInside20",
    ),
)

PLAYER_GAME_STATS = Table(
    name="player_game_stats",
    partitions=("season",),
    prefix="espn/game_summaries",
    raw=PLAYER_BOX_RAW,
    note="Box score of one player in one game; what was not recorded is NULL, not 0",
    steps=(
        each("t", "boxscore.players"),
        let(entries=(group_entries, "t.statistics"), team=("t.team",)),
        let(starts=(athlete_starts, "entries")),
        each("player", entries_by_athlete, "entries", "starts"),
        let(athlete=(_first_athlete,), groups=(members, "player.own", "group")),
        *_player_picks(_PLAYER_BOX_FIELDS),
    ),
    fields=_PLAYER_BOX_FIELDS,
)

INJURY_NEWS = Table(
    name="injury_news",
    prefix="injury",
    raw=INJURY_RAW,
    note="One row per article",
    steps=(each("a", "items"),),
    audit=(("snapshot", "snapshot_at"), ("file", "source_file"), ("ingested", "ingested_at")),
    fields=(
        key("id", COUNT, "a.id", note="id of the article"),
        col("player_id", COUNT, "a.player_id", note="id of the news feed, not the player_id of other tables"),
        col("team_id", TEXT, "a.team_id", note="a team abbreviation, not the team_id of other tables"),
        col("title", TEXT, trimmed, "a.title"),
        col("description", TEXT, trimmed, "a.desc"),
        col("impact", TEXT, trimmed, "a.impact"),
        col("author", TEXT, "a.author"),
        col("categories", TEXTS, "a.categories"),
        col("link", TEXT, "a.link"),
        col("sport_id", TEXT, "a.sport_id"),
        col("created_at", INSTANT, zoneless_instant, "a.created", note="publication, UTC"),
    ),
)

TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        TEAMS, PLAYERS, ROSTERS, STANDINGS, SCHEDULES,
        GAMES, GAME_TEAM_STATS, PLAYER_GAME_STATS, INJURY_NEWS,
    )
}

# What a reset may drop; the news table cannot be rebuilt from the score feed.
RESETTABLE = tuple(name for name in TABLES if name != INJURY_NEWS.name)
