"""From service responses to landing records, and choosing which games to land.

The builders keep the feed's own names and nesting and only leave subtrees out; everything else
is up to the parsers, so landed files can be parsed again after a change. ``carry`` names columns to pass through as
they are, such as the time of the request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from snaplake.functions.nested import drop_members, head, keep_members, nested_size, or_empty
from snaplake.functions.scalars import either, instant
from snaplake.operators.latest import first_rows

# What a landing record leaves out or keeps.
TEAM_DROPS = ("logos", "links")
ATHLETE_DROPS = ("links",)
ROSTER_PLAYER_DROPS = ("links", "headshot", "injuries", "teams", "contracts", "alternateIds")
EVENT_DROPS = ("links",)
COMPETITION_DROPS = ("broadcasts", "notes", "tickets", "ticketsAvailable")
COMPETITOR_DROPS = ("leaders", "record", "curatedRank")
VENUE_DROPS = ("images",)
TEAM_REF_KEEPS = ("id", "abbreviation", "displayName")
ATHLETE_REF_KEEPS = ("id", "displayName", "jersey")
HEADER_KEEPS = ("id", "season", "week")
COMPETITION_KEEPS = ("id", "date", "neutralSite", "status")
SIDE_KEEPS = ("id", "homeAway", "winner", "score")
TRAILING_DAYS = 3
MAX_TARGETS = 50


def _present(df: DataFrame, path: str, names: Sequence[str]) -> list[str]:
    """Those names the struct, or the array's structs, at a path really have."""
    kind = df.schema
    for step in path.split("."):
        if not isinstance(kind, StructType) or step not in kind.names:
            return []
        kind = kind[step].dataType
        while isinstance(kind, ArrayType):
            kind = kind.elementType
    return [n for n in names if isinstance(kind, StructType) and n in kind.names]


def _replace(struct: Column, **members: Column) -> Column:
    for name, value in members.items():
        struct = struct.withField(name, value)
    return struct


def land_teams(responses: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``sports[0].leagues[0].teams[].team`` of each response, one record per team."""
    teams = head(head("sports")["leagues"])["teams"]
    entries = responses.select(*carry, F.explode(teams).alias("entry"))
    trimmed = entries.select(*carry, drop_members(F.col("entry.team"), TEAM_DROPS).alias("team"))
    return trimmed.select("team.*", *carry)


def land_players(pages: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``items[]`` of each page, one record per athlete."""
    athletes = pages.select(*carry, F.explode("items").alias("athlete"))
    trimmed = athletes.select(*carry, drop_members(F.col("athlete"), ATHLETE_DROPS).alias("a"))
    return trimmed.select("a.*", *carry)


def land_rosters(responses: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One record per team with its position groups nested."""

    def group(g: Column) -> Column:
        items = F.transform(or_empty(g["items"]), lambda p: drop_members(p, ROSTER_PLAYER_DROPS))
        return F.struct(g["position"].alias("position"), items.alias("items"))

    team = _present(responses, "team", TEAM_REF_KEEPS)
    return responses.select(
        "season",
        keep_members(F.col("team"), team).alias("team"),
        F.transform(or_empty("athletes"), group).alias("athletes"),
        *carry,
    )


def land_standings(responses: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One record per response with its conferences and their entries nested."""

    def entry(e: Column) -> Column:
        return F.struct(drop_members(e["team"], TEAM_DROPS).alias("team"), e["stats"].alias("stats"))

    def child(c: Column) -> Column:
        standings = F.struct(
            c["standings"]["season"].alias("season"),
            c["standings"]["seasonType"].alias("seasonType"),
            F.transform(or_empty(c["standings"]["entries"]), entry).alias("entries"),
        )
        names = (c[n].alias(n) for n in ("id", "name", "abbreviation"))
        return F.struct(*names, standings.alias("standings"))

    children = F.transform(or_empty("children"), child)
    return responses.select("season", children.alias("children"), *carry)


def require_entries(standings: DataFrame) -> DataFrame:
    """The same records; the job fails at one without any entry, which means the feed changed shape."""
    entries = nested_size("children", "standings.entries")
    complaint = F.raise_error(F.lit("standings response without entries"))
    kind = standings.schema["children"].dataType
    checked = F.when(entries > 0, F.col("children")).otherwise(complaint.cast(kind))
    return standings.withColumn("children", checked)


def land_schedule(events: DataFrame) -> DataFrame:
    """Schedule events without links, broadcasts, leaders and logos."""

    def competitor(c: Column) -> Column:
        return _replace(
            drop_members(c, COMPETITOR_DROPS), team=drop_members(c["team"], TEAM_DROPS)
        )

    def competition(c: Column) -> Column:
        return _replace(
            drop_members(c, COMPETITION_DROPS),
            competitors=F.transform(or_empty(c["competitors"]), competitor),
        )

    return events.drop(*EVENT_DROPS).withColumn(
        "competitions", F.transform(or_empty("competitions"), competition)
    )


def land_summaries(responses: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Header, venue, team and player box score of each game summary; needs a ``game_id`` column."""
    head_names = _present(responses, "header", HEADER_KEEPS)
    comp_names = _present(responses, "header.competitions", COMPETITION_KEEPS)
    side_names = _present(responses, "header.competitions.competitors", SIDE_KEEPS)
    side_team = _present(responses, "header.competitions.competitors.team", TEAM_REF_KEEPS)
    box_team = _present(responses, "boxscore.teams.team", TEAM_REF_KEEPS)
    player_team = _present(responses, "boxscore.players.team", TEAM_REF_KEEPS)
    athlete_names = _present(responses, "boxscore.players.statistics.athletes.athlete", ATHLETE_REF_KEEPS)

    def competitor(c: Column) -> Column:
        team = keep_members(c["team"], side_team)
        return F.struct(*(c[n].alias(n) for n in side_names), team.alias("team"))

    def competition(c: Column) -> Column:
        sides = F.transform(or_empty(c["competitors"]), competitor)
        return F.struct(*(c[n].alias(n) for n in comp_names), sides.alias("competitors"))

    def team(t: Column) -> Column:
        return F.struct(
            t["homeAway"].alias("homeAway"),
            keep_members(t["team"], box_team).alias("team"),
            or_empty(t["statistics"]).alias("statistics"),
        )

    def athlete(a: Column) -> Column:
        who = keep_members(a["athlete"], athlete_names)
        return F.struct(who.alias("athlete"), a["stats"].alias("stats"))

    def stat_group(g: Column) -> Column:
        athletes = F.transform(or_empty(g["athletes"]), athlete)
        return F.struct(g["name"].alias("name"), g["keys"].alias("keys"), athletes.alias("athletes"))

    def players(p: Column) -> Column:
        return F.struct(
            keep_members(p["team"], player_team).alias("team"),
            F.transform(or_empty(p["statistics"]), stat_group).alias("statistics"),
        )

    return responses.select(
        F.col("game_id").cast("string").alias("game_id"),
        F.struct(
            *(F.col(f"header.{n}").alias(n) for n in head_names),
            F.transform(or_empty("header.competitions"), competition).alias("competitions"),
        ).alias("header"),
        F.struct(
            drop_members(F.col("gameInfo.venue"), VENUE_DROPS).alias("venue"),
            F.col("gameInfo.attendance").alias("attendance"),
        ).alias("gameInfo"),
        F.struct(
            F.transform(or_empty("boxscore.teams"), team).alias("teams"),
            F.transform(or_empty("boxscore.players"), players).alias("players"),
        ).alias("boxscore"),
        *carry,
    )


def unique_events(events: DataFrame, *position: str) -> DataFrame:
    """Each game once although both teams' schedules list it; the first in arrival order stays."""
    return first_rows(events, ["id"], *position)


def kickoff_and_completed(events: DataFrame) -> DataFrame:
    """Adds ``kickoff`` (NULL if undated) and ``done`` (completed is exactly true) to events."""
    competition = head("competitions")
    done = F.coalesce(competition["status"]["type"]["completed"], F.lit(False))
    return events.select("*", instant(either(competition["date"], "date")).alias("kickoff"), done.alias("done"))


def target_games(
    games: DataFrame, now: Column, position: str, days: int = TRAILING_DAYS, most: int = MAX_TARGETS
) -> DataFrame:
    """Games to fetch in this run, in arrival order: started, and unfinished or recently finished.

    Takes ``kickoff`` and ``done``. ``most`` is how many one run fetches; the others stay due.
    """
    recent = F.col("kickoff") >= now - F.make_dt_interval(days=F.lit(days))
    due = games.filter((F.col("kickoff") <= now) & (~F.col("done") | recent))
    return due.orderBy(position).limit(most)


def completed_games(games: DataFrame, now: Column) -> DataFrame:
    """Every finished game, for a backfill."""
    return games.filter(F.col("done") & (F.col("kickoff") <= now))


def sample_per_state(games: DataFrame, state: str, *position: str) -> DataFrame:
    """The first game of each state."""
    return first_rows(games, [state], *position)
