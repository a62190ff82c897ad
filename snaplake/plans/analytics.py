"""The analytic queries, with season, team, statistic and so on as parameters.

Ties in a top-1 go to the smaller key, and NULLs sort last in both directions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.functions.scalars import contains_text
from snaplake.operators.latest import latest_rows

REGULAR = 2  # season type of the regular season


def in_season(df: DataFrame, season: int, season_type: int = REGULAR) -> DataFrame:
    return df.filter((F.col("season") == season) & (F.col("season_type") == season_type))


def lookup(df: DataFrame, column: str, **equals) -> DataFrame:
    """One column of the rows with the given values: an abbreviation by id, a record by team."""
    for name, value in equals.items():
        df = df.filter(F.col(name) == value)
    return df.select(column)


def first_by(df: DataFrame, order: Column, key: str, *columns: str, n: int = 1) -> DataFrame:
    return df.orderBy(order, F.col(key).asc_nulls_last()).limit(n).select(*columns)


def standings_leader(
    standings: DataFrame, season: int, stat: str, season_type: int = REGULAR,
    conference: str | None = None, lowest: bool = False,
) -> DataFrame:
    """Team with the highest (or lowest) value of a standings column."""
    rows = in_season(standings, season, season_type)
    if conference:
        rows = rows.filter(F.col("conference") == conference)
    order = F.col(stat).asc_nulls_last() if lowest else F.col(stat).desc_nulls_last()
    return first_by(rows, order, "team_id", "team_abbreviation", stat)


def team_standing(
    standings: DataFrame, season: int, team: str, column: str, season_type: int = REGULAR
) -> DataFrame:
    return lookup(in_season(standings, season, season_type), column, team_abbreviation=team)


def finished(games: DataFrame, season: int, season_type: int = REGULAR, week: int | None = None) -> DataFrame:
    rows = in_season(games, season, season_type).filter("completed")
    return rows if week is None else rows.filter(F.col("week") == week)


def first_home_score(games: DataFrame, season: int, week: int, season_type: int = REGULAR) -> DataFrame:
    rows = finished(games, season, season_type, week)
    return first_by(rows, F.col("game_ts_utc").asc_nulls_last(), "game_id", "home_score")


def finished_count(games: DataFrame, season: int, week: int, season_type: int = REGULAR) -> DataFrame:
    return finished(games, season, season_type, week).agg(F.count(F.lit(1)).alias("games"))


def highest_combined_score(games: DataFrame, season: int, season_type: int = REGULAR) -> DataFrame:
    total = F.col("home_score") + F.col("away_score")
    rows = finished(games, season, season_type).withColumn("combined_score", total)
    return first_by(rows, F.col("combined_score").desc_nulls_last(), "game_id", "combined_score")


def decided_by(games: DataFrame, season: int, margin: int, season_type: int = REGULAR) -> DataFrame:
    rows = finished(games, season, season_type)
    clear = F.abs(F.col("home_score") - F.col("away_score")) >= margin
    return rows.filter(clear).agg(F.count(F.lit(1)).alias("games"))


def player_leaders(
    stats: DataFrame, season: int, stat: str, season_type: int = REGULAR, n: int = 1
) -> DataFrame:
    """Players with the highest season total of a statistic."""
    rows = in_season(stats, season, season_type)
    totals = rows.groupBy("player_id", "player_name").agg(F.sum(stat).alias("total"))
    order = F.col("total").desc_nulls_last()
    return first_by(totals, order, "player_id", "player_id", "player_name", "total", n=n)


def _with_season(box: DataFrame, games: DataFrame, season: int, season_type: int) -> DataFrame:
    wanted = in_season(games, season, season_type).select("game_id")
    return box.join(wanted, "game_id")


def team_leaders(
    box: DataFrame, games: DataFrame, season: int, stat: str, season_type: int = REGULAR, n: int = 1
) -> DataFrame:
    """Teams with the highest season total of a box-score column. ``sacks`` counts times sacked."""
    rows = _with_season(box, games, season, season_type)
    totals = rows.groupBy("team_id", "team_abbreviation").agg(F.sum(stat).alias("total"))
    order = F.col("total").desc_nulls_last()
    return first_by(totals, order, "team_id", "team_id", "team_abbreviation", "total", n=n)


def team_total(
    box: DataFrame, games: DataFrame, season: int, team_id: str, stat: str, season_type: int = REGULAR
) -> DataFrame:
    rows = _with_season(box.filter(F.col("team_id") == team_id), games, season, season_type)
    return rows.agg(F.sum(stat).alias("total"))


def team_allowed(
    box: DataFrame, games: DataFrame, season: int, team_id: str, stat: str, season_type: int = REGULAR
) -> DataFrame:
    """What a team's opponents totalled against it, game by game in one pass over the season's games."""
    played = F.col("team_id") == team_id
    per_game = _with_season(box, games, season, season_type).groupBy("game_id").agg(
        F.some(played).alias("played"), F.sum(F.when(~played, F.col(stat))).alias("against")
    )
    return per_game.filter("played").agg(F.sum("against").alias("total"))


def news_mentions(news: DataFrame, name: str, days: int = 30, now: Column | None = None) -> DataFrame:
    """Number of recent articles naming somebody in the title or the description."""
    since = (F.current_timestamp() if now is None else now) - F.make_dt_interval(days=F.lit(days))
    named = contains_text("title", name) | contains_text("description", name)
    return news.filter((F.col("created_at") >= since) & named).agg(F.count(F.lit(1)).alias("articles"))


def no_data(df: DataFrame, *columns: str) -> DataFrame:
    """The answer to what the tables cannot say: the columns, and no row."""
    return df.filter(F.lit(False)).select(*columns)


def game_box_score(box: DataFrame, game_id: str) -> DataFrame:
    return box.filter(F.col("game_id") == game_id)


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """Spot check: how many rows each combination has."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))


def with_position(stats: DataFrame, rosters: DataFrame) -> DataFrame:
    """Player statistics with the position listed on the roster.

    A traded player is on several rosters of a season; the newest listing counts, so no row of
    ``stats`` is doubled.
    """
    listed = rosters.select("season", "player_id", "position", "_snapshot_at", "team_id")
    newest = latest_rows(listed, ["season", "player_id"], "_snapshot_at", "team_id")
    return stats.join(newest.select("season", "player_id", "position"), ["season", "player_id"])
