"""The analytic queries over the tables parsed from derived landing records."""

from __future__ import annotations

from pyspark.sql import functions as F

from snaplake.plans import analytics as A
from snaplake.plans.search import news_with_team, title_mentions
from snaplake.workload import landing
from snaplake.workload.parsing import (
    GAMES_SQL,
    NEWS_SQL,
    player_box_latest,
    team_box_latest,
)
from snaplake.workload.registry import plain, query
from snaplake.workload.silver import silver

SEASON, STANDINGS_SEASON, WEEK = 1998, 2017, 6
_SEASON_SQL = f"season = {SEASON} AND season_type = 2"


_STANDINGS_SQL = """
    SELECT CAST(2015 + c_custkey % 10 AS BIGINT) AS season, CAST(2 + c_custkey % 2 AS BIGINT) AS season_type,
        CASE WHEN c_nationkey % 2 = 0 THEN 'AFC' ELSE 'NFC' END AS conference,
        concat(c_custkey, '-', i) AS team_id, concat('T', c_custkey, '-', i) AS team_abbreviation,
        CAST(c_custkey % 18 + i AS BIGINT) AS wins,
        CAST(c_custkey % 500 - c_nationkey * 10 AS BIGINT) AS point_differential,
        CASE WHEN c_mktsegment <> 'FURNITURE' THEN CAST(c_custkey % 16 + 1 AS BIGINT) END AS playoff_seed,
        concat(c_custkey % 12, '-', i) AS conference_record
    FROM customer CROSS JOIN generate_series(1, 3) AS s(i)
    WHERE i <= 1 + c_custkey % 3
"""
_THIS_STANDING = f"FROM ({_STANDINGS_SQL}) WHERE season = {STANDINGS_SEASON} AND season_type = 2"


@query("gold_team_abbreviation", "SELECT concat('T', s_suppkey) AS abbreviation FROM supplier WHERE s_suppkey = 25")
def gold_team_abbreviation(spark, sf_dir):
    return A.lookup(silver(spark, sf_dir, "teams"), "abbreviation", team_id="25")


@query("gold_team_name", "SELECT s_name AS display_name FROM supplier WHERE concat('T', s_suppkey) = 'T7'")
def gold_team_name(spark, sf_dir):
    return A.lookup(silver(spark, sf_dir, "teams"), "display_name", abbreviation="T7")


@query("gold_most_wins", f"SELECT team_abbreviation, wins {_THIS_STANDING} ORDER BY wins DESC, team_id LIMIT 1")
def gold_most_wins(spark, sf_dir):
    return A.standings_leader(silver(spark, sf_dir, "standings"), STANDINGS_SEASON, "wins")


@query("gold_best_seed", f"""
    SELECT team_abbreviation, playoff_seed {_THIS_STANDING} AND conference = 'AFC'
    ORDER BY playoff_seed ASC NULLS LAST, team_id LIMIT 1
""")
def gold_best_seed(spark, sf_dir):
    standings = silver(spark, sf_dir, "standings")
    return A.standings_leader(standings, STANDINGS_SEASON, "playoff_seed", conference="AFC", lowest=True)


def _register_standing(name: str, column: str) -> None:
    @query(name, f"SELECT {column} {_THIS_STANDING} AND team_abbreviation = 'T12-1'")
    def standing(spark, sf_dir):
        return A.team_standing(silver(spark, sf_dir, "standings"), STANDINGS_SEASON, "T12-1", column)


_register_standing("gold_team_wins", "wins")
_register_standing("gold_team_differential", "point_differential")
_register_standing("gold_conference_record", "conference_record")

_FINISHED = f"FROM ({GAMES_SQL}) WHERE {_SEASON_SQL} AND completed"


@query("gold_first_by_time", f"""
    SELECT home_score {_FINISHED} AND week = {WEEK} ORDER BY game_ts_utc, game_id LIMIT 1
""")
def gold_first_by_time(spark, sf_dir):
    return A.first_home_score(silver(spark, sf_dir, "games"), SEASON, WEEK)


@query("gold_count", f"SELECT CAST(count(*) AS BIGINT) AS games {_FINISHED} AND week = {WEEK}")
def gold_count(spark, sf_dir):
    return A.finished_count(silver(spark, sf_dir, "games"), SEASON, WEEK)


@query("gold_highest_combined", f"""
    SELECT home_score + away_score AS combined_score {_FINISHED}
    ORDER BY combined_score DESC NULLS LAST, game_id LIMIT 1
""")
def gold_highest_combined(spark, sf_dir):
    return A.highest_combined_score(silver(spark, sf_dir, "games"), SEASON)


@query("gold_abs_diff", f"""
    SELECT CAST(count(*) AS BIGINT) AS games {_FINISHED} AND abs(home_score - away_score) >= 10
""")
def gold_abs_diff(spark, sf_dir):
    return A.decided_by(silver(spark, sf_dir, "games"), SEASON, 10)


def _register_leader(name: str, stat: str, kind: str = "BIGINT", season: int = SEASON, n: int = 1) -> None:
    rows = player_box_latest(f"game_id, player_id, player_name, season, season_type, {stat}")

    @query(name, f"""
        SELECT player_id, player_name, CAST(sum({stat}) AS {kind}) AS total FROM ({rows})
        WHERE season = {season} AND season_type = 2 GROUP BY player_id, player_name
        ORDER BY total DESC NULLS LAST, player_id LIMIT {n}
    """)
    def leader(spark, sf_dir):
        return A.player_leaders(silver(spark, sf_dir, "player_game_stats"), season, stat, n=n)


_register_leader("gold_passing_yards", "passing_yards")
_register_leader("gold_passing_tds", "passing_tds")
_register_leader("gold_receiving_yards", "receiving_yards")
_register_leader("gold_rushing_yards", "rushing_yards")
_register_leader("gold_receptions", "receptions")
_register_leader("gold_interceptions_thrown", "interceptions_thrown")
_register_leader("gold_sack_leader", "def_sacks", kind="DOUBLE")
_register_leader("gold_top_receivers", "receiving_yards", n=10)
# A season without games: a leader question whose answer is empty.
_register_leader("gold_empty", "passing_tds", season=1950)


def _box(spark, sf_dir):
    return silver(spark, sf_dir, "game_team_stats")


def _team_sql(stat: str) -> str:
    return f"""
        SELECT b.* FROM ({team_box_latest(f"game_id, team_id, team_abbreviation, {stat}")}) b
        JOIN ({GAMES_SQL}) g ON b.game_id = g.game_id WHERE g.season = {SEASON} AND g.season_type = 2"""


def _register_team_leader(name: str, stat: str) -> None:
    @query(name, f"""
        SELECT team_id, team_abbreviation, CAST(sum({stat}) AS BIGINT) AS total FROM ({_team_sql(stat)})
        GROUP BY team_id, team_abbreviation ORDER BY total DESC NULLS LAST, team_id LIMIT 1
    """)
    def leader(spark, sf_dir):
        return A.team_leaders(_box(spark, sf_dir), silver(spark, sf_dir, "games"), SEASON, stat)


_register_team_leader("gold_team_sacked", "sacks")
_register_team_leader("gold_team_turnovers", "turnovers")


def _register_team_total(name: str, stat: str) -> None:
    @query(name, f"SELECT CAST(sum({stat}) AS BIGINT) AS total FROM ({_team_sql(stat)}) WHERE team_id = '7'")
    def total(spark, sf_dir):
        return A.team_total(_box(spark, sf_dir), silver(spark, sf_dir, "games"), SEASON, "7", stat)


_register_team_total("gold_sum_join", "total_yards")
_register_team_total("gold_sack_yards", "sack_yards_lost")


@query("gold_yards_allowed", f"""
    WITH b AS ({team_box_latest("game_id, team_id, total_yards")}), g AS ({GAMES_SQL})
    SELECT CAST(sum(o.total_yards) AS BIGINT) AS total
    FROM b AS o JOIN b AS m ON o.game_id = m.game_id AND m.team_id = '7' AND o.team_id <> '7'
    JOIN g ON g.game_id = o.game_id WHERE g.season = {SEASON} AND g.season_type = 2
""")
def gold_yards_allowed(spark, sf_dir):
    return A.team_allowed(_box(spark, sf_dir), silver(spark, sf_dir, "games"), SEASON, "7", "total_yards")


@query("gold_recent_count", f"""
    SELECT CAST(count(*) AS BIGINT) AS articles FROM ({NEWS_SQL})
    WHERE created_at >= TIMESTAMP '2024-01-05' - INTERVAL 3 DAY
        AND (title ILIKE '%contr%' OR description ILIKE '%contr%')
""")
def gold_recent_count(spark, sf_dir):
    news = silver(spark, sf_dir, "injury_news")
    return A.news_mentions(news, "contr", days=3, now=F.lit("2024-01-05").cast("timestamp"))


@query("gold_box_score", f"""
    SELECT team_id, third_down_conversions, third_down_attempts, possession_seconds
    FROM ({team_box_latest("game_id, team_id, third_down_conversions, third_down_attempts, possession_seconds")})
    WHERE game_id = '100'
""")
def gold_box_score(spark, sf_dir):
    columns = ("third_down_conversions", "third_down_attempts", "possession_seconds")
    return A.game_box_score(_box(spark, sf_dir), "100").select("team_id", *columns)


@query("gold_schedule_counts", f"""
    SELECT season_type, week, CAST(count(*) AS BIGINT) AS row_count FROM ({GAMES_SQL}) GROUP BY ALL
""")
def gold_schedule_counts(spark, sf_dir):
    return A.counts_by(silver(spark, sf_dir, "schedules"), "season_type", "week")


@query("gold_standings_counts", f"""
    SELECT conference, CAST(count(*) AS BIGINT) AS row_count FROM ({_STANDINGS_SQL}) GROUP BY ALL
""")
def gold_standings_counts(spark, sf_dir):
    return A.counts_by(silver(spark, sf_dir, "standings"), "conference")


@query("position_enrichment", f"""
    WITH stats AS ({player_box_latest("game_id, player_id, season, receptions")}),
    listed AS (
        SELECT season - 20 AS season, 's' || team_id AS player_id, position FROM (
            SELECT 2015 + s_nationkey % 10 AS season, CAST(s_suppkey AS VARCHAR) AS team_id,
                CASE WHEN s_suppkey % 3 = 0 THEN 'DE' ELSE 'OF' END AS position
            FROM supplier))
    SELECT position, CAST(count(*) AS BIGINT) AS games, CAST(sum(receptions) AS BIGINT) AS receptions
    FROM stats JOIN listed USING (season, player_id) GROUP BY position
""")
def position_enrichment(spark, sf_dir):
    """Position from the newest of several roster listings; listings double no stats row.

    A supplier's players stand for one player's listings: the latest listed one counts, which is
    an offense player where that group is larger than the defense.
    """
    rosters = silver(spark, sf_dir, "rosters")
    listed_at = F.make_dt_interval(secs=F.col("age") * 2 + (F.col("roster_group") == "defense").cast("int"))
    listings = rosters.select(
        (F.col("season") - 20).alias("season"),
        F.concat(F.lit("s"), "team_id").alias("player_id"),
        "position",
        "team_id",
        (F.col("_snapshot_at") + listed_at).alias("_snapshot_at"),
    )
    stats = silver(spark, sf_dir, "player_game_stats").select("season", "player_id", "receptions")
    placed = A.with_position(stats, listings)
    return placed.groupBy("position").agg(
        F.count(F.lit(1)).alias("games"), F.sum("receptions").alias("receptions")
    )


@query("news_by_team", f"""
    SELECT n.id AS id, n.team_id AS team_id, n.title AS title, s.name AS team_name
    FROM ({NEWS_SQL}) n JOIN (SELECT concat('SRC', s_suppkey) AS abbreviation, s_name AS name FROM supplier) s
        ON n.team_id = s.abbreviation
""")
def news_by_team(spark, sf_dir):
    """News and teams share the abbreviation only."""
    teams = silver(spark, sf_dir, "teams").withColumn("abbreviation", F.concat(F.lit("SRC"), "team_id"))
    news = silver(spark, sf_dir, "injury_news").select("id", "team_id", "title")
    return news_with_team(news, teams).select("id", "team_id", "title", "team_name")


@query("news_title_mentions", f"SELECT id, title FROM ({NEWS_SQL}) WHERE title ILIKE '%From SRC1%'")
def news_title_mentions(spark, sf_dir):
    return title_mentions(silver(spark, sf_dir, "injury_news").select("id", "title"), "From SRC1")


@query("dimension_lookup", """
    SELECT n_name, CAST(count(*) AS BIGINT) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name
""")
def dimension_lookup(spark, sf_dir):
    """Dimension look-up by an equi-join; the planner broadcasts the side it finds small."""
    customers = landing.table(spark, sf_dir, "customer")
    nations = landing.table(spark, sf_dir, "nation")
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return plain(A.counts_by(joined, "n_name").withColumnRenamed("row_count", "customers"))
