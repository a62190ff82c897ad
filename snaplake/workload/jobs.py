"""Landing jobs, load reports and files over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from snaplake.functions.nested import nested_size
from snaplake.operators import landing as L
from snaplake.operators import reports as R
from snaplake.operators.latest import first_rows
from snaplake.session import work_dir
from snaplake.sources.snapshots import RECORDS_PER_FILE, export_csv, read_snapshots, write_landing
from snaplake.plans.parsers import parse
from snaplake.tables import TABLES
from snaplake.workload import landing
from snaplake.workload.parsing import GAMES_SQL, landed
from snaplake.workload.registry import plain, query

NOW, NOW_SQL = "2001-07-20 00:00:00", "TIMESTAMP '2001-07-20 00:00:00'"


@query("trim_payload", """
    SELECT CAST(o_orderkey AS VARCHAR) AS id, 'competitions,date,id,position,season,seasonType,week' AS event_members,
        'competitors,date,neutralSite,status,venue' AS competition_members,
        'homeAway,score,team' AS competitor_members
    FROM orders
""")
def trim_payload(spark, sf_dir):
    """What is left of schedule events once links, broadcasts, leaders and the like are dropped."""
    events = L.land_schedule(landing.schedule_events(spark, sf_dir)).drop("_source_file", "_snapshot_at")

    def members(struct):
        return F.array_join(F.array_sort(F.json_object_keys(F.to_json(struct, {"ignoreNullFields": "false"}))), ",")

    competition = F.get("competitions", F.lit(0))
    return events.select(
        "id",
        members(F.struct("*")).alias("event_members"),
        members(competition).alias("competition_members"),
        members(F.get(competition["competitors"], F.lit(0))).alias("competitor_members"),
    )


@query("landing_rosters", """
    SELECT CAST(s_suppkey AS VARCHAR) AS team_id, 'abbreviation,displayName,id' AS team_members,
        CAST(3 AS BIGINT) AS n_groups, CAST(4 + s_suppkey % 3 AS BIGINT) AS players,
        FALSE AS has_links
    FROM supplier
""")
def landing_rosters(spark, sf_dir):
    """Roster records keep the groups, also an empty one, and drop what no parser reads."""
    rosters = landed(spark, sf_dir, "rosters")
    return rosters.select(
        F.col("team.id").alias("team_id"),
        F.array_join(F.array_sort(F.json_object_keys(F.to_json("team"))), ",").alias("team_members"),
        F.size("athletes").cast("bigint").alias("n_groups"),
        nested_size("athletes", "items").alias("players"),
        F.to_json("athletes").contains('"links"').alias("has_links"),
    )


@query("schedule_dedupe", """
    SELECT CAST(o_orderkey AS VARCHAR) AS id,
        CAST(least(o_custkey % 32, (o_custkey + 1 + o_orderkey % 31) % 32) AS BIGINT) AS listed_by
    FROM orders
""")
def schedule_dedupe(spark, sf_dir):
    """Every game is on both teams' schedules; the first listing in request order stays."""
    events = landing.schedule_events(spark, sf_dir)
    teams = F.get("competitions", F.lit(0))["competitors"]["team"]["id"]
    listings = events.select("id", "position", F.explode(teams).alias("team"))
    listings = listings.select("id", "position", F.col("team").cast("bigint").alias("listed_by"))
    return L.unique_events(listings, "listed_by", "position").select("id", "listed_by")


@query("first_wins_union", """
    SELECT id, first_season, name FROM (
        SELECT CAST(o_custkey AS VARCHAR) AS id,
            CAST(year(o_orderdate) AS BIGINT) AS first_season, 'order ' || o_orderkey AS name,
            row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_orderkey) AS n
        FROM orders WHERE o_orderpriority <> '5-LOW') WHERE n = 1
""")
def first_wins_union(spark, sf_dir):
    """Athletes of several seasons: the first season that lists an id keeps it; blank ids go."""
    orders = landing.table(spark, sf_dir, "orders")
    blank = F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(F.lit(None).cast("string"))
    ident = F.when(F.col("o_orderpriority") == "5-LOW", blank).otherwise(F.col("o_custkey").cast("string"))
    listed = orders.select(
        ident.alias("id"), F.year("o_orderdate").cast("bigint").alias("first_season"),
        F.concat(F.lit("order "), "o_orderkey").alias("name"), "o_orderkey",
    )
    is_early = F.coalesce(F.col("first_season") < 1998, F.lit(False))
    early, late = listed.filter(is_early), listed.filter(~is_early)
    everyone = late.unionByName(early)
    first = first_rows(everyone, ["id"], "first_season", "o_orderkey")
    return first.select("id", "first_season", "name")


_KICKOFF_SQL = """CASE o_orderpriority WHEN '5-LOW' THEN o_orderdate + INTERVAL 12 HOUR
    WHEN '4-NOT SPECIFIED' THEN o_orderdate + to_seconds(73530) WHEN '3-MEDIUM' THEN NULL
    ELSE o_orderdate + INTERVAL 18 HOUR END"""


def _dated(spark, sf_dir):
    events = L.kickoff_and_completed(landing.schedule_events(spark, sf_dir))
    return events.select("id", "position", "kickoff", "done")


@query("target_selection", f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders
    WHERE {_KICKOFF_SQL} <= {NOW_SQL}
        AND (o_orderstatus <> 'F' OR {_KICKOFF_SQL} >= {NOW_SQL} - INTERVAL 3 DAY)
    ORDER BY o_orderkey LIMIT 50
""")
def target_selection(spark, sf_dir):
    """Games to fetch in one run: the first 50 due in arrival order (the cap is the feature)."""
    return L.target_games(_dated(spark, sf_dir), F.lit(NOW).cast("timestamp"), "position").select("id")


@query("due_games", f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders
    WHERE {_KICKOFF_SQL} <= {NOW_SQL} AND o_orderstatus = 'F'
        AND {_KICKOFF_SQL} >= {NOW_SQL} - INTERVAL 400 DAY
""")
def due_games(spark, sf_dir):
    """Recently finished games with a trailing window of 400 days and no cap."""
    now = F.lit(NOW).cast("timestamp")
    recent = F.col("kickoff") >= now - F.make_dt_interval(days=F.lit(400))
    return L.completed_games(_dated(spark, sf_dir), now).filter(recent).select("id")


@query("completed_selection", f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime({_KICKOFF_SQL}, '%Y-%m-%d %H:%M:%S') AS kickoff
    FROM orders WHERE o_orderstatus = 'F' AND {_KICKOFF_SQL} <= {NOW_SQL}
""")
def completed_selection(spark, sf_dir):
    done = L.completed_games(_dated(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return plain(done.select("id", "kickoff"))


@query("state_samples", """
    SELECT state, min(o_orderkey) AS position FROM (
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'post' WHEN 'P' THEN 'in' ELSE 'pre' END AS state
        FROM orders) GROUP BY state
""")
def state_samples(spark, sf_dir):
    events = landing.schedule_events(spark, sf_dir)
    states = events.select("position", F.get("competitions", F.lit(0))["status"]["type"]["state"].alias("state"))
    return L.sample_per_state(states, "state", "position").select("state", "position")


def _requests(spark, sf_dir):
    """Events as requests: an error event is a failed request, its user picks the dataset."""
    names = F.array(*(F.lit(n) for n in ("schedules", "game_summaries", "standings", "rosters")))
    return landing.table(spark, sf_dir, "events").select(
        "event_id",
        F.get(names, (F.col("user_id") % 4).cast("int")).alias("dataset"),
        F.date_trunc("day", "ts").alias("day"),
        F.dayofmonth("ts").cast("bigint").alias("season"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("request "), "event_id", F.lit(" failed"))).alias("error"),
        F.regexp_extract("props", "[0-9]+", 0).try_cast("bigint").alias("bytes"),
        F.lit(1).cast("bigint").alias("items"),
    )


_REQUESTS_SQL = """
    SELECT event_id, event_type = 'error' AS failed, CAST(day(ts) AS BIGINT) AS season,
        CASE user_id % 4 WHEN 0 THEN 'schedules' WHEN 1 THEN 'game_summaries' WHEN 2 THEN 'standings'
            ELSE 'rosters' END AS dataset,
        CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS bytes
    FROM events
"""


@query("split_results", f"""
    SELECT dataset, CAST(count(*) FILTER (WHERE NOT failed) AS BIGINT) AS good,
        CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS failed
    FROM ({_REQUESTS_SQL}) GROUP BY dataset
""")
def split_results(spark, sf_dir):
    """Good and failed requests as two frames, counted side by side."""
    good, failed = R.split_results(_requests(spark, sf_dir))
    sides = good.select("dataset", F.lit(1).alias("g"), F.lit(0).alias("f")).unionByName(
        failed.select("dataset", F.lit(0).alias("g"), F.lit(1).alias("f"))
    )
    return sides.groupBy("dataset").agg(F.sum("g").alias("good"), F.sum("f").alias("failed"))


_REPORT_SQL = f"""
    SELECT dataset, CAST(count(*) AS BIGINT) AS requests,
        CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS failures,
        CAST(count(*) FILTER (WHERE NOT failed) AS BIGINT) AS landed,
        CAST(coalesce(sum(bytes) FILTER (WHERE NOT failed), 0) AS BIGINT) AS bytes,
        CASE WHEN count(*) FILTER (WHERE failed) = count(*) THEN 'failed'
            WHEN count(*) FILTER (WHERE failed) > 0 THEN 'partial' ELSE 'success' END AS status
    FROM ({_REQUESTS_SQL}) GROUP BY dataset
"""


@query("load_status_rollup", _REPORT_SQL)
def load_status_rollup(spark, sf_dir):
    return R.dataset_report(_requests(spark, sf_dir))


@query("load_overall_status", f"""
    SELECT CAST(count(*) AS BIGINT) AS datasets, CAST(sum(requests) AS BIGINT) AS requests,
        CAST(sum(failures) AS BIGINT) AS failures, CAST(sum(bytes) AS BIGINT) AS bytes,
        CASE WHEN bool_and(status = 'failed') THEN 'failed'
            WHEN bool_or(status <> 'success') THEN 'partial' ELSE 'success' END AS status
    FROM ({_REPORT_SQL})
""")
def load_overall_status(spark, sf_dir):
    return R.overall_status(R.dataset_report(_requests(spark, sf_dir)))


@query("backfill_report", f"""
    SELECT season, CAST(count(*) FILTER (WHERE NOT failed AND dataset = 'schedules') AS BIGINT) AS games,
        CAST(count(*) FILTER (WHERE NOT failed AND dataset = 'game_summaries') AS BIGINT) AS summaries,
        CAST(count(*) FILTER (WHERE NOT failed AND dataset = 'standings') AS BIGINT) AS standings_entries,
        CAST(coalesce(sum(bytes) FILTER (WHERE NOT failed), 0) AS BIGINT) AS bytes,
        CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS failures
    FROM ({_REQUESTS_SQL}) GROUP BY season
""")
def backfill_report(spark, sf_dir):
    return R.season_report(_requests(spark, sf_dir))


@query("json_batch_scan", GAMES_SQL)
def json_batch_scan(spark, sf_dir):
    """Summaries written as landing files, read back with the declared schema and parsed."""
    games = TABLES["games"]
    root = work_dir(spark, "json-scan")
    records = landed(spark, sf_dir, "games").drop("_source_file", "_snapshot_at")
    write_landing(records, f"{root}/{games.prefix}", records_per_file=100_000)
    # Spark writes one record per line, so the files can be split.
    rows = parse(games, read_snapshots(spark, games, root, multiLine="false"))
    return plain(rows.select(*(f.name for f in games.fields)))


@query("landing_partitions", """
    SELECT strftime(ts, '%Y-%m-%d') AS landing_date, CAST(count(*) AS BIGINT) AS records,
        CAST(sum(event_id) AS BIGINT) AS id_sum
    FROM events GROUP BY 1
""")
def landing_partitions(spark, sf_dir):
    """Records landed in day folders and read back."""
    root = work_dir(spark, "landing")
    write_landing(landing.table(spark, sf_dir, "events"), root, moment="ts")
    landed_back = spark.read.schema("event_id BIGINT, landing_date STRING").json(root)
    return landed_back.groupBy("landing_date").agg(
        F.count(F.lit(1)).alias("records"), F.sum("event_id").alias("id_sum")
    )


@query("landing_chunks", "SELECT CAST(count(*) AS BIGINT) AS records, TRUE AS within_limit FROM orders")
def landing_chunks(spark, sf_dir):
    """Records chunked over files of at most 100; counted per file when read back."""
    root = work_dir(spark, "chunks")
    write_landing(landing.table(spark, sf_dir, "orders"), root, records_per_file=RECORDS_PER_FILE)
    files = spark.read.schema("o_orderkey BIGINT").json(root).groupBy(F.input_file_name()).count()
    return files.agg(
        F.sum("count").alias("records"), F.every(F.col("count") <= RECORDS_PER_FILE).alias("within_limit")
    )


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    root = work_dir(spark, "csv")
    customers = landing.table(spark, sf_dir, "customer")
    export_csv(customers, root)
    return spark.read.schema(customers.schema).option("header", True).csv(root)
