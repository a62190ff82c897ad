import json
from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from snaplake.operators import landing as L
from snaplake.operators import reports as R
from snaplake.plans.parsers import PARSERS
from snaplake.sources.snapshots import export_csv, read_snapshots, write_landing
from snaplake.tables import TABLES
from tests.payloads import ELKS, HERONS, PLAYERS, ROSTERS, SCHEDULES, STANDINGS, SUMMARIES, TEAMS


@pytest.fixture
def read(spark, tmp_path):
    """A response as Spark infers it, extra fields included."""

    def from_payload(payload):
        path = tmp_path / "response.json"
        path.write_text(json.dumps(payload))
        return spark.read.option("multiLine", True).json(str(path))

    return from_payload


def records(df):
    return [json.loads(r) for r in df.toJSON().collect()]


def without_nulls(value):
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [without_nulls(v) for v in value]
    return value


def test_teams(read):
    junk = {"logos": [{"href": "x"}], "links": ["y"]}
    response = {"sports": [{"leagues": [{"teams": [{"team": {**t, **junk}} for t in TEAMS]}]}]}
    assert records(L.land_teams(read(response))) == TEAMS


def test_players(read):
    page = {"count": 4081, "items": [{**p, "links": ["x"]} for p in PLAYERS]}
    assert records(L.land_players(read(page))) == PLAYERS


def test_rosters(read):
    response = json.loads(json.dumps(ROSTERS[0]))
    response["team"]["logo"] = "x"
    for g in response["athletes"]:
        for p in g["items"]:
            p.update(headshot={"href": "x"}, contracts=[1], injuries=[2])
    assert records(L.land_rosters(read(response))) == ROSTERS


def test_standings_and_the_empty_guard(read):
    response = json.loads(json.dumps(STANDINGS[0]))
    response["season"] = {"year": 2026}
    for c in response["children"]:
        c["id"] = "8"
        for e in c["standings"]["entries"]:
            e["team"].update(logos=["x"], links=["y"])
    raw = read(response)
    got = records(L.require_entries(L.land_standings(raw)))
    want = without_nulls(response)
    for c in want["children"]:
        for e in c["standings"]["entries"]:
            del e["team"]["logos"], e["team"]["links"]
            for s in e["stats"]:  # numbers and placeholders in one field are read as text
                s.update({"value": str(s["value"])} if "value" in s else {})
    assert [without_nulls(r) for r in got] == [want]
    hollow = L.land_standings(raw.withColumn("children", F.filter("children", lambda c: F.lit(False))))
    with pytest.raises(PySparkException, match="without entries"):
        L.require_entries(hollow).collect()


def test_schedule(read):
    events = json.loads(json.dumps(SCHEDULES))
    for e in events:
        e["links"] = ["x"]
        for c in e["competitions"]:
            c.update(broadcasts=["tv"], tickets=["t"], notes=[], ticketsAvailable=True)
            for s in c["competitors"]:
                s.update(leaders=["l"], record=["r"], curatedRank={"current": 1})
                s["team"].update(logos=["x"], links=["y"])
    assert [without_nulls(r) for r in records(L.land_schedule(read(events)))] == without_nulls(SCHEDULES)


def test_summaries(read, spark, land):
    response = json.loads(json.dumps(SUMMARIES[0]))
    response["game_id"] = 9001
    response["gameInfo"]["venue"]["images"] = ["x"]
    response["leaders"] = [1]
    response["boxscore"]["teams"][0]["team"]["logo"] = "x"
    response["header"]["competitions"][0]["competitors"][0]["record"] = ["r"]
    landed = L.land_summaries(read(response))
    assert landed.columns == ["game_id", "header", "gameInfo", "boxscore"]
    table = TABLES["player_game_stats"]
    root = land(table, records(landed))
    again = PARSERS[table.name](read_snapshots(spark, table, root)).drop("_source_file", "_snapshot_at", "_ingested_at")
    root = land(table, SUMMARIES, name="b")
    both = PARSERS[table.name](read_snapshots(spark, table, root)).drop("_source_file", "_snapshot_at", "_ingested_at")
    assert both.count() == 2 * again.count() and both.distinct().count() == again.count()
    text = landed.toJSON().first()
    assert "images" not in text and '"logo"' not in text and "leaders" not in text and '"record"' not in text


NOW = datetime(2026, 10, 5, tzinfo=timezone.utc)


def game(ident, date, completed):
    return {"id": ident, "competitions": [{"date": date, "status": {"type": {"completed": completed, "state": "x"}},
                                           "competitors": [{"homeAway": "home", "team": HERONS}, {"homeAway": "away", "team": ELKS}]}]}


@pytest.fixture
def events(spark, land):
    def make(*games):
        root = land(TABLES["schedules"], [*games])
        df = read_snapshots(spark, TABLES["schedules"], root)
        return L.kickoff_and_completed(df.withColumn("position", F.monotonically_increasing_id()))

    return make


def ids(df):
    return [r["id"] for r in df.collect()]


def test_target_selection(events):
    games = [game("in_progress", "2026-10-04T20:00Z", False), game("future", "2026-10-12T20:00Z", False),
             game("recent", "2026-10-04T17:00Z", True), game("old", "2026-09-27T17:00Z", True),
             game("edge", "2026-10-02T00:00Z", True), game("undated", None, False),
             game("unknown", "2026-09-01T00:00Z", None)]
    dated = events(*games)
    assert ids(L.target_games(dated, F.lit(NOW), "position")) == ["in_progress", "recent", "edge", "unknown"]
    assert ids(L.target_games(dated, F.lit(NOW), "position", days=10))[:3] == ["in_progress", "recent", "old"]
    assert sorted(ids(L.completed_games(dated, F.lit(NOW)))) == ["edge", "old", "recent"]


def test_target_cap_takes_the_first(events):
    many = [game(str(i), "2026-10-04T20:00Z", False) for i in range(60)]
    assert ids(L.target_games(events(*many), F.lit(NOW), "position", most=2)) == ["0", "1"]
    assert len(ids(L.target_games(events(*many), F.lit(NOW), "position"))) == 50


def test_unique_events_and_samples(spark):
    lists = spark.createDataFrame([(0, 0, "1"), (0, 1, "2"), (1, 0, "2"), (1, 1, "3"), (1, 2, None), (1, 3, "")],
                                  "team INT, place INT, id STRING")
    got = {(r["id"], r["team"]) for r in L.unique_events(lists, "team", "place").collect()}
    assert got == {("1", 0), ("2", 0), ("3", 1)}
    games = spark.createDataFrame([("post", 2), ("pre", 1), ("post", 1)], "state STRING, place INT")
    assert {tuple(r) for r in L.sample_per_state(games, "state", "place").collect()} == {("post", 1), ("pre", 1)}


def test_reports(spark):
    rows = [("schedules", 1, None, 10, 5), ("schedules", 1, "timeout", 0, 0), ("standings", 1, "x", 0, 0),
            ("game_summaries", 2, None, 7, 3)]
    results = spark.createDataFrame(rows, "dataset STRING, season INT, error STRING, bytes BIGINT, items BIGINT")
    report = R.dataset_report(results)
    assert {r["dataset"]: (r["status"], r["failures"], r["bytes"]) for r in report.collect()} == {
        "schedules": ("partial", 1, 10), "standings": ("failed", 1, 0), "game_summaries": ("success", 0, 7)}
    assert R.overall_status(report).first()["status"] == "partial"
    assert R.overall_status(report.filter("status = 'failed'")).first()["status"] == "failed"
    assert R.overall_status(report.filter("status = 'success'")).first()["status"] == "success"
    assert R.overall_status(report.filter("false")).first()["status"] == "success"
    good, failed = R.split_results(results)
    assert (good.count(), failed.count()) == (2, 2)
    seasons = {r["season"]: tuple(r)[1:] for r in R.season_report(results).collect()}
    assert seasons == {1: (5, 0, 0, 10, 2), 2: (0, 3, 0, 7, 0)}


def test_files(spark, tmp_path):
    df = spark.range(250).withColumn("t", F.timestamp_seconds(F.lit(1700000000) + F.col("id") * 1000))
    write_landing(df.coalesce(1), str(tmp_path / "landing"), moment="t", records_per_file=100)
    days = sorted(p.name for p in (tmp_path / "landing").iterdir() if p.is_dir())
    assert days[0] == "landing_date=2023-11-14" and len(days) == 4
    files = list((tmp_path / "landing").rglob("*.json"))
    assert all(len(f.read_text().splitlines()) <= 100 for f in files)
    export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["id", "t"] and back.count() == 250
