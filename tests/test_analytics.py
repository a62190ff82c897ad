import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from snaplake.plans import analytics as A
from snaplake.plans import scorecard as C

DAY = datetime(2025, 9, 7, 17, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def games(spark):
    rows = [("g1", 2025, 2, 1, DAY, True, 24, 20), ("g2", 2025, 2, 1, DAY.replace(hour=20), True, 45, 44),
            ("g3", 2025, 2, 1, DAY.replace(hour=10), False, 3, 0), ("g4", 2025, 2, 2, DAY, True, 30, 3),
            ("g5", 2025, 1, 1, DAY.replace(hour=1), True, 90, 90), ("g6", 2025, 2, 2, None, True, None, 7)]
    return spark.createDataFrame(rows, "game_id STRING, season INT, season_type INT, week INT, game_ts_utc TIMESTAMP,"
                                       " completed BOOLEAN, home_score BIGINT, away_score BIGINT")


@pytest.fixture(scope="module")
def box(spark):
    rows = [("g1", "7", "DEN", 300, 2.0), ("g1", "12", "KC", 400, 1.0), ("g2", "7", "DEN", 250, None),
            ("g2", "13", "LV", 100, 6.5), ("g4", "12", "KC", 10, 0.5), ("g4", "13", "LV", 20, 0.5),
            ("g5", "7", "DEN", 9999, 9.0)]
    return spark.createDataFrame(rows, "game_id STRING, team_id STRING, team_abbreviation STRING, total_yards BIGINT, sacks DOUBLE")


def test_games(games):
    assert tuple(A.first_home_score(games, 2025, 1).first()) == (24,)
    assert A.finished_count(games, 2025, 1).first()["games"] == 2
    assert A.highest_combined_score(games, 2025).first()["combined_score"] == 89
    assert A.decided_by(games, 2025, 10).first()["games"] == 1
    assert A.no_data(games, "game_id").count() == 0
    assert {tuple(r) for r in A.counts_by(games, "season_type").collect()} == {(2, 5), (1, 1)}


def test_teams(box, games):
    leader = A.team_leaders(box, games, 2025, "sacks").first()
    assert (leader["team_abbreviation"], leader["total"]) == ("LV", 7.0)
    assert A.team_total(box, games, 2025, "7", "total_yards").first()["total"] == 550
    assert A.team_allowed(box, games, 2025, "7", "total_yards").first()["total"] == 500
    assert A.game_box_score(box, "g1").count() == 2


def test_standings(spark):
    rows = [(2025, 2, "AFC", "25", "DEN", 14, 1), (2025, 2, "AFC", "12", "KC", 14, None), (2025, 2, "NFC", "16", "MIN", 9, 2),
            (2024, 2, "AFC", "12", "KC", 17, 1)]
    s = spark.createDataFrame(rows, "season INT, season_type INT, conference STRING, team_id STRING, team_abbreviation STRING,"
                                    " wins BIGINT, playoff_seed BIGINT")
    # A tie goes to the smaller key, and a NULL seed is not the best one.
    assert A.standings_leader(s, 2025, "wins").first()["team_abbreviation"] == "KC"
    assert A.standings_leader(s, 2025, "playoff_seed", conference="AFC", lowest=True).first()["team_abbreviation"] == "DEN"
    assert A.team_standing(s, 2025, "DEN", "wins").first()["wins"] == 14


def test_players_and_positions(spark):
    rows = [("a", "Ann", 2025, 2, 100), ("a", "Ann", 2025, 2, None), ("b", "Bea", 2025, 2, 99), ("c", "Cid", 2025, 2, None),
            ("b", "Bea", 2025, 1, 500)]
    stats = spark.createDataFrame(rows, "player_id STRING, player_name STRING, season INT, season_type INT, yards BIGINT")
    assert tuple(A.player_leaders(stats, 2025, "yards").first()) == ("a", "Ann", 100)
    assert [r["total"] for r in A.player_leaders(stats, 2025, "yards", n=5).collect()] == [100, 99, None]
    assert A.player_leaders(stats, 2025, "yards", season_type=3).count() == 0
    listed = [(2025, "1", "a", "QB", DAY), (2025, "2", "a", "WR", DAY.replace(month=10)), (2025, "1", "b", "TE", DAY)]
    rosters = spark.createDataFrame(listed, "season INT, team_id STRING, player_id STRING, position STRING, _snapshot_at TIMESTAMP")
    placed = A.with_position(stats, rosters)
    assert sorted((r["player_id"], r["position"]) for r in placed.collect()) == [("a", "WR"), ("a", "WR"), ("b", "TE"), ("b", "TE")]


def test_news_mentions(spark):
    rows = [(DAY, "Mahomes limited", ""), (DAY.replace(day=1), "x", "about MAHOMES"), (DAY.replace(month=1), "Mahomes", "")]
    news = spark.createDataFrame(rows, "created_at TIMESTAMP, title STRING, description STRING")
    assert A.news_mentions(news, "Mahomes", now=F.lit(DAY)).first()["articles"] == 2


GRADES = [
    ("numeric", "14", "They won 14 games", True, None), ("numeric", "100", "about 104.9", True, None),
    ("numeric", "100", "106", False, "wrong_value"), ("numeric", "3", "4", True, None),
    ("numeric", "0", "1", False, "wrong_value"), ("numeric", "0", "0 games", True, None),
    ("numeric", "5", "none at all", False, "wrong_value"), ("numeric", None, "0", True, None),
    ("numeric", None, "46", False, "wrong_value"), ("numeric", "-9", "-9.5", True, None),
    ("exact_string", "DEN", "It was **den**.", True, None), ("exact_string", " SF ", "__S_F__", True, None),
    ("exact_string", "KC", "Denver", False, "wrong_value"), ("exact_string", "a_b", "a_b", False, "wrong_value"),
    ("numeric", "n/a", "0", False, "grade_error"), ("numeric", "12 wins", "12", False, "grade_error"),
    ("exact_string", None, "  ", True, None), ("exact_string", None, "x", False, "wrong_value"),
    ("refusal", None, "I don't have that", True, None), ("refusal", None, "Sure: 12", False, "bad_refusal"),
    ("essay", "x", "x", False, "unknown_match_type"), ("numeric", None, None, False, "crash"),
]


def test_grades(spark):
    rows = [(str(i), m, e, a, None) for i, (m, e, a, _, _) in enumerate(GRADES)] + [("err", "numeric", "1", "1", "boom")]
    df = spark.createDataFrame(rows, "id STRING, match STRING, expected STRING, answer STRING, error STRING")
    got = {r["id"]: (r["correct"], r["failure"]) for r in C.grade(df).collect()}
    for i, (*_, correct, failure) in enumerate(GRADES):
        assert got[str(i)] == (correct, failure), GRADES[i]
    assert got["err"] == (False, "crash")


def test_verdicts_and_reports(spark):
    rows = [("q1", "c1", True, None), ("q1", "c1", True, None), ("q2", "c1", True, None), ("q2", "c1", False, "crash"),
            ("q3", "c2", False, "wrong_value"), ("q3", "c2", False, "wrong_value"), ("q3", "c2", False, "crash"),
            ("q4", "c2", False, "wrong_value"), ("q4", "c2", False, "crash")]
    graded = spark.createDataFrame(rows, "id STRING, category STRING, correct BOOLEAN, failure STRING")
    judged = C.verdicts(graded)
    got = {r["id"]: (r["runs"], r["correct"], r["failure"]) for r in judged.collect()}
    assert got == {"q1": (2, True, None), "q2": (2, False, "crash"), "q3": (3, False, "wrong_value"), "q4": (2, False, "crash")}
    assert tuple(C.overall(judged).first()) == (4, 1, 25.0)
    assert tuple(C.overall(judged.filter("false")).first()) == (0, 0, 0.0)
    assert {tuple(r) for r in C.by_category(judged).collect()} == {("c1", 2, 1, 50.0), ("c2", 2, 0, 0.0)}
    assert {tuple(r) for r in C.by_failure(judged).collect()} == {("crash", 2), ("wrong_value", 1)}
    before, after = C.by_category(judged.filter("category = 'c1'")), C.by_category(judged.filter("category = 'c2'"))
    assert {tuple(r) for r in C.compare(before, after).collect()} == {("c1", 1, 0, -1), ("c2", 0, 0, 0)}


# What the stored results of four runs add up to: category, questions, correct ones in each run (fixed values).
STORED = (
    ("single_table_lookup", 3, (0, 0, 3, 3)),
    ("standings", 5, (1, 1, 4, 5)),
    ("game_results", 4, (2, 3, 0, 3)),
    ("player_aggregate", 5, (0, 0, 3, 3)),
    ("team_aggregate", 3, (0, 0, 1, 1)),
    ("schema_trap", 4, (0, 0, 1, 0)),
    ("injury_news", 1, (0, 0, 0, 0)),
    ("refusal", 3, (1, 1, 2, 0)),
)


def test_roll_up_of_stored_results(spark, tmp_path):
    runs = ("baseline", "fixed", "fixed_v2", "baseline_rerun")
    for k, label in enumerate(runs):
        questions = []
        for category, n, good in STORED:
            for i in range(n):
                bad = {"correct": False, "failure": "wrong_value", "answer": "x"}
                verdicts = [{"correct": True, "failure": None}] + ([] if i < good[k] else [bad, {"correct": False, "failure": "crash"}, bad])
                questions.append({"id": f"{category}-{i}", "category": category, "expected": i, "verdicts": verdicts})
        questions.append({"id": "unasked", "category": "none", "verdicts": []})
        (tmp_path / f"{label}.json").write_text(json.dumps({"label": label, "total": 0, "questions": questions}, indent=2))
    judged = C.stored_verdicts(spark, str(tmp_path))
    got = {(r["label"], r["category"]): (r["total"], r["correct"]) for r in C.by_category(judged, "label").collect()}
    want = {(label, category): (n, good[k]) for k, label in enumerate(runs) for category, n, good in STORED}
    assert got == want | {(label, "none"): (1, 1) for label in runs}
    assert {r["failure"] for r in C.by_failure(judged).collect()} == {"wrong_value"}
