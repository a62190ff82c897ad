import os
import shutil
import time

from snaplake.plans.parsers import PARSERS
from snaplake.sources.snapshots import read_snapshots, split_records, stream_snapshots
from snaplake.sources.target import SnapshotTable
from snaplake.streaming.ingest import ingest_available, ingest_batch, unreadable
from snaplake.tables import TABLES
from tests.payloads import NEWS, SCHEDULES, SUMMARIES

TEAMS = TABLES["teams"]


def team(ident, name):
    return {"id": ident, "abbreviation": name}


def test_files_once_newer_wins_and_replay(spark, land, tmp_path):
    root = land(TEAMS, [team("1", "OLD"), team("2", "KEEP")], day="2026-09-01", name="a")
    target = SnapshotTable(spark, str(tmp_path / "teams"), TEAMS, buckets=4)
    run = lambda check: ingest_available(spark, target, root, str(tmp_path / check), files_per_batch=1)
    run("check")
    assert target.version() == 1
    land(TEAMS, [team("1", "NEW"), team("3", "ADDED")], day="2026-09-02", name="b")
    older = os.path.getmtime(tmp_path / "landing" / TEAMS.prefix / "2026-09-01" / "a.json")
    os.utime(tmp_path / "landing" / TEAMS.prefix / "2026-09-02" / "b.json", (older + 60, older + 60))
    run("check")
    want = {"1": "NEW", "2": "KEEP", "3": "ADDED"}
    assert {r["team_id"]: r["abbreviation"] for r in target.read().collect()} == want
    version = target.version()
    run("check")
    assert target.version() == version  # nothing new: no batch
    run("fresh-check")  # all files again, one batch each
    assert {r["team_id"]: r["abbreviation"] for r in target.read().collect()} == want
    assert target.read().count() == 3


def test_a_checkpoint_made_anew_at_the_same_path_loses_no_batch(spark, land, tmp_path):
    root = land(TEAMS, [team("1", "A")], name="a")
    target = SnapshotTable(spark, str(tmp_path / "teams"), TEAMS, buckets=4)
    ingest_available(spark, target, root, str(tmp_path / "check"))
    shutil.rmtree(tmp_path / "check")
    (tmp_path / "landing" / TEAMS.prefix / "2026-09-20" / "a.json").unlink()
    land(TEAMS, [team("2", "B")], name="b")
    ingest_available(spark, target, root, str(tmp_path / "check"))
    assert sorted(r["team_id"] for r in target.read().collect()) == ["1", "2"]
    assert [r.rows_inserted for r in target.loads().collect()] == [1, 1]


def test_stream_equals_batch_for_every_shape(spark, land, tmp_path):
    for name, payload in (("schedules", SCHEDULES), ("player_game_stats", SUMMARIES), ("injury_news", NEWS)):
        table = TABLES[name]
        root = land(table, payload)
        target = SnapshotTable(spark, str(tmp_path / name), table, buckets=4)
        ingest_available(spark, target, root, str(tmp_path / f"check-{name}"))
        fields = [f.name for f in table.fields]
        batch = PARSERS[name](read_snapshots(spark, table, root)).select(*fields)
        assert sorted(map(repr, target.read().select(*fields).collect())) == sorted(map(repr, batch.collect()))


def test_parsers_are_map_only_on_a_stream(spark, land):
    for name, table in TABLES.items():
        root = land(table, [])
        plan = PARSERS[name](stream_snapshots(spark, table, root))
        assert plan.isStreaming
        logical = plan._jdf.queryExecution().analyzed().toString()
        assert "Aggregate" not in logical and "Join" not in logical and "Window" not in logical


def test_snapshot_is_the_file_time(spark, land, tmp_path):
    root = land(TEAMS, [team("1", "A")])
    path = tmp_path / "landing" / TEAMS.prefix / "2026-09-20" / "a.json"
    moment = int(time.time()) - 5000
    os.utime(path, (moment, moment))
    row = PARSERS["teams"](read_snapshots(spark, TEAMS, root)).selectExpr("unix_timestamp(_snapshot_at) AS t", "_source_file").first()
    assert row["t"] == moment and row["_source_file"].endswith("/espn/teams/2026-09-20/a.json")


def kept(target):
    return sorted((os.path.basename(r["_source_file"]), r["text"], r["partly"]) for r in unreadable(target).collect())


def put(tmp_path, name, text):
    folder = tmp_path / "landing" / TEAMS.prefix / "2026-09-20"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return str(tmp_path / "landing")


LINES = '{"id": "1", "abbreviation": "A"}\n{"id": "2", "abbre\n\n{"id": "3", "abbreviation": "C", "venue": 7}\nnot json\n'
BAD = [("lines.json", "not json", False), ("lines.json", '{"id": "2", "abbre', False)]


def test_unreadable_lines_are_kept_and_the_others_loaded(spark, tmp_path):
    root = put(tmp_path, "lines.json", LINES)
    put(tmp_path, "fine.json", '{"id": "4", "abbreviation": "D"}')
    target = SnapshotTable(spark, str(tmp_path / "teams"), TEAMS, buckets=2)
    assert ingest_batch(spark, target, root, multiLine="false").rows_inserted == 3
    assert kept(target) == sorted(BAD)
    ingest_batch(spark, target, root, multiLine="false")  # the same files again: nothing is kept twice
    assert kept(target) == sorted(BAD) and target.read().count() == 3
    good, aside = split_records(TEAMS, read_snapshots(spark, TEAMS, root, unreadable=True, multiLine="false"))
    assert (good.count(), aside.count()) == (3, 2)


def test_a_stream_goes_on_over_a_cut_file(spark, tmp_path):
    target = SnapshotTable(spark, str(tmp_path / "teams"), TEAMS, buckets=2)
    cut = '[{"id": "8", "abbreviation": "X"}, {"id": "9", "abb'
    root = put(tmp_path, "cut.json", cut)
    put(tmp_path, "fine.json", '[{"id": "1", "abbreviation": "A"}]')
    for check in ("check", "check", "fresh-check"):
        ingest_available(spark, target, root, str(tmp_path / check), files_per_batch=1)
    assert [r["team_id"] for r in target.read().collect()] == ["1"]
    assert kept(target) == [("cut.json", cut, False)]


def test_nothing_unreadable_leaves_no_trace(spark, land, tmp_path):
    target = SnapshotTable(spark, str(tmp_path / "teams"), TEAMS, buckets=2)
    ingest_batch(spark, target, land(TEAMS, [team("1", "A")]))
    assert unreadable(target).count() == 0 and not (tmp_path / "teams" / "_unreadable").exists()


def test_a_field_of_the_wrong_kind_is_null_and_the_record_is_also_kept(spark, tmp_path):
    table = TABLES["schedules"]
    folder = tmp_path / "landing" / table.prefix
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('[{"id": "g1", "season": {"year": "no number"}}]')
    records = read_snapshots(spark, table, str(tmp_path / "landing"), unreadable=True)
    good, aside = split_records(table, records)
    assert [r["id"] for r in good.collect()] == ["g1"] and [r["partly"] for r in aside.collect()] == [True]


def test_a_backlog_comes_in_batches_of_bytes_and_is_archived(spark, tmp_path):
    sizes = [1, 1, 1, 400, 1, 1, 200, 1]
    for n, size in enumerate(sizes):
        root = put(tmp_path, f"{n}.json", str([{"id": f"{n}-{k}", "abbreviation": "x" * 100} for k in range(size)]).replace("'", '"'))
        os.utime(tmp_path / "landing" / TEAMS.prefix / "2026-09-20" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    target = SnapshotTable(spark, str(tmp_path / "teams"), TEAMS, buckets=2)
    run = lambda: ingest_available(
        spark, target, root, str(tmp_path / "check"), bytes_per_batch=20_000, archive=str(tmp_path / "archive")
    )
    first = run()
    batches = [p["numInputRows"] for p in first.recentProgress if p["numInputRows"]]
    assert len(batches) > 2 and sum(batches) == sum(sizes) == target.read().count()
    assert max(n for n in batches if n < 200) < 200  # only a file that is larger by itself goes beyond the bound
    put(tmp_path, "late.json", '[{"id": "late", "abbreviation": "y"}]')
    run()
    assert target.read().count() == sum(sizes) + 1
    moved = {p.name for p in (tmp_path / "archive").rglob("*.json")}
    left = {p.name for p in (tmp_path / "landing").rglob("*.json")}
    assert moved and not moved & left and moved | left == {f"{n}.json" for n in range(len(sizes))} | {"late.json"}
