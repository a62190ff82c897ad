import itertools
import random
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.operators.latest import dedupe_latest, first_rows, latest_rows, top_n_per_group
from snaplake.operators.merge import assert_unique, key_counts, merge_latest, merge_statement
from snaplake.plans.parsers import PARSERS
from snaplake.sources.files import Folder
from snaplake.sources.snapshots import read_snapshots
from snaplake.sources.target import Load, SnapshotTable
from snaplake.spec import COUNT, TEXT, Table, col, key
from snaplake.tables import TABLES
from tests.payloads import SUMMARIES

TEAM = Table(
    name="team", prefix="t", raw="team_id STRING, abbreviation STRING",
    fields=(key("team_id", TEXT), col("abbreviation", TEXT)),
)
T1, T2, T3 = (datetime(2026, 9, d, tzinfo=timezone.utc) for d in (1, 2, 3))


@pytest.fixture
def batch(spark):
    def make(*rows):
        df = spark.createDataFrame(
            list(rows), "team_id STRING, abbreviation STRING, _snapshot_at TIMESTAMP, _source_file STRING"
        )
        return df.withColumn("_ingested_at", F.current_timestamp()).select(*TEAM.columns)

    return make


@pytest.fixture(params=["plan", "target"])
def merge_all(request, spark, batch, tmp_path):
    """Merges batches one after the other, as a plan or through the parquet target."""

    def run(*batches):
        if request.param == "plan":
            held = spark.createDataFrame([], TEAM.schema)
            for b in batches:
                held = merge_latest(held, batch(*b), TEAM)
            rows = held
        else:
            target = SnapshotTable(spark, str(tmp_path / "team"), TEAM, buckets=4)
            for b in batches:
                target.upsert(batch(*b))
            rows = target.read()
        return {r["team_id"]: r["abbreviation"] for r in rows.collect()}

    return run


STEP = {"before": T1, "same": T2, "after": T3, "unknown": None}


@pytest.mark.parametrize("held", STEP)
@pytest.mark.parametrize("comes", STEP)
def test_a_row_gives_way_only_to_a_strictly_newer_one(merge_all, held, comes):
    """All pairs of snapshots; a key of its own on each side shows that both batches arrive."""
    got = merge_all(
        [("both", "first", STEP[held], "m"), ("early", "e", STEP[held], "m")],
        [("both", "second", STEP[comes], "n"), ("late", "l", STEP[comes], "n")],
    )
    newer = STEP[held] is not None and STEP[comes] is not None and STEP[comes] > STEP[held]
    assert got == {"both": "second" if newer else "first", "early": "e", "late": "l"}


def test_batches_may_repeat_and_hold_several_versions(merge_all):
    rows = [(f"k{i % 3}", f"v{i}", (T1, T2, T3)[i % 5 % 3], f"f{i:02}") for i in range(15)]
    want = {}
    for key_, value, *order in sorted(rows, key=lambda r: (r[2], r[3])):
        want[key_] = value
    assert merge_all(rows) == want
    assert merge_all(rows, rows, rows[:7]) == want


def test_null_key_fails(merge_all):
    with pytest.raises(PySparkException, match="null key team_id"):
        merge_all([("k", "fine", T2, "f"), (None, "keyless", T2, "f")])


def test_any_order_of_batches_gives_the_same_table(spark, batch, tmp_path):
    rng = random.Random(7)
    rows = [(str(k), f"v{k}-{d}", datetime(2026, 9, d, tzinfo=timezone.utc), f"f{d}")
            for k in range(6) for d in rng.sample(range(1, 20), 4)]
    want = {k: max((r for r in rows if r[0] == k), key=lambda r: r[2])[1] for k in {r[0] for r in rows}}
    parts = [rows[i::3] for i in range(3)]
    for order in itertools.permutations(parts):
        held = spark.createDataFrame([], TEAM.schema)
        for part in (*order, order[0]):
            held = merge_latest(held, batch(*part), TEAM)
        assert {r["team_id"]: r["abbreviation"] for r in held.collect()} == want


def test_composite_key(spark, land, tmp_path):
    table = TABLES["game_team_stats"]
    rows = PARSERS[table.name](read_snapshots(spark, table, land(table, SUMMARIES)))
    target = SnapshotTable(spark, str(tmp_path / "stats"), table, buckets=4)
    target.upsert(rows)
    target.upsert(rows)
    assert target.read().count() == 2
    assert_unique(target.read(), table.keys)


def files(target):
    """Data files by their place."""
    root = Path(target.data)
    found = {}
    for p in root.rglob("*.parquet"):
        found.setdefault(str(p.parent.relative_to(root)), set()).add(p.name)
    return found


def replaced(before, after):
    return {place for place in before.keys() | after.keys() if before.get(place) != after.get(place)}


def test_target_loads_and_untouched_buckets(spark, batch, tmp_path):
    target = SnapshotTable(spark, str(tmp_path / "team"), TEAM, buckets=16)
    assert target.version() == 0 and target.loads().count() == 0
    target.upsert(batch(*((str(i), f"v{i}", T1, "a") for i in range(40))))
    before = files(target)
    assert target.upsert(batch(("3", "new", T2, "b"), ("99", "added", T2, "b"))) == Load(1, 1)
    assert 1 <= len(replaced(before, files(target))) <= 2
    assert target.read().count() == 41 and target.version() == 2
    newest = target.loads(1).first()
    assert (newest.version, newest.rows_inserted, newest.rows_updated, newest.rows_total) == (2, 1, 1, 41)
    assert [r.version for r in target.loads(0).collect()] == [2]


def test_no_list_of_keys_or_places_is_collected(spark, batch, tmp_path, monkeypatch):
    """All that comes to the driver is one row of counts."""
    target = SnapshotTable(spark, str(tmp_path / "team"), TEAM, buckets=16)
    rows, more = batch(*((str(i), "v", T1, "a") for i in range(40))), batch(*((str(i), "w", T2, "a") for i in range(30, 50)))
    got = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: got.append(collect(df)) or got[-1])
    monkeypatch.setattr(DataFrame, "toPandas", None)
    monkeypatch.setattr(DataFrame, "toArrow", None)
    assert (target.upsert(rows), target.upsert(more)) == (Load(40, 0), Load(10, 10))
    assert all(len(rows) == 1 for rows in got)


SEASONS = Table(
    name="seasons", prefix="s", raw="game STRING, season BIGINT, score BIGINT", partitions=("season",),
    fields=(key("game", TEXT), col("season", COUNT), col("score", COUNT)),
)


@pytest.fixture
def seasons(spark, tmp_path):
    target = SnapshotTable(spark, str(tmp_path / "seasons"), SEASONS, buckets=2)

    def put(*rows):
        df = spark.createDataFrame(
            [(*r, "f") for r in rows], "game STRING, season BIGINT, score BIGINT, _snapshot_at TIMESTAMP, _source_file STRING"
        )
        return target.upsert(df.withColumn("_ingested_at", F.current_timestamp()).select(*SEASONS.columns))

    put(*((f"g{i}", 2030 + i % 3, i, T1) for i in range(60)), ("none", None, 5, T1))
    return target, put


def test_a_batch_rewrites_only_the_season_it_changes(seasons):
    target, put = seasons
    before = files(target)
    assert put(("g0", 2030, 100, T2), ("new", 2030, 7, T2), ("g1", 2031, 1, T1)) == Load(1, 1)
    moved = replaced(before, files(target))
    assert moved and all(p.startswith("season=2030/") for p in moved)
    assert {r.game: r.score for r in target.read().collect()} == {
        **{f"g{i}": i for i in range(60)}, "none": 5, "g0": 100, "new": 7,
    }


def test_a_replay_writes_no_file(seasons):
    target, put = seasons
    before = files(target)
    assert put(*((f"g{i}", 2030 + i % 3, -i, T1) for i in range(60))) == Load() == put()
    assert files(target) == before and target.version() == 1


def test_a_key_may_move_to_another_season(seasons):
    target, put = seasons
    put(("none", 2031, 6, T2), ("g2", None, 8, T2))
    rows = {r.game: (r.season, r.score) for r in target.read().collect()}
    assert len(rows) == target.read().count() == 61 and rows["none"] == (2031, 6) and rows["g2"] == (None, 8)


def test_a_place_may_lose_its_last_row_and_fill_again(seasons, spark):
    target, put = seasons
    assert put(("none", 2040, 6, T2)) == put(("none", 2041, 6, T3)) == Load(0, 1)
    count = lambda: {r.season: r["count"] for r in target.read().groupBy("season").count().collect()}
    assert count() == {2030: 20, 2031: 20, 2032: 20, 2041: 1}
    put(("other", 2040, 1, T1))
    assert count() == {2030: 20, 2031: 20, 2032: 20, 2041: 1, 2040: 1}
    hollow = spark.read.parquet(target.data).where("game IS NULL")
    assert {r.season for r in hollow.collect()} <= {None, 2040}


def test_a_move_lost_half_way_is_put_right_by_the_same_batch(seasons, tmp_path):
    """The new place has come in, the old one still holds the key: the batch comes again."""
    target, put = seasons
    old = {p: p.read_bytes() for p in Path(target.data).rglob("*.parquet")}
    move = ("g3", 2055, 9, T2)
    put(move)
    stood = [p for p in old if p.parent.parent.name == "season=2030" and not p.exists()]
    for p in stood:
        for q in p.parent.glob("*.parquet"):
            q.unlink()
        p.write_bytes(old[p])
        for crc in p.parent.glob(".*.crc"):
            crc.unlink()
    assert stood and target.read().where("game = 'g3'").count() == 2
    assert put(move) == Load()
    assert [(r.season, r.score) for r in target.read().where("game = 'g3'").collect()] == [(2055, 9)]
    assert target.read().count() == 61


def test_a_key_that_stands_twice_after_a_load_is_found(seasons, monkeypatch):
    """A second row of the key turns up in another season while the load is written."""
    target, put = seasons
    write = SnapshotTable._overwrite

    def write_and_plant(self, changed):
        write(self, changed)
        other = self.placed().where("game = 'g0'").withColumn("season", F.lit(2099))
        other.drop("_place").coalesce(1).write.mode("append").partitionBy("season", "_bucket").parquet(self.data)

    with monkeypatch.context() as broken:
        broken.setattr(SnapshotTable, "_overwrite", write_and_plant)
        with pytest.raises(ValueError, match="2 rows but 1 distinct keys"):
            put(("g0", 2030, 5, T2))
    put(("g0", 2030, 5, T2))  # the same batch again
    assert [(r.season, r.score) for r in target.read().where("game = 'g0'").collect()] in ([(2030, 5)], [(2099, 5)])
    assert_unique(target.read(), target.keys)


def test_upserts_prune_places_they_cannot_touch(seasons, spark):
    target, _ = seasons
    df = spark.createDataFrame([("g0", 2030, 1, "f", T2, T1)], SEASONS.schema)
    plan = target._changed(dedupe_latest(df, SEASONS))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_a_season_filter_reads_its_partition_only(seasons, spark):
    target, _ = seasons
    plan = target.read().where("season = 2031")._jdf.queryExecution().executedPlan().toString()
    assert "season#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    found = target.read().where("season = 2031 AND game = 'g1'").select("_metadata.file_path").distinct().count()
    assert 1 == found < len(target.read().inputFiles())
    assert SnapshotTable(spark, target.path).read().where("season IS NULL").count() == 1


def test_half_written_data_is_never_read(spark, batch, tmp_path):
    target = SnapshotTable(spark, str(tmp_path / "team"), TEAM, buckets=4)
    target.upsert(batch(("k7", "seven", T2, "f")))
    junk = tmp_path / "team" / "data" / ".spark-staging-lost" / "_bucket=0"
    junk.mkdir(parents=True)
    (junk / "part-0.parquet").write_bytes(b"not parquet")
    (tmp_path / "team" / "_loads" / ".part-0.json.draft").write_text("{")
    assert target.version() == 1 and target.read().count() == 1
    with pytest.raises(FileExistsError):
        Folder(spark, target.path).create("_table.json", "{}")


def test_statement_for_merge_capable_catalogs(spark):
    sql = merge_statement(TABLES["game_team_stats"], "updates")
    spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    assert "t.game_id = s.game_id AND t.team_id = s.team_id" in sql
    assert "s._snapshot_at > t._snapshot_at" in sql


def test_key_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k INT, l STRING")
    assert tuple(key_counts(df, ["k", "l"]).first()) == (3, 1)
    with pytest.raises(ValueError, match="3 rows but 1 distinct keys"):
        assert_unique(df, ["k", "l"])


def test_latest_first_and_top_n_against_brute_force(spark):
    rng = random.Random(3)
    # One key holds a third of all rows.
    rows = [(0 if rng.random() < 0.33 else rng.randrange(1, 30), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k INT, s INT, i INT")
    groups = {k: [r for r in rows if r[0] == k] for k in {r[0] for r in rows}}
    latest = {tuple(r) for r in latest_rows(df, ["k"], "s", "i").collect()}
    assert latest == {max(g, key=lambda r: (r[1], r[2])) for g in groups.values()}
    first = {tuple(r) for r in first_rows(df, ["k"], "s", "i").collect()}
    assert first == {min(g, key=lambda r: (r[1], r[2])) for g in groups.values()}
    for n in (3, 1001):
        got = {tuple(r) for r in top_n_per_group(df, ["k"], [F.col("s").desc(), F.col("i")], n).collect()}
        want = {
            (*r, place) for g in groups.values()
            for place, r in enumerate(sorted(g, key=lambda r: (-r[1], r[2]))[:n], 1)
        }
        assert got == want


def test_latest_carries_maps(spark):
    df = spark.sql("SELECT 1 AS k, 1 AS s, map('a', 1, 'b', 2) AS m UNION ALL SELECT 1, 2, NULL UNION ALL SELECT 2, 1, map('c', 3)")
    assert {r.k: r.m for r in latest_rows(df, ["k"], "s").collect()} == {1: None, 2: {"c": 3}}
    assert {r.k: r.m for r in first_rows(df, ["k"], "s").collect()} == {1: {"a": 1, "b": 2}, 2: {"c": 3}}


def test_latest_combines_before_the_shuffle_and_takes_key_filters(spark, tmp_path):
    spark.range(100).selectExpr("id % 7 AS team_id", "id", "id AS f").write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    plan = latest_rows(df, ["team_id"], "id", "f").filter("team_id = 3")._jdf.queryExecution().toString()
    assert "partial_max" in plan and "PushedFilters: [IsNotNull(team_id), EqualTo(team_id,3)]" in plan


def test_dedupe_of_a_parsed_table_keeps_its_schema(spark, land):
    table = TABLES["teams"]
    rows = PARSERS["teams"](read_snapshots(spark, table, land(table, [{"id": "1", "name": "A"}, {"id": "1", "name": "B"}])))
    out = dedupe_latest(rows, table)
    assert out.columns == table.columns and [r["name"] for r in out.collect()] == ["B"]
