"""Running totals against totals computed anew, over loads that replace, move, repeat and are lost."""

import random
import shutil
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from snaplake.operators.totals import RunningTotals
from snaplake.plans.analytics import player_leaders
from snaplake.sources.target import SnapshotTable
from snaplake.spec import COUNT, RATE, TEXT, Table, col, key

STATS = Table(
    name="stats", prefix="s", raw="", partitions=("season",),
    fields=(key("game_id", TEXT), key("player_id", TEXT), col("season", COUNT), col("season_type", COUNT), col("player_name", TEXT),
            col("yards", COUNT), col("sacks", COUNT), col("rate", RATE)),
)
GROUPS = ["season", "season_type", "player_id", "player_name"]
START = datetime(2026, 9, 1, tzinfo=timezone.utc)


@pytest.fixture
def lake(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "stats"), STATS, buckets=4)
    totals = RunningTotals(spark, str(tmp_path / "totals"), GROUPS, ["yards", "sacks"])

    def put(rows, day):
        kinds = "game_id STRING, player_id STRING, season LONG, season_type LONG, player_name STRING, yards LONG, sacks LONG, rate DOUBLE"
        df = spark.createDataFrame(rows, kinds).withColumn("_source_file", F.lit("f"))
        at = F.lit(START + timedelta(days=day)).alias("_snapshot_at")
        df = df.select("*", at, F.current_timestamp().alias("_ingested_at")).select(*STATS.columns)
        return table.upsert(df, totals=[totals])

    return table, totals, put


def rows(rnd, n):
    for k in rnd.sample(range(200), n):
        season = rnd.choice([2030, 2031, None])
        yield (f"g{k // 10}", f"p{k % 10}", season, 2, f"P{k % 10}{rnd.choice(['', '', ' jr'])}", rnd.choice([None, rnd.randrange(-5, 300)]), None if k % 3 else 1, 0.5)


def anew(table):
    sums = (F.sum(c).alias(c) for c in ("yards", "sacks"))
    return sorted(map(repr, table.read().groupBy(*GROUPS).agg(F.count(F.lit(1)).alias("n_rows"), *sums).collect()))


def kept(totals):
    return sorted(map(repr, totals.read().collect()))


def test_totals_follow_every_load(lake):
    table, totals, put = lake
    rnd = random.Random(1)
    with pytest.raises(ValueError, match="no load"):
        totals.read()
    batches = [list(rows(rnd, n)) for n in (120, 60, 1, 80)]
    for day, batch in enumerate(batches):
        put(batch, day)
        assert kept(totals) == anew(table)
        if day == 2:
            totals.fold()
    put(batches[1], 1)  # older than what is there: changes nothing
    assert kept(totals) == anew(table)
    totals.fold()
    totals.fold()
    assert kept(totals) == anew(table)
    want = player_leaders(table.read(), 2030, "yards", n=3).collect()
    assert player_leaders(totals.read(), 2030, "yards", n=3).collect() == want


def test_a_load_reads_its_own_keys_only(lake):
    """With the other season's files gone, its totals are still there and the load goes on."""
    table, totals, put = lake
    put([("g1", "p1", 2030, 2, "P1", 10, 1, 0.0), ("g2", "p1", 2031, 2, "P1", 20, 1, 0.0), ("g3", "p2", 2030, 2, "P2", 5, None, 0.0)], 0)
    shutil.rmtree(Path(table.data) / "season=2031")
    put([("g1", "p1", 2030, 2, "P1", 11, 1, 0.0)], 1)
    assert {(r.season, r.player_id): r.yards for r in totals.read().collect()} == {(2030, "p1"): 11, (2031, "p1"): 20, (2030, "p2"): 5}
    assert {(r.season, r.player_id): r.sacks for r in totals.read().collect()} == {(2030, "p1"): 1, (2031, "p1"): 1, (2030, "p2"): None}


@pytest.mark.parametrize("lost_after", ["differences", "rows"])
def test_a_lost_load_that_comes_again_counts_once(lake, monkeypatch, lost_after):
    table, totals, put = lake
    first, second = ([(f"g{k}", "p1", 2030, 2, "P1", k + n, 1, 0.0) for k in range(5)] for n in (0, 100))
    put(first, 0)
    with monkeypatch.context() as broken:
        def stop(*_):
            raise RuntimeError("lost")
        broken.setattr(SnapshotTable, "_overwrite" if lost_after == "differences" else "_log", stop)
        with pytest.raises(RuntimeError):
            put(second, 1)
    put(second, 1)
    assert kept(totals) == anew(table) and table.version() == 2
    put([("g0", "p1", 2030, 2, "P1", 7, 1, 0.0)], 2)
    assert kept(totals) == anew(table)


def test_fractions_are_refused(lake, spark, tmp_path):
    table, _, put = lake
    put([("g1", "p1", 2030, 2, "P1", 10, 1, 0.0)], 0)
    rates = RunningTotals(spark, str(tmp_path / "rates"), ["season"], ["rate"])
    with pytest.raises(ValueError, match="rate cannot"):
        table.upsert(table.read().withColumn("_snapshot_at", F.col("_snapshot_at") + F.expr("INTERVAL 1 DAY")), totals=[rates])
