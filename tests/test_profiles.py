"""Merged profiles against exact figures and against the profile of the whole table."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from snaplake.plans.profiles import ProfileStore
from snaplake.sources.catalog import profile


@pytest.fixture(scope="module")
def stats(spark):
    return spark.range(40000).select(
        (2020 + F.col("id") % 5).alias("season"), F.when(F.col("id") % 7 > 0, F.xxhash64("id") % 9000).alias("yards"),
        (F.randn(3) * 50 + F.col("id") % 5 * 100).alias("rate"), F.concat(F.lit("p"), F.col("id") % 1234).alias("player"),
        F.to_date(F.from_unixtime(F.col("id") * 4000)).alias("day"), F.when(F.col("id") < 0, 1.5).alias("never"),
        F.array(F.lit("x")).alias("tags"), F.create_map(F.lit("k"), F.col("id")).alias("extra"), (F.col("id") % 2 == 0).alias("even"),
    ).cache()


@pytest.fixture(scope="module")
def store(spark, stats, tmp_path_factory):
    store = ProfileStore(spark, str(tmp_path_factory.mktemp("p") / "profiles"), stats.schema, ["season"])
    with pytest.raises(ValueError, match="nothing"):
        store.profile()
    for seasons in ((2020, 2021), (2022, 2023), (2024,)):
        store.refresh(stats.where(F.col("season").isin(*seasons)))
    return store


def test_merged_equals_whole(stats, store):
    whole, merged = ({r.column_name: r for r in p.collect()} for p in (profile(stats), store.profile()))
    assert list(whole) == list(merged) == stats.columns
    for name, want in whole.items():
        got = merged[name]
        assert got[:4] == want[:4] and (got.min, got.max) == (want.min, want.max)
        assert (got.avg, got["std"]) == (pytest.approx(want.avg), pytest.approx(want["std"]))
        assert (got.approx_unique is None) is (want.approx_unique is None)
        assert [got[q] is None for q in ("q25", "q50", "q75")] == [want[q] is None for q in ("q25", "q50", "q75")]


def test_estimates_keep_their_stated_error(stats, store):
    merged = {r.column_name: r for r in store.profile().collect()}
    for name in ("season", "yards", "rate", "player", "day", "even", "tags"):
        exact = stats.select(name).where(F.col(name).isNotNull()).distinct().count()
        assert abs(merged[name].approx_unique - exact) <= 0.06 * exact  # three standard deviations
    for name in ("yards", "rate"):
        values = sorted(r[0] for r in stats.select(name).where(F.col(name).isNotNull()).collect())
        for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            rank = sum(v <= merged[name][q] for v in values) / len(values)
            assert abs(rank - p) <= 0.02


def test_a_changed_part_is_replaced_and_the_others_are_not_read(spark, stats, tmp_path):
    path = str(tmp_path / "stats")
    stats.drop("extra").write.partitionBy("season").parquet(path)
    table = spark.read.parquet(path)
    store = ProfileStore(spark, str(tmp_path / "profiles"), table.schema, ["season"])
    store.refresh(table)
    shutil.rmtree(Path(path) / "season=2021")
    more = table.where("season = 2020").withColumn("yards", F.lit(5).cast("long"))
    store.refresh(more)
    got = {r.column_name: r for r in store.profile().collect()}
    assert got["season"].row_count == 40000 and (got["season"].min, got["season"].max) == ("2020", "2024")
    assert got["yards"].null_count == stats.where("season <> 2020 AND yards IS NULL").count()
