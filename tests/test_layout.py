"""What the layout of tables spares: row groups without the key, and shuffles of facts that are joined by game."""

import random

import pytest
from pyspark.sql import functions as F

from snaplake.plans import analytics as A
from snaplake.sources.bucketed import attach_bucketed, write_bucketed
from snaplake.sources.files import bloom_filters
from snaplake.sources.target import SnapshotTable
from snaplake.spec import COUNT, TEXT, Table, col, key


def scan_of(df):
    """(rows read, rows found) of one execution."""
    qe = df._jdf.queryExecution()
    found = len(qe.executedPlan().executeCollect())
    leaves = qe.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())), found


@pytest.fixture(scope="module")
def ids(spark):
    """Half of the ids are given, the other half lie between them."""
    hashed = spark.range(20000).select(F.md5(F.col("id").cast("string")).alias("game_id"), "id")
    return hashed.where("id % 2 = 0"), hashed.where("id % 2 = 1")


@pytest.mark.parametrize("filters", [True, False])
def test_an_absent_key_reads_no_row_group(spark, ids, tmp_path, filters):
    given, others = ids
    path = str(tmp_path / "t")
    given.repartition(4).write.options(**(bloom_filters(["game_id"]) if filters else {})).parquet(path)
    table = spark.read.parquet(path)
    absent = [r.game_id for r in others.limit(8).collect()]
    present = given.first().game_id
    read = [scan_of(A.game_box_score(table, game)) for game in absent]
    assert all(found == 0 for _, found in read)
    assert (sum(n for n, _ in read) == 0) is filters
    if filters:
        assert scan_of(A.game_box_score(table, present)) == (2500, 1)  # the one file that holds it


def test_upserted_tables_have_filters_on_their_keys(spark, ids, tmp_path):
    table = Table(name="t", prefix="t", raw="", fields=(key("game_id", TEXT), col("id", COUNT)))
    target = SnapshotTable(spark, str(tmp_path / "t"), table, buckets=4)
    audit = (F.lit(1).cast("timestamp").alias("_snapshot_at"), F.lit("f").alias("_source_file"), F.current_timestamp().alias("_ingested_at"))
    target.upsert(ids[0].select("*", *audit).select(*table.columns))
    absent = [r.game_id for r in ids[1].limit(8).collect()]
    assert [scan_of(target.read().where(F.col("game_id") == game)) for game in absent] == [(0, 0)] * 8


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    rnd = random.Random(6)
    games = [(f"g{k}", 2024 + k % 2, 2) for k in range(400)]
    box = [(f"g{k}", f"t{t}", f"T{t}", rnd.choice([None, rnd.randrange(9)])) for k in range(420) for t in rnd.sample(range(6), 2)]
    plain = (
        spark.createDataFrame(games, "game_id STRING, season LONG, season_type LONG"),
        spark.createDataFrame(box, "game_id STRING, team_id STRING, team_abbreviation STRING, sacks LONG"),
    )
    root = tmp_path_factory.mktemp("facts")
    laid = (
        write_bucketed(plain[0], "laid_games", f"{root}/games", "game_id", 4, ["season"]),
        write_bucketed(plain[1], "laid_box", f"{root}/box", "game_id", 4),
    )
    yield plain, laid, root
    for name in ("laid_games", "laid_box"):
        spark.sql(f"DROP TABLE {name}")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_by_game_are_joined_without_an_exchange(spark, facts, no_broadcast):
    plain, laid, _ = facts
    for (games, box), exchanges in ((plain, 2), (laid, 0)):
        plan = plan_of(A._with_season(box, games, 2024, 2))
        assert "SortMergeJoin" in plan and plan.count("Exchange") == exchanges
    plan = plan_of(A.team_leaders(laid[1], laid[0], 2024, "sacks", n=3))
    assert "Exchange" not in plan[plan.index("SortMergeJoin"):]
    assert "Exchange" not in plan_of(A.team_allowed(laid[1], laid[0], 2024, "t1", "sacks")).split("keys=[game_id")[-1]


def test_results_do_not_depend_on_the_layout(facts):
    plain, laid, _ = facts
    for ask in (
        lambda g, b: A.team_leaders(b, g, 2024, "sacks", n=6),
        lambda g, b: A.team_total(b, g, 2025, "t2", "sacks"),
        lambda g, b: A.team_allowed(b, g, 2024, "t1", "sacks"),
    ):
        assert ask(*laid).collect() == ask(*plain).collect()


def test_another_session_finds_the_buckets(spark, facts, no_broadcast):
    plain, laid, root = facts
    games = attach_bucketed(spark, "again_games", f"{root}/games", laid[0].schema, "game_id", 4, ["season"])
    box = attach_bucketed(spark, "again_box", f"{root}/box", laid[1].schema, "game_id", 4)
    joined = A._with_season(box, games, 2024, 2)
    assert "Exchange" not in plan_of(joined) and joined.count() == A._with_season(plain[1], plain[0], 2024, 2).count()
    for name in ("again_games", "again_box"):
        spark.sql(f"DROP TABLE {name}")
