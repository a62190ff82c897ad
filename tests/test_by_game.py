"""Rows of games are shuffled once, as source rows: neither their newest version nor their layout moves them again."""

import re

import pytest
from pyspark.sql import functions as F

from snaplake.operators.latest import dedupe_latest
from snaplake.tables import TABLES
from snaplake.workload import landing
from snaplake.workload import silver as silver_module
from snaplake.workload.parsing import current, parsed
from snaplake.workload.silver import BY_GAME, silver


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Orders and lines with a key that stands twice, a line that comes twice, and lines without a game."""
    root = tmp_path_factory.mktemp("source")
    orders = spark.range(60).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "'F' AS o_orderstatus", "id * 10.0D AS o_totalprice",
        "timestamp'1998-05-01' + make_dt_interval(id % 9) AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    lines = spark.range(400).selectExpr(
        "IF(id % 50 = 3, NULL, id % 60) AS l_orderkey", "id % 11 AS l_partkey", "id % 5 AS l_suppkey", "int(1 + id % 7) AS l_linenumber",
        "double(1 + id % 50) AS l_quantity", "1.0D AS l_extendedprice", "0.05D AS l_discount", "0.02D AS l_tax",
        "IF(id % 3 = 0, 'R', 'N') AS l_returnflag", "'O' AS l_linestatus", "timestamp'1998-05-01' + make_dt_interval(id % 400) AS l_shipdate",
    )
    orders.write.parquet(f"{root}/orders.parquet")
    lines.unionByName(lines.where("l_orderkey = 7")).write.parquet(f"{root}/lineitem.parquet")
    return str(root)


def exchanges(df):
    return re.findall(r"Exchange .*", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", BY_GAME[1:])
def test_the_newest_rows_of_a_game_come_without_another_shuffle(spark, source, name):
    names = [f.name for f in TABLES[name].fields]
    (dealt,) = exchanges(current(spark, source, name, *names))
    assert "hashpartitioning(game_id" in dealt


@pytest.mark.parametrize("name", BY_GAME)
def test_tables_of_games_are_written_where_their_records_are(spark, source, name, monkeypatch):
    written = []
    newest = silver_module.dedupe_latest
    monkeypatch.setattr(silver_module, "dedupe_latest", lambda rows, table: written.append(newest(rows, table)) or written[0])
    silver(spark, source, name)
    (rows,) = written
    if name in silver_module.GAME_FACTS:
        rows = rows.repartition(landing.game_tasks(spark, source), "game_id")
    assert len(exchanges(rows)) == 1


@pytest.mark.parametrize("name", BY_GAME)
def test_dealing_by_game_changes_no_row(spark, source, name):
    """Against rows that lie anyhow, with NULL games and lines that come twice."""
    table = TABLES[name]
    kept = [c for c in table.columns if c != table.ingested_column]
    plain = dedupe_latest(parsed(spark, source, name).select(*table.columns).repartition(3, F.rand(1)), table).select(*kept)
    got = silver(spark, source, name).select(*kept)
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty() and got.count() == got.select(*table.keys).distinct().count() > 0


def test_the_tasks_follow_the_bytes_of_the_source(spark, source, monkeypatch):
    size = landing.Folder(spark, f"{source}/lineitem.parquet").size()
    assert size > 0 and landing.game_tasks(spark, source) == spark.sparkContext.defaultParallelism
    assert landing.game_tasks(spark, source, size // 9) == 10


def test_written_games_and_box_scores_lie_in_as_many_places(spark, source):
    """So they are joined where they lie; what is found agrees with a join of the parsed rows."""
    box, games = (silver(spark, source, n) for n in ("game_team_stats", "games"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not exchanges(box.join(games.where("season = 1998").select("game_id"), "game_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = current(spark, source, "game_team_stats", "turnovers").join(current(spark, source, "games", "season").where("season = 1998"), "game_id")
    want = plain.agg(F.sum("turnovers"), F.count(F.lit(1))).first()
    assert box.join(games.where("season = 1998").select("game_id"), "game_id").agg(F.sum("turnovers"), F.count(F.lit(1))).first() == want and want[1] > 0
