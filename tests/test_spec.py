import re

import pytest

from snaplake.plans.parsers import PARSERS
from snaplake.session import work_dir
from snaplake.sources.catalog import table_ddl
from snaplake.tables import RESETTABLE, TABLES


@pytest.mark.parametrize("table", TABLES.values(), ids=TABLES)
def test_columns_are_unique_snake_case_and_keys_not_null(table):
    assert len(set(table.columns)) == len(table.columns)
    assert all(re.fullmatch(r"[a-z0-9_]+", c) for c in table.columns)
    assert table.keys and all(not table.schema[k].nullable for k in table.keys)
    assert [f.name for f in table.schema if not f.nullable] == list(table.keys)


def test_audit_columns():
    for name, table in TABLES.items():
        last = table.columns[-3:]
        if name == "injury_news":
            assert last == ["snapshot_at", "source_file", "ingested_at"]
        else:
            assert last == ["_source_file", "_snapshot_at", "_ingested_at"]


def test_registries_agree():
    assert list(PARSERS) == list(TABLES)
    assert len(RESETTABLE) == 8 and "injury_news" not in RESETTABLE
    assert TABLES["injury_news"].schema["player_id"].dataType.simpleString() == "bigint"


def test_ddl_text():
    ddl = table_ddl(TABLES["teams"], "/data/it's here")
    assert ddl.startswith("CREATE TABLE IF NOT EXISTS nfl.teams (")
    assert "team_id STRING NOT NULL COMMENT" in ddl and "USING PARQUET" in ddl
    assert "is_active BOOLEAN" in ddl and r"LOCATION '/data/it\'s here'" in ddl
    news = table_ddl(TABLES["injury_news"], provider="DELTA")
    assert "categories ARRAY<STRING>" in news and "USING DELTA" in news


def test_ddl_makes_a_table_with_comments(spark, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS nfl")
    spark.sql("DROP TABLE IF EXISTS nfl.schedules")
    spark.sql(table_ddl(TABLES["schedules"], str(tmp_path / "schedules")))
    described = {r["col_name"]: r["comment"] for r in spark.sql("DESCRIBE nfl.schedules").collect()}
    assert described["game_ts_utc"] == "kickoff, UTC"
    spark.sql("DROP TABLE nfl.schedules")


def test_intermediate_data_goes_to_the_shared_folder(spark, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    first, second = work_dir(spark, "x"), work_dir(spark, "x")
    assert first != second and spark.sparkContext.applicationId in first
    if shared:
        assert first.startswith(shared)


def test_without_a_shared_folder_only_local_mode_goes_on():
    class Fake:
        class sparkContext:  # noqa: N801
            applicationId = "app-1"

        def __init__(self, **conf):
            self._settings = conf
            self.conf = self

        def get(self, key, default=None):
            return self._settings.get(key, default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(Fake(**{"spark.master": "yarn"}), "x")
    local = [work_dir(Fake(**{"spark.master": "local[2]"}), "x") for _ in range(2)]
    assert local[0].rsplit("/", 1)[0] == local[1].rsplit("/", 1)[0]
    assert work_dir(Fake(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://n/c/"}), "y").startswith(
        "hdfs://n/c/snaplake/app-1/y-"
    )
