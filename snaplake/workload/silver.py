"""The parsed tables, written once per session and read by the analytic queries.

As with any ingest, a table is parsed and de-duplicated once; queries then scan the columns and
partitions they need, and facts about games are laid out by game. It is written anew when the source files
have changed or it has been removed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from snaplake.operators.latest import dedupe_latest
from snaplake.session import work_dir
from snaplake.sources.bucketed import write_bucketed
from snaplake.sources.files import COMPACT, Folder, bloom_filters
from snaplake.tables import TABLES
from snaplake.workload.landing import game_tasks
from snaplake.workload.parsing import parsed

GAME_FACTS = ("games", "game_team_stats")  # joined by game
BY_GAME = (*GAME_FACTS, "player_game_stats")  # their records are dealt out by game

_WRITTEN: dict[tuple, tuple[str, str]] = {}  # where a table lies, and its name in the catalog, if it has one


def silver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = TABLES[name]
    place = (spark.sparkContext.applicationId, sf_dir, Folder(spark, sf_dir).stamp(), name)
    if place not in _WRITTEN or not Folder(spark, _WRITTEN[place][0]).names():
        path, listed = work_dir(spark, f"silver-{name}"), ""
        rows = dedupe_latest(parsed(spark, sf_dir, name), table)
        if name in GAME_FACTS:
            listed = f"{name}_{uuid.uuid4().hex}"
            buckets = game_tasks(spark, sf_dir)  # those the records are dealt into: rows are written where they are
            write_bucketed(rows, listed, path, "game_id", buckets, table.partitions)
        else:
            if name not in BY_GAME:
                rows = rows.hint("rebalance", *table.partitions)
            rows = rows.sortWithinPartitions(*table.partitions, *table.keys)
            rows.write.options(**bloom_filters(table.keys), **COMPACT).partitionBy(*table.partitions).parquet(path)
        _WRITTEN[place] = path, listed
    path, listed = _WRITTEN[place]
    if listed:
        return spark.table(listed).select(*table.columns)
    schema = StructType([StructField(f.name, f.dataType) for f in table.schema])
    return spark.read.schema(schema).parquet(path).select(*table.columns)
