"""Tables laid out by a join key: facts with the same key and bucket count are joined where they lie.

Rows of a bucket are written by one task, sorted by the key, so a join or an aggregate by it needs neither a
shuffle nor, with one file a bucket, a sort. The number of buckets is the number of tasks of such a join: choose it
for the largest fact, and the same for all that are joined with it. A key with very many rows stays in one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from snaplake.sources.files import COMPACT, bloom_filters


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int, partitions: Sequence[str] = ()) -> DataFrame:
    """Write the rows as table ``name`` at ``path``, and return the table.

    Rows that already lie by the key in so many partitions are written where they are; Spark then drops the shuffle.
    """
    writer = df.repartition(buckets, key).write.format("parquet").options(**bloom_filters([key]), **COMPACT)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def attach_bucketed(
    spark: SparkSession, name: str, path: str, schema: StructType, key: str, buckets: int, partitions: Sequence[str] = ()
) -> DataFrame:
    """The table that another session has written at ``path``: key and bucket count must be those it was written with."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parts = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {parts} "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    if partitions:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)
