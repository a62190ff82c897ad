"""Names of the registered queries, their plans and their plain-SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, TimestampNTZType, TimestampType

from snaplake.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FILE_COLUMNS = ("_source_file", "_snapshot_at")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a plan; ``oracle`` is the same result as one SQL statement over the tables."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Instants, days and arrays as text, so that results compare across engines."""

    def text(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        if isinstance(field.dataType, DateType):
            return c.cast("string").alias(field.name)
        if isinstance(field.dataType, ArrayType):
            return F.concat_ws(",", c).alias(field.name)
        return c

    return df.select(*map(text, df.schema))
