"""Named tables for SQL: current rows as views, their description, loads and profile."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, NumericType, StringType, StructType

from snaplake.session import prepare
from snaplake.sources.files import Folder
from snaplake.sources.target import SnapshotTable
from snaplake.spec import Table
from snaplake.tables import RESETTABLE

NAME_PATTERN = r"[A-Za-z_][A-Za-z0-9_]*"  # fixed value: what a table may be called


class Catalog:
    """``sources`` maps a name to a parquet path or to a ``SnapshotTable``.

    A view reads lazily, so columns and filters of a query reach the scan. Views live in a session of
    the catalog's own, so catalogs do not see each other's.
    """

    def __init__(self, spark: SparkSession, sources: dict[str, str | SnapshotTable]):
        if not sources:
            raise ValueError("a catalog needs a table")
        for name in sources:
            if not re.fullmatch(NAME_PATTERN, name):
                raise ValueError(f"{name!r} cannot name a table: a letter or _, then letters, digits and _")
        self.spark = prepare(spark.newSession())
        self._sources = dict(sources)
        self._shown: dict[str, int] = {}
        self._schemas: dict[str, tuple[tuple, StructType]] = {}
        self.refresh()

    @property
    def names(self) -> list[str]:
        return list(self._sources)

    def refresh(self) -> list[str]:
        """Point each view at what there is now; returns the names of the merged tables that moved.

        Parquet sources have no version: their files are listed anew, their schema is read again if the
        folder itself has changed.
        """
        return self._refresh(self._sources)

    def _refresh(self, names: Iterable[str]) -> list[str]:
        moved = []
        for name in names:
            source = self._sources[name]
            if not isinstance(source, SnapshotTable):
                stamp = Folder(self.spark, source).stamp()
                known = self._schemas.get(name)
                reader = self.spark.read.schema(known[1]) if known and known[0] == stamp else self.spark.read
                df = reader.parquet(source)
                df.createOrReplaceTempView(name)
                self._schemas[name] = (stamp, df.schema)
                self._shown[name] = 0
                continue
            version = source.version()
            if self._shown.get(name) != version:
                source.read(self.spark).createOrReplaceTempView(name)
                self._shown[name] = version
                moved.append(name)
        return moved

    def _source(self, name: str) -> str | SnapshotTable:
        if name not in self._sources:
            raise ValueError(f"no table {name!r} here, only {', '.join(self._sources)}")
        return self._sources[name]

    def table(self, name: str) -> DataFrame:
        self._source(name)
        return self.spark.table(name)

    def _path(self, name: str) -> str:
        source = self._source(name)
        return source.path if isinstance(source, SnapshotTable) else source

    def list_tables(self) -> DataFrame:
        rows = [(name, self._path(name)) for name in self._sources]
        return self.spark.createDataFrame(rows, "table STRING, path STRING")

    def describe_table(self, name: str) -> dict:
        source = self._source(name)
        self._refresh([name])
        df = self.table(name)
        held = source if isinstance(source, SnapshotTable) else None
        return {
            "table": name,
            "path": self._path(name),
            "version": self._shown[name],
            "description": held.note if held else None,
            "partition_columns": list(held.partitions) if held else [],
            "num_files": len(df._jdf.inputFiles()),  # counted where Spark's listing is; no name comes here
            "columns": [
                {"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable}
                for f in (held.schema if held else df.schema)
            ],
        }

    def table_history(self, name: str, limit: int = 10) -> DataFrame:
        source = self._source(name)
        if not isinstance(source, SnapshotTable):
            raise ValueError(f"table {name!r} keeps no history")
        return source.loads(limit)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: counts, distinct estimate, extremes, moments and quartiles, in one scan.

    Maps have no order: their row has counts only.
    """

    def summary(name: str, kind: DataType) -> Column:
        c = F.col(f"`{name}`")
        numeric, ordered = isinstance(kind, NumericType), not isinstance(kind, MapType)
        number = c.cast("double") if numeric else F.lit(None).cast("double")
        nothing = F.lit(None)
        quartiles = F.approx_percentile(number, [0.25, 0.5, 0.75])
        return F.struct(
            F.lit(name).alias("column_name"),
            F.lit(kind.simpleString()).alias("column_type"),
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(c.isNull()).alias("null_count"),
            (F.approx_count_distinct(c) if ordered else nothing.cast("bigint")).alias("approx_unique"),
            (F.min(c) if ordered else nothing).cast(StringType()).alias("min"),
            (F.max(c) if ordered else nothing).cast(StringType()).alias("max"),
            F.avg(number).alias("avg"),
            F.stddev_samp(number).alias("std"),
            F.get(quartiles, F.lit(0)).alias("q25"),
            F.get(quartiles, F.lit(1)).alias("q50"),
            F.get(quartiles, F.lit(2)).alias("q75"),
        )

    one_row = df.agg(F.array(*(summary(f.name, f.dataType) for f in df.schema)).alias("columns"))
    return one_row.select(F.inline("columns"))


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def table_ddl(table: Table, location: str | None = None, provider: str = "PARQUET") -> str:
    """CREATE TABLE with comments, and NOT NULL on the key columns."""
    lines = []
    for f in table.schema:
        parts = [f.name, f.dataType.simpleString().upper()]
        if not f.nullable:
            parts.append("NOT NULL")
        if "comment" in f.metadata:
            parts.append(f"COMMENT {_quoted(f.metadata['comment'])}")
        lines.append("  " + " ".join(parts))
    clauses = [
        f"CREATE TABLE IF NOT EXISTS {table.full_name} (",
        ",\n".join(lines),
        f") USING {provider}",
    ]
    if table.note:
        clauses.append(f"COMMENT {_quoted(table.note)}")
    if location:
        clauses.append(f"LOCATION {_quoted(location)}")
    return "\n".join(clauses)


def ensure_table(
    spark: SparkSession, table: Table, location: str | None = None, provider: str = "PARQUET"
) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {table.database}")
    spark.sql(table_ddl(table, location, provider))


def reset_tables(
    spark: SparkSession, tables: dict[str, Table], paths: dict[str, list[str]], confirm: str
) -> list[str]:
    """Drop resettable tables with their data and checkpoints; does nothing unless confirmed.

    ``paths`` gives the folders of each table. A missing folder is no error.
    """
    if confirm != "RESET":
        return []
    dropped = [name for name in tables if name in RESETTABLE]
    for name in dropped:
        spark.sql(f"DROP TABLE IF EXISTS {tables[name].full_name}")
        for path in paths.get(name, ()):
            Folder(spark, path).delete()
    return dropped
