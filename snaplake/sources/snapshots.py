"""Landing files: reading them with declared schemas, setting aside what cannot be read, and writing them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.functions.scalars import landing_day
from snaplake.sources.files import Folder
from snaplake.spec import Table

RECORDS_PER_FILE = 100  # fixed value: summaries a landing file holds at most

# A landing file is one JSON document, an array or an object, in a day folder under its prefix.
READ_OPTIONS = {"multiLine": "true", "recursiveFileLookup": "true"}


UNREADABLE = "_unreadable"  # the text of a record, or of a whole multi-line file, that is not what was declared


def with_file_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_source_file"),
        F.col("_metadata.file_modification_time").alias("_snapshot_at"),
    )


def _reading(reader, table: Table, unreadable: bool, options: dict[str, str]):
    """A reader, of a batch or a stream, that keeps the text of unreadable records in a column if asked to."""
    if unreadable:
        options = {"columnNameOfCorruptRecord": UNREADABLE, **options}
    raw = f"{table.raw}, {UNREADABLE} STRING" if unreadable else table.raw
    return reader.schema(raw).options(**{**READ_OPTIONS, **options})


def read_snapshots(spark: SparkSession, table: Table, root: str, unreadable: bool = False, **options: str) -> DataFrame:
    """All landing records of a table under ``root``; its prefix is appended."""
    reader = _reading(spark.read, table, unreadable, options)
    return with_file_columns(reader.json(f"{root.rstrip('/')}/{table.prefix}"))


def stream_snapshots(
    spark: SparkSession,
    table: Table,
    root: str,
    files_per_batch: int | None = None,
    bytes_per_batch: int | None = None,
    archive: str | None = None,
    unreadable: bool = False,
    **options: str,
) -> DataFrame:
    """The same scan as a stream that hands out every file once.

    A micro-batch takes so many files, or, if ``bytes_per_batch`` is given, files of so many bytes (one file at
    least). Files of finished batches move to ``archive``, which must not lie in the landing folder.
    """
    reader = _reading(spark.readStream, table, unreadable, options)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    elif files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return with_file_columns(reader.json(f"{root.rstrip('/')}/{table.prefix}"))


def split_records(table: Table, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, aside) of records read with ``unreadable``: no bad record stops or vanishes from a load.

    Good is a record of which a declared field at least could be read; a field of the wrong kind is NULL in it.
    Aside come file, snapshot and text of all that was not read whole; ``partly`` says that it is among the good, too.
    """
    declared = [c for c in records.columns if c not in (UNREADABLE, "_source_file", "_snapshot_at")]
    bad = F.col(UNREADABLE).isNotNull()
    partly = reduce(or_, (F.col(f"`{c}`").isNotNull() for c in declared))
    # Spark refuses to read the bad texts alone: the second condition always holds and asks for the other columns
    told = records.filter(bad & (partly >= F.lit(False)))
    aside = told.select("_source_file", "_snapshot_at", F.col(UNREADABLE).alias("text"), partly.alias("partly"))
    return records.filter(~bad | partly).drop(UNREADABLE), aside


def write_aside(aside: DataFrame, path: str) -> None:
    """Keep unreadable records by file: a file that comes again replaces what was kept of it."""
    keyed = aside.withColumn("file", F.sha1("_source_file"))
    writer = keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("file").json(path)


def read_aside(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_aside`` has kept; nothing if it never had to."""
    kinds = "_source_file STRING, _snapshot_at TIMESTAMP, text STRING, partly BOOLEAN"
    if not Folder(spark, path).names():
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).json(path)


def write_landing(
    df: DataFrame, path: str, moment: str | None = None, records_per_file: int | None = None
) -> None:
    """Append records as JSON, in day folders of the instant column ``moment`` if one is named."""
    if moment:
        # Rows of a day meet in few tasks, a large day in several: files follow bytes, not tasks x days.
        df = df.withColumn("landing_date", landing_day(moment)).hint("rebalance", F.col("landing_date"))
    writer = df.write.mode("append")
    if moment:
        writer = writer.partitionBy("landing_date")
    if records_per_file:
        writer = writer.option("maxRecordsPerFile", records_per_file)
    writer.json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)
