"""Snapshot ingest as a stream: every file once, parsed map-only, merged batch by batch.

A restarted stream may hand over a batch a second time. That changes nothing: an equal snapshot never
replaces a row. Records that cannot be read are set aside with their file and text, in the folder
``_unreadable`` of the table they were for, and the rest of the batch goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snaplake.operators.merge import assert_unique
from snaplake.plans.parsers import parse
from snaplake.sources.snapshots import UNREADABLE, read_aside, read_snapshots, split_records, stream_snapshots, write_aside
from snaplake.sources.target import Load, SnapshotTable

FILES_PER_BATCH = 1000


def aside_path(target: SnapshotTable) -> str:
    return f"{target.path}/_unreadable"


def unreadable(target: SnapshotTable) -> DataFrame:
    """The records of all loads that could not be read, or not whole: file, snapshot, text, partly."""
    return read_aside(target.spark, aside_path(target))


def load_records(target: SnapshotTable, records: DataFrame) -> Load:
    """Parse and merge the records that can be read; keep the others.

    Bad ones are counted while the good ones are merged; only if there are any are the files read for them.
    """
    seen = Observation("unreadable")
    watched = records.observe(seen, F.count_if(F.col(UNREADABLE).isNotNull()).alias("bad"))
    good, _ = split_records(target.table, watched)
    load = target.upsert(parse(target.table, good))
    if seen.get["bad"]:
        _, aside = split_records(target.table, records)
        write_aside(aside, aside_path(target))
    return load


def upsert_batches(target: SnapshotTable) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function; a batch that comes again finds nothing to change."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        load_records(target, batch)

    return apply


def check_keys(target: SnapshotTable) -> None:
    """Every key of the whole table stands once; a load has already checked its own keys. Reads the key columns."""
    assert_unique(target.read().select(*target.table.keys), target.table.keys)


def ingest_batch(spark: SparkSession, target: SnapshotTable, landing: str, **options: str) -> Load:
    """Merge all landing files there are, without a checkpoint: a backfill or a repair."""
    return load_records(target, read_snapshots(spark, target.table, landing, unreadable=True, **options))


def ingest_available(
    spark: SparkSession,
    target: SnapshotTable,
    landing: str,
    checkpoint: str,
    files_per_batch: int | None = FILES_PER_BATCH,
    bytes_per_batch: int | None = None,
    archive: str | None = None,
    **options: str,
) -> StreamingQuery:
    """Merge all files that have arrived under ``landing`` since the last call, then stop.

    ``checkpoint`` belongs to this table alone. ``files_per_batch`` bounds a micro-batch (None: all files
    that have arrived are one), ``bytes_per_batch`` does so by bytes instead, for files of unequal size. Files of
    finished batches move to ``archive`` if one is named, the last batch's with the next call; ``options`` go to
    the JSON reader.
    """
    records = stream_snapshots(
        spark, target.table, landing, files_per_batch, bytes_per_batch, archive, unreadable=True, **options
    )
    query = (
        records.writeStream.foreachBatch(upsert_batches(target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
