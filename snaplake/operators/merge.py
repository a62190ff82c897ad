"""Newest snapshot wins: merging a batch of rows into rows already held.

The rule for one key: a new key is inserted; a known key takes the batch row only if its snapshot
is strictly newer. A NULL snapshot is never newer, and never replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.operators.latest import dedupe_latest
from snaplake.spec import Table

KEPT, INSERTED, UPDATED = "kept", "inserted", "updated"


def require_keys(df: DataFrame, table: Table) -> DataFrame:
    """The same rows; the job fails at the first NULL key."""

    def checked(name: str) -> Column:
        complaint = F.raise_error(F.lit(f"null key {name} in {table.full_name}"))
        return F.coalesce(F.col(name), complaint.cast(df.schema[name].dataType)).alias(name)

    return df.select(*(checked(c) if c in table.keys else F.col(c) for c in df.columns))


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.lit(buckets)).cast("int")


def merge_rows(
    held: DataFrame, fresh: DataFrame, table: Table, place: Sequence[str] = ()
) -> DataFrame:
    """Both sides, each unique by key, as one row per key plus ``_change``.

    The row that stays is the greatest by (held with a NULL snapshot, snapshot, held): exactly the
    rule above. ``place`` names columns that follow from the key and say where a row is stored; the
    rows are then shuffled by them alone, which serves the grouping and a write partitioned by them.
    """

    def side(df: DataFrame, is_held: bool) -> DataFrame:
        pinned = F.col(table.snapshot_column).isNull() if is_held else F.lit(False)
        return df.select(
            *place, *table.columns, pinned.alias("_pinned"), F.lit(is_held).alias("_held")
        )

    both = side(held, True).unionByName(side(fresh, False))
    if place:
        both = both.repartition(*place)
    order = ["_pinned", table.snapshot_column, "_held"]
    others = [c for c in table.columns if c not in table.keys and c not in order]
    merged = both.groupBy(*place, *table.keys).agg(
        F.max(F.struct(*order, *others)).alias("_row"), F.max("_held").alias("_was_held")
    )
    change = F.when(~F.col("_was_held"), INSERTED).when(F.col("_row._held"), KEPT).otherwise(UPDATED)
    columns = (F.col(c) if c in table.keys else F.col("_row")[c].alias(c) for c in table.columns)
    return merged.select(*place, *columns, change.alias("_change"))


def merge_latest(held: DataFrame, batch: DataFrame, table: Table) -> DataFrame:
    """The table after merging ``batch``, which may hold several versions of a key."""
    fresh = dedupe_latest(require_keys(batch.select(*table.columns), table), table)
    return merge_rows(held, fresh, table).drop("_change")


def merge_statement(table: Table, source: str) -> str:
    """The same rule as a MERGE, for catalogs whose tables support it."""
    on = " AND ".join(f"t.{k} = s.{k}" for k in table.keys)
    newer = f"s.{table.snapshot_column} > t.{table.snapshot_column}"
    return (
        f"MERGE INTO {table.full_name} AS t USING {source} AS s ON {on}\n"
        f"WHEN MATCHED AND {newer} THEN UPDATE SET *\n"
        f"WHEN NOT MATCHED THEN INSERT *"
    )


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count and distinct-key count; a row with a NULL in its key counts as a row only."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(*(F.col(k) for k in keys)).alias("key_count")
    )


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    counts = key_counts(df, keys).first()
    if counts["row_count"] != counts["key_count"]:
        raise ValueError(
            f"{counts['row_count']} rows but {counts['key_count']} distinct keys ({', '.join(keys)})"
        )
