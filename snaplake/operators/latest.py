"""One row per key: newest snapshot, first occurrence, top n.

All of them shrink the data on the map side before anything is shuffled, so a key holding a
large share of the rows reaches its reducer as a handful of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from snaplake.spec import Table

# Up to the n in this setting Spark cuts each group to n rows before the shuffle by itself.
GROUP_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"
SALTS = 64


def _extreme_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], pick: Callable[[Column], Column]
) -> DataFrame:
    """The row of each key whose ``order`` columns, then all its others, are extreme.

    The order leads a struct of the whole row, so one aggregate finds the row and brings it along,
    ties are broken by content, and the keys stay grouping columns: a filter on them moves below.
    Maps have no order; they travel as their sorted entries.
    """
    others = [c for c in df.columns if c not in keys and c not in order]
    maps = {f.name for f in df.schema if isinstance(f.dataType, MapType)}

    def packed(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.sort_array(F.map_entries(c)).alias(name) if name in maps else c

    def unpacked(name: str) -> Column:
        c = F.col("_row")[name]
        return (F.map_from_entries(c) if name in maps else c).alias(name)

    row = F.struct(*map(packed, (*order, *others)))
    found = df.groupBy(*keys).agg(pick(row).alias("_row"))
    return found.select(*(F.col(c) if c in keys else unpacked(c) for c in df.columns))


def latest_rows(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The row of each key that is greatest in ``order``; a NULL is below everything."""
    return _extreme_row(df, keys, order, F.max)


def dedupe_latest(df: DataFrame, table: Table) -> DataFrame:
    """Newest snapshot per key; of equal snapshots the later file."""
    return latest_rows(df, table.keys, table.snapshot_column, table.file_column)


def first_rows(df: DataFrame, keys: Sequence[str], *position: str) -> DataFrame:
    """The row of each key that comes first in arrival order; NULL and blank keys are dropped."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return _extreme_row(df, keys, position, F.min)


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """First n rows of each group, numbered in ``rank``; ``order`` should be a total order.

    For an n too large for Spark's own group limit, a salted pass cuts the groups first.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if n > int(df.sparkSession.conf.get(GROUP_LIMIT_SETTING)):
        salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(SALTS))
        salted = df.withColumn("_salt", salt)
        within = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
        df = salted.withColumn("_n", within).filter(F.col("_n") <= n).drop("_n", "_salt")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", number).filter(F.col("rank") <= n)


def at_latest_snapshot(df: DataFrame, owner: str, snapshot: str) -> DataFrame:
    """Rows of each owner's newest snapshot, e.g. the current roster of every team.

    An aggregate and a join rather than a window: the maxima are combined before the shuffle and
    are one row per owner, so a large owner is spread by the join instead of filling one task.
    """
    newest = df.groupBy(F.col(owner).alias("_owner")).agg(F.max(snapshot).alias("_newest"))
    match = (F.col(owner) == F.col("_owner")) & (F.col(snapshot) == F.col("_newest"))
    return df.join(newest, match).select(df["*"])


def preview_latest(df: DataFrame, order: str, rows: int = 20) -> DataFrame:
    """The newest rows; of equally new ones those with the lesser content hash (maps left out of it)."""
    content = (F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, MapType))
    return df.orderBy(F.col(order).desc(), F.xxhash64(*content)).limit(rows)
