"""A keyed parquet table that takes upserts, as partition folders that Spark finds and overwrites.

A place is a value of the table's partition columns and a bucket of its keys: ``data/<partition>=<value>/
_bucket=<n>/*.parquet``, rows sorted by key. An upsert joins the batch's keys with the held keys of its
buckets, finds which rows change anything and which places those rows are in or leave, and writes the places anew
with dynamic partition overwrite; a batch that changes nothing writes no file. All of that stays in Spark: no list of
keys or places comes to the driver. A key that moves to another season leaves its old place; a place that loses rows so
keeps a row without a key, which readers skip, as an overwrite cannot make a place empty.

A job lost before its commit changes nothing. One lost while Spark moves finished places in leaves some places new
and some old; the same batch, which a stream hands over again, puts that right, since every place that holds a row the
newest one has overtaken is written again. One writer per table at a time. A query that runs while a place it
reads is replaced may fail and can be repeated: read before, or write down, what must outlive an upsert.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, IntegralType, StructField, StructType

from snaplake.operators.latest import dedupe_latest
from snaplake.operators.merge import bucket_of, require_keys
from snaplake.operators.totals import SIGN, RunningTotals
from snaplake.sources.files import Folder, bloom_filters
from snaplake.spec import Table

BUCKET, PLACE = "_bucket", "_place"
DECLARATION = "_table.json"
ROWS_PER_FILE = 1_000_000

LOADS = "loaded_at TIMESTAMP, rows_inserted BIGINT, rows_updated BIGINT"


@dataclass(frozen=True)
class Load:
    """What an upsert did to the table."""

    rows_inserted: int = 0
    rows_updated: int = 0


class SnapshotTable:
    """``table`` may be left out to read what is there under whatever name.

    ``buckets`` counts per partition and is fixed with the first rows; without it, it follows the rows
    of the first batch. Later growth makes several files of a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, table: Table | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table
        self.path = path.rstrip("/")
        self.data = f"{self.path}/data"
        self._asked = buckets

    @staticmethod
    def stands_at(spark: SparkSession, path: str) -> bool:
        return Folder(spark, path).holds(DECLARATION)

    @cached_property
    def _declared(self) -> dict:
        return json.loads(Folder(self.spark, self.path).read(DECLARATION))

    def _declare(self, rows: int) -> None:
        table = self.table
        held = {
            "schema": table.schema.jsonValue(),
            "note": table.note,
            "keys": list(table.keys),
            "partitions": list(table.partitions),
            "buckets": self._asked or max(1, -(-rows // ROWS_PER_FILE)),
        }
        Folder(self.spark, self.path).create(DECLARATION, json.dumps(held))

    @property
    def schema(self) -> StructType:
        return self.table.schema if self.table else StructType.fromJson(self._declared["schema"])

    @property
    def note(self) -> str:
        return self.table.note if self.table else self._declared["note"]

    @property
    def partitions(self) -> tuple[str, ...]:
        return self.table.partitions if self.table else tuple(self._declared["partitions"])

    @property
    def keys(self) -> tuple[str, ...]:
        return self.table.keys if self.table else tuple(self._declared["keys"])

    def version(self) -> int:
        """How many upserts have changed the table."""
        return len(Folder(self.spark, f"{self.path}/_loads").names(".json"))

    def read(self, spark: SparkSession | None = None) -> DataFrame:
        return self.placed(spark).select(*self.schema.fieldNames())

    def placed(self, spark: SparkSession | None = None, hollow: bool = False) -> DataFrame:
        """All rows with their bucket and place (``_bucket``, ``_place``); ``hollow`` adds the rows without a key."""
        spark = spark or self.spark
        kinds = StructType([StructField(f.name, f.dataType) for f in self.schema] + [StructField(BUCKET, IntegerType())])
        found = Folder(spark, self.path).holds("data")
        rows = spark.read.schema(kinds).parquet(self.data) if found else spark.createDataFrame([], kinds)
        rows = rows.withColumn(PLACE, self._place(F.col(BUCKET)))
        return rows if hollow else rows.where(F.col(self.keys[0]).isNotNull())

    def with_bucket(self, rows: DataFrame) -> DataFrame:
        """Rows that have the keys, with the bucket they belong to."""
        return rows.withColumn(BUCKET, bucket_of(self.keys, self._declared["buckets"]))

    def _place(self, bucket: Column) -> Column:
        """A place as text: an expression of partition columns only, so that Spark can prune by it."""
        names = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in self.partitions)
        return F.concat_ws("/", *names, bucket.cast("string"))

    def upsert(self, batch: DataFrame, totals: Sequence[RunningTotals] = ()) -> Load:
        """Merge parsed rows: new keys are inserted, known ones give way to strictly newer snapshots.

        Fails if a key that came does not stand exactly once afterwards. The same batch again puts a table right.
        ``totals`` take the difference. They belong to a table from its first load on; a load that was lost half way
        must come again before another one, as it does from a stream.
        """
        table = self.table
        for name in table.partitions:
            if not isinstance(table.schema[name].dataType, (IntegralType, DateType)):
                raise ValueError(f"{name} cannot partition {table.full_name}: only whole numbers and days can")
        checked = require_keys(batch.select(*table.columns), table)
        fresh = dedupe_latest(checked, table).persist()
        try:
            if not self.stands_at(self.spark, self.path):
                self._declare(fresh.count())
            changed = self._changed(fresh).persist()
            try:
                new = F.col("_comes")
                found = changed.agg(
                    F.count(F.lit(1)).alias("places"),
                    F.count_if(new & F.col("_held").isNull()).alias("inserted"),
                    F.count_if(new & F.col("_held").isNotNull()).alias("updated"),
                ).first()
                load = Load(found.inserted, found.updated)
                number = self.version() + 1
                if found.places:
                    for kept in totals:
                        kept.record(self._differences(changed), number)
                    self._overwrite(changed)
                    self._check(fresh)
                if found.places or any(kept.pending(number) for kept in totals):
                    self._log(load)
                return load
            finally:
                changed.unpersist()
        finally:
            fresh.unpersist()

    def _changed(self, fresh: DataFrame) -> DataFrame:
        """Batch rows that matter, with ``_to``, the place they are for, and ``_gone``, the places their key leaves.

        ``_comes``: the row is new or strictly newer. A row that is neither matters only if its key stands more
        than once, after a job lost half way.
        """
        table = self.table
        keys, at = list(table.keys), F.col(table.snapshot_column)
        placed = self.with_bucket(fresh)
        placed = placed.withColumn("_to", self._place(F.col(BUCKET)))
        # the comparison says nothing; a join prunes partitions only by a side that has a filter
        asked = placed.where(F.col(BUCKET) >= 0).select(BUCKET, *keys)
        mine = self.placed().select(*keys, BUCKET, PLACE, at.alias("_held_at")).join(asked, [BUCKET, *keys], "left_semi")
        best = F.max(F.struct(F.col("_held_at").isNull(), "_held_at", PLACE))
        held = mine.groupBy(*keys).agg(best.alias("_held"), F.collect_set(PLACE).alias("_places"))
        joined = placed.join(held, keys, "left")
        comes = F.col("_held").isNull() | F.coalesce(at > F.col("_held._held_at"), F.lit(False))
        leaves = F.when(comes, F.col("_places")).otherwise(F.array_remove("_places", F.col("_held")[PLACE]))
        leaves = F.coalesce(leaves, F.array().cast("array<string>"))
        out = joined.select(*table.columns, BUCKET, "_to", "_held", comes.alias("_comes"), leaves.alias("_gone"))
        return out.where(F.col("_comes") | (F.size("_gone") > 0))

    def _differences(self, changed: DataFrame) -> DataFrame:
        """The rows that come (1) and those they replace (-1)."""
        columns, comes = self.table.columns, changed.where("_comes")
        leave = comes.select(*self.keys, F.col("_held")[PLACE].alias(PLACE)).where(F.col(PLACE) >= "")
        old = self.placed().join(leave, [*self.keys, PLACE], "left_semi")
        new = comes.select(*columns, F.lit(1).alias(SIGN))
        return new.unionByName(old.select(*columns, F.lit(-1).alias(SIGN)))

    def _overwrite(self, changed: DataFrame) -> None:
        """The touched places anew: what they held, less what leaves, and what comes."""
        table = self.table
        keys, place = list(table.keys), [*table.partitions, BUCKET]
        comes, to = F.col("_comes"), F.array("_to")
        touched = F.when(comes, F.array_union("_gone", to)).otherwise(F.col("_gone"))
        touched = changed.select(F.explode(touched).alias(PLACE)).distinct().where(F.col(PLACE) >= "")
        gone = changed.select(*keys, F.explode("_gone").alias(PLACE))
        stay = self.placed().join(touched, PLACE, "left_semi").join(gone, [*keys, PLACE], "left_anti")
        added = changed.where(comes).select(*table.columns, BUCKET)
        left = F.when(comes, F.array_except("_gone", to)).otherwise(F.col("_gone"))
        left = changed.select(F.explode(left).alias(PLACE)).distinct().where(F.col(PLACE) >= "")
        hollow = self.placed(hollow=True).join(left, PLACE, "left_semi").select(*place).distinct()
        rows = stay.select(*table.columns, BUCKET).unionByName(added).unionByName(hollow, allowMissingColumns=True)
        rows = rows.hint("rebalance", *place).sortWithinPartitions(*place, *keys)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
        writer.options(**bloom_filters(keys)).partitionBy(*place).parquet(self.data)

    def _check(self, fresh: DataFrame) -> None:
        """Every key of the batch stands once, in whatever place; only keys of its buckets are read."""
        keys = [BUCKET, *self.keys]
        came = self.with_bucket(fresh.select(*self.keys)).where(F.col(BUCKET) >= 0)
        stands = self.placed().select(*keys).join(came, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        rows, distinct = stands.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        given = fresh.count()
        if not rows == distinct == given:
            raise ValueError(f"{rows} rows but {distinct} distinct keys ({', '.join(self.keys)}) after a load of {given}")

    def _log(self, load: Load) -> None:
        row = self.spark.range(0, 1, 1, 1).select(
            F.current_timestamp().alias("loaded_at"),
            F.lit(load.rows_inserted).alias("rows_inserted"),
            F.lit(load.rows_updated).alias("rows_updated"),
        )
        row.write.mode("append").json(f"{self.path}/_loads")

    def loads(self, limit: int = 10) -> DataFrame:
        """The newest upserts that changed the table, with running numbers; ``limit`` is held between 1 and 100."""
        if not self.version():
            return self.spark.createDataFrame([], f"version BIGINT, {LOADS}, rows_total BIGINT")
        loads = self.spark.read.schema(LOADS).json(f"{self.path}/_loads")  # a row for each upsert
        loads = loads.selectExpr(
            "CAST(row_number() OVER (ORDER BY loaded_at) AS BIGINT) AS version", "*",
            "sum(rows_inserted) OVER (ORDER BY loaded_at) AS rows_total",
        )
        return loads.orderBy(F.col("version").desc()).limit(max(1, min(limit, 100)))
