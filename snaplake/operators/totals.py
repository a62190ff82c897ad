"""Totals per group that follow a keyed table load by load, without reading the table again.

A load replaces rows: what it takes out counts against the totals and what it puts in counts for them, so a
load's differences come from its own keys only. They are written before the table is changed, in a folder
numbered like the load; a load that is lost half way and comes again finds its differences there and adds none twice.
Totals are the sums over all differences; ``fold`` sums up what there is, so that reading does not grow with the loads.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from snaplake.sources.files import Folder

SIGN = "_sign"  # 1 for a row that comes, -1 for one that goes
ROWS = "n_rows"


class RunningTotals:
    """Row counts and sums of ``stats`` by ``groups``, kept at ``path``.

    Sums are exact, so only whole numbers and decimals can be kept. A sum over NULLs alone is NULL, and a
    group without rows is gone, as if the totals were computed anew.
    """

    def __init__(self, spark: SparkSession, path: str, groups: Sequence[str], stats: Sequence[str]):
        self.spark = spark
        self.path = path.rstrip("/")
        self.groups, self.stats = list(groups), list(stats)

    def _numbers(self) -> list[str]:
        return [ROWS, *(f"{kind}_{c}" for c in self.stats for kind in ("sum", "n"))]

    def _load(self, number: int) -> str:
        return f"load={number:08d}"

    def _done(self, folder: str) -> bool:
        return Folder(self.spark, f"{self.path}/{folder}").holds("_SUCCESS")

    def pending(self, number: int) -> bool:
        """Whether the differences of a load that is not finished have been written."""
        return self._done(self._load(number))

    def record(self, signed: DataFrame, number: int) -> None:
        """Keep the differences of load ``number``; if they are there, it is this load that comes again."""
        for c in self.stats:
            if not isinstance(signed.schema[c].dataType, (IntegralType, DecimalType)):
                raise ValueError(f"{c} cannot be kept as a running total: only whole numbers and decimals add up exactly")
        if self.pending(number):
            return
        sign = F.col(SIGN)
        sums = [F.sum(sign).alias(ROWS)]
        for c in self.stats:
            sums += [F.sum(F.col(c) * sign).alias(f"sum_{c}"), F.sum(F.when(F.col(c).isNotNull(), sign).otherwise(0)).alias(f"n_{c}")]
        differences = signed.groupBy(*self.groups).agg(*sums)
        nothing = reduce(lambda a, b: a & b, (F.coalesce(F.col(n), F.lit(0)) == 0 for n in self._numbers()))
        differences.where(~nothing).write.mode("overwrite").parquet(f"{self.path}/{self._load(number)}")

    def _parts(self) -> tuple[list[str], int]:
        """The folders that add up to the totals now, and the last load among them."""
        names = Folder(self.spark, self.path).names()
        number = lambda name: int(name.rpartition("=")[2])
        folded = max((n for n in names if n.startswith("upto=") and self._done(n)), key=number, default=None)
        since = number(folded) if folded else 0
        loads = [n for n in names if n.startswith("load=") and number(n) > since and self._done(n)]
        return ([folded] if folded else []) + loads, max([since, *map(number, loads)])

    def _sums(self) -> DataFrame | None:
        parts, _ = self._parts()
        if not parts:
            return None
        rows = self.spark.read.parquet(*(f"{self.path}/{p}" for p in parts))
        return rows.groupBy(*self.groups).agg(*(F.sum(n).alias(n) for n in self._numbers()))

    def read(self) -> DataFrame:
        """Groups, ``n_rows``, and each statistic's total under its own name."""
        sums = self._sums()
        if sums is None:
            raise ValueError(f"no load has been recorded at {self.path}")
        totals = (F.when(F.col(f"n_{c}") > 0, F.coalesce(f"sum_{c}", F.lit(0))).alias(c) for c in self.stats)
        return sums.where(F.col(ROWS) > 0).select(*self.groups, ROWS, *totals)

    def fold(self) -> None:
        """Write down the sums of all finished loads; later readings start from them."""
        parts, number = self._parts()
        if len(parts) > 1:
            self._sums().where(F.col(ROWS) != 0).write.mode("overwrite").parquet(f"{self.path}/upto={number:08d}")
