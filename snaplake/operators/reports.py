"""Load reports: splitting good from failed requests, dataset status, per-season totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUCCESS, PARTIAL, FAILED = "success", "partial", "failed"


def split_results(results: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good, failed): a failed request never stops the batch."""
    return results.filter(F.col(error).isNull()), results.filter(F.col(error).isNotNull())


def _status(failed: Column, all_failed: Column) -> Column:
    return F.when(all_failed, FAILED).when(failed > 0, PARTIAL).otherwise(SUCCESS)


def dataset_report(
    results: DataFrame, dataset: str = "dataset", error: str = "error", size: str = "bytes"
) -> DataFrame:
    """Per dataset: requests, failures, landed count and bytes, and its status."""
    failed = F.col(error).isNotNull()
    totals = results.groupBy(F.col(dataset).alias("dataset")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(failed).alias("failures"),
        F.count_if(~failed).alias("landed"),
        F.coalesce(F.sum(F.when(~failed, F.col(size))), F.lit(0)).alias("bytes"),
    )
    all_failed = F.col("failures") == F.col("requests")
    return totals.withColumn("status", _status(F.col("failures"), all_failed))


def overall_status(datasets: DataFrame) -> DataFrame:
    """One row: failed if every dataset failed, partial if any did not fully succeed."""
    totals = datasets.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.sum("requests").alias("requests"),
        F.sum("failures").alias("failures"),
        F.sum("bytes").alias("bytes"),
        F.every(F.col("status") == FAILED).alias("none_good"),
        F.count_if(F.col("status") != SUCCESS).alias("imperfect"),
    )
    status = _status(F.col("imperfect"), F.coalesce(F.col("none_good"), F.lit(False)))
    return totals.select("datasets", "requests", "failures", "bytes", status.alias("status"))


def season_report(
    results: DataFrame, season: str = "season", dataset: str = "dataset", error: str = "error"
) -> DataFrame:
    """Backfill totals per season; a dataset that brought nothing counts 0 and is no failure."""
    good = F.col(error).isNull()

    def landed(name: str) -> Column:
        return F.coalesce(F.sum(F.when(good & (F.col(dataset) == name), F.col("items"))), F.lit(0))

    return results.groupBy(F.col(season).alias("season")).agg(
        landed("schedules").alias("games"),
        landed("game_summaries").alias("summaries"),
        landed("standings").alias("standings_entries"),
        F.coalesce(F.sum(F.when(good, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.count_if(~good).alias("failures"),
    )
