"""Settings of the session, and intermediate tables in the folder all executors share: lineage ends there."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from snaplake.session import work_dir


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows below ``spark.checkpoint.dir`` and read them back."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Texts travel to Python workers in batches of so many rows and bytes at most: buffers on both sides follow them.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, if it is not installed for them."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark
