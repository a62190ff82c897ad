"""Session settings, and the one place that decides where intermediate data may be written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from snaplake.sources.files import Folder

# The news feed writes instants without a zone, so the session zone is part of the semantics.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}

TUNING = {
    # The wide parsers generate large methods. The JVM never compiles one above 8000 bytes of
    # bytecode; with this limit Spark splits such a stage instead, which is several times faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Split a hot join key also where that costs the shuffle of a later aggregate.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.runSQLOnFiles": "false",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "snaplake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **TUNING, **REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results and the wide parsers depend on, also on a session someone else built."""
    for key, value in {**TUNING, **REQUIRED}.items():
        spark.conf.set(key, value)
    return spark


_LOCAL_BASE: dict[str, str] = {}


def _work_root(spark: SparkSession) -> str:
    """This application's folder for intermediate data, on storage every executor can reach.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Without it only local mode
    may go on, on a folder of its own machine; anywhere else that would lose data, so it raises.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _LOCAL_BASE.setdefault(app, "") or tempfile.mkdtemp(prefix="snaplake-")
        _LOCAL_BASE[app] = base
    return f"{base.rstrip('/')}/snaplake/{app}"


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for intermediate data."""
    return f"{_work_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as they are now, in a table that later changes of their sources do not reach."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_work(spark: SparkSession) -> None:
    """Delete this application's intermediate data; whatever was read from it is gone, too."""
    Folder(spark, _work_root(spark)).delete()
