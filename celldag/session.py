"""Session settings that the library's queries assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", **conf) -> SparkSession:
    """UTC, adaptive execution; further settings by keyword with _ for the dots' place given as a mapping in `conf`."""
    builder = SparkSession.builder.master(master).appName("celldag")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"} | conf.get("settings", {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate files that all executors share (`spark.checkpoint.dir`); only on one machine, where it is unset, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="shared-")
    return shared


#: Whether shuffle files go when a query ends (Spark 4.1).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: for what several parts of a plan read.  What was shuffled for it goes at once."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
