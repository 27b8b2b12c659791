"""Session with the settings the engine counts on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def reach_workers(spark: SparkSession) -> None:
    """Put this checkout on the path of local Python workers; a cluster ships the package with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def build_session(name: str = "lemmaweave", master: str | None = None, **conf: str) -> SparkSession:
    """UTC timestamps, adaptive execution, Arrow.  Cluster settings that are already given stay."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the folder all executors share; only one machine may go without one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file:///tmp/checkpoints/lemmaweave")
    return df.checkpoint()
