"""Session settings and what Python workers need to find this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HOME = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine, as tests and benchmarks use it."""
    settings = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return find_package(spark)


def find_package(spark: SparkSession) -> SparkSession:
    """Put this package's folder on the workers' path (a cluster gets it by --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([HOME, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
