"""The folder that driver and executors share, and tables that cut lineage there."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Directory that holds the package, for Python workers.
ROOT = str(Path(__file__).resolve().parents[1])


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and Spark runs on this machine alone, a temporary folder of it is taken; on a
    cluster the setting must be there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), f"sitelens-checkpoints-{os.getuid()}")
        os.makedirs(base, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sitelens-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, paths) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
