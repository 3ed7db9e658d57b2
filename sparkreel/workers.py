"""Python workers must find this package, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Puts the package's folder on the workers' path. Executors elsewhere get the package as any other, with --py-files or installed."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def mapped(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow(run, schema), with this package at hand."""
    importable(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, which spark.checkpoint.dir names. Where it is unset, in local mode alone, a temporary folder is taken."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparkreel-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
