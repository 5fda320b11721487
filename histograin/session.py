"""Sessions, lineage cuts, and the path that Python workers import this package from."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build(name: str = "histograin", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the results rely on: UTC, ANSI, adaptive plans."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}
    return builder.config(map=settings).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers that start from now on import this package, wherever the driver found it."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset on a single machine (tests)."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir")
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"histograin-{os.getuid()}")
        os.makedirs(at, exist_ok=True)
        at = f"file://{at}"
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
