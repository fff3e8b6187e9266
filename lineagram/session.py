"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lineagram") -> SparkSession:
    """A session with the settings that the operators count on: UTC and adaptive plans."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the cluster's shared folder; a folder of its own only on one machine, and where none is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lineagram-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
