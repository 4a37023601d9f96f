"""Freezing of results that depend on how rows were dealt to tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder, else the session's
    ``spark.checkpoint.dir``; only a local master gets a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="stratafield-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir().rstrip("/")


def frozen(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that all executors share, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
