"""Cutting lineage where a result feeds several steps, in the folder that the cluster names."""

from __future__ import annotations

import contextlib
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local master, as in tests, may
    go without the setting; it gets a temporary folder."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tarn-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """The session setting has the value inside the block and its old one, or none, after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that a lost executor never forces the work above it to be redone. The
    shuffle files of the work above are dropped when it is there."""
    shared_dir(df.sparkSession)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.select("*").checkpoint(eager=True)  # a plan of its own: the setting holds for plans made under it
