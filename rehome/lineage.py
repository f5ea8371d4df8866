"""Cutting lineage where work must not run twice."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the session's checkpoint folder and read back from there.

    The folder is one that driver and executors share; without it a cluster would read what other
    machines have written to their own disks, so a session that names none is an error. Set
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` and Spark removes the rows when they are out of use.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
