"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. A local folder is made only where one machine runs everything (tests): on a
    cluster each executor would write to a disk of its own, and reads would miss rows without an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder: its lineage is cut, and lost executors lose nothing of it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Tasks for each core that rows are dealt to where each takes long.
_EACH_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """The rows of `df` dealt evenly to tasks, whatever their number. A file that is read in one piece (one group of rows)
    is one task's work otherwise, however long a row takes, and small shuffles are joined to few tasks."""
    return df.repartition(_EACH_CORE * df.sparkSession.sparkContext.defaultParallelism)
