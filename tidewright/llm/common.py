"""Helpers shared by the corpus operators: tables, scratch tables, checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.scratch import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark whatever file system it is on."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in, the rest a character map."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Shuffle files of a query go when it ends. Without it they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def save(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors. What was shuffled for
    it is deleted with the write's end."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return out


def drop(*saved: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in saved:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def free(name: str, *taken: str) -> str:
    """`name`, or with underscores after it until no column of `taken` is called so, whatever its case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def named(name: str) -> Column:
    """The column of this very name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows up to which a two- or three-column table of numbers is broadcast (at most about 50 MB); beyond it the same
#: join is shuffled.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if rows <= most else df
