"""Structured Streaming forms: recompute of touched keys, trailing failures, duplicate-free ingestion."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.sources.scratch import shared_folder


def recompute_touched(changes: DataFrame, key: str, recompute: Callable[[DataFrame], None], checkpoint: str):
    """Run `recompute` on the distinct keys of every micro-batch until the source is used up. Late and corrected
    facts evaluate their keys anew; nothing is dropped by a watermark."""
    return (
        changes.writeStream.foreachBatch(lambda batch, _: recompute(batch.select(key).distinct()))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def failures_per_window(events: DataFrame, key: str, ts: str, failed, width: str = "15 minutes", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Failures of each key in sliding windows, with a watermark that bounds the state."""
    return events.withWatermark(ts, late).where(failed).groupBy(F.window(ts, width, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n_failed"))


def ingest_once(events: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Each key set once; the state lasts as long as late rows may come."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def recompute_to_table(spark, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream of the files at `path` that ends with its input; the latest result of every key, from a table in the
    shared folder of `spark.checkpoint.dir`."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    def write(batch: DataFrame, n: int) -> None:
        compute(batch.select(key).distinct()).withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/b={n}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/out/b=*")
    rest = [c for c in out.columns if c not in (key, "_batch")]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("_x")).select(key, "_x.*")
