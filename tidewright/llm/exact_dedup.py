"""Exact dedup by content sort: sampled splitters, external sort, neighbouring full comparisons."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import lower_ascii, save

#: Characters of a text in a sampled splitter.
SPLITTER = 32
_RUNS = "doc_id long, run_id long, heads_run boolean, repeats_id boolean, text_sha256 string"


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk one sorted range; a row whose whole text equals its neighbour's joins the neighbour's run.

    Only the previous text is held, so a run may be as long as the partition.
    """
    run, last_text, last_id = TaskContext.get().partitionId() << 40, None, None
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        runs, heads, repeats, shas = [], [], [], []
        for i, text in zip(ids, texts, strict=True):
            head = text != last_text
            run += head
            runs.append(run)
            heads.append(head)
            repeats.append(not head and i == last_id)
            shas.append(hashlib.sha256(text).hexdigest() if head else None)
            last_text, last_id = text, i
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(runs, pa.int64()), pa.array(heads, pa.bool_()), pa.array(repeats, pa.bool_()), pa.array(shas, pa.string())],
            names=["doc_id", "run_id", "heads_run", "repeats_id", "text_sha256"],
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num_partitions: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after lower-casing A-Z; null counts as empty. The row with the largest
    doc_id of each group stays. Ties: of rows with the same text and the same doc_id one is kept. A null doc_id sorts
    below every other; a group of null ids only keeps one row and has a null keep_id. An empty table gives no rows.
    Other columns are ignored, whatever their names.

    Spark samples splitters over (beginning, hash, doc_id) of the texts, so one text held by a third of the rows still spreads over many
    ranges; each range is sorted externally and compared neighbour by neighbour. Runs of a text that was split over
    ranges meet again by the digest of that text, one small row per run.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    # splitters go through the driver, so their keys are short: the text's beginning, a hash of all of it, the id
    short = [F.substring("norm", 1, SPLITTER), F.xxhash64("norm")]
    last = F.col("doc_id").desc_nulls_last()
    dealt = rows.repartitionByRange(num_partitions, *short, last) if num_partitions else rows.repartitionByRange(*short, last)
    marked = save(dealt.sortWithinPartitions(*short, "norm", last).mapInArrow(_mark_runs, _RUNS), "exact-runs")
    runs = marked.groupBy("run_id").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"), F.max("text_sha256").alias("text_sha256"))
    texts = runs.groupBy("text_sha256").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.min(F.when(F.col("top").isNull(), F.col("run_id"))).alias("null_run"))
    keyed = runs.select("run_id", "text_sha256").join(texts, "text_sha256")
    first = F.when(F.col("keep_id").isNull(), F.col("heads_run") & (F.col("run_id") == F.col("null_run"))).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("repeats_id"))
    return (
        marked.drop("text_sha256")
        .join(keyed, "run_id")
        .select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), first.alias("kept"), "text_sha256")
    )
