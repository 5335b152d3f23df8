"""Quality classifier: ordinal cumulative-link regression on graded ratings with hashed text features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import words
from tidewright.llm.common import save, small

BITS = 18
#: Rated documents that the model is fitted on at most (those with the smallest hash of their id), and how: shards
#: that fit on their own, rounds after which their weights are averaged, epochs in a round.
SAMPLE, SHARDS, ROUNDS, EPOCHS, RATE, LEAST_DF = 20_000, 8, 3, 4, 0.2, 4
GRADES = 3
#: ASCII bytes whose share of a text is a feature of its own: signs, digits and capitals each have a bucket.
_SIGNS = np.array([x for x in range(0x21, 0x80) if not 0x61 <= x <= 0x7A and not 0x41 <= x <= 0x5A])
_SIGN_BUCKETS = (np.arange(len(_SIGNS) + 1) * 2654435761 % (1 << BITS)).astype(np.int32)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each whole text of a column its buckets and their values.

    A word counts once however often it stands there; signs and capitals count by how many come to a word.
    """
    texts = column.cast(pa.binary()).to_pylist()
    for first, counts, h in words.blocks(column, words.SIGNS):
        buckets = (h >> np.uint64(64 - BITS)).astype(np.int32)
        end = 0
        for k, n in enumerate(counts.tolist()):
            own = np.unique(buckets[end : end + n])  # a wordless text has no word, but may have signs
            end += n
            data = np.frombuffer(texts[first + k] or b"", np.uint8)
            if not len(data):
                yield np.empty(0, np.int32), np.empty(0, np.float32)
                continue
            n_bytes = np.bincount(data, minlength=256)
            signs = np.append(n_bytes[_SIGNS], n_bytes[0x41:0x5B].sum())
            held = np.flatnonzero(signs > 0.3 * (n + 1))
            ids = np.concatenate([own, _SIGN_BUCKETS[held]])
            values = np.concatenate([np.ones(len(own), np.float32), (1 + np.log1p(signs[held] / (n + 1))).astype(np.float32)])
            ids, at = np.unique(ids, return_inverse=True)  # a word and a sign of one bucket are one feature
            yield ids, np.bincount(at, weights=values, minlength=len(ids)).astype(np.float32)


def _tail(score: float, cuts: np.ndarray) -> np.ndarray:
    """P(grade > k) for each threshold."""
    return 1 / (1 + np.exp(np.clip(cuts - score, -30, 30)))


def _fit_shard(rows: list[tuple[int, np.ndarray, np.ndarray]], w: np.ndarray, cuts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    w, cuts, seen = w.copy(), cuts.copy(), np.full(len(w), 1e-2, np.float32)
    seen_cuts = np.full(len(cuts), 1.0)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            grade, ids, x = rows[k]
            s = float(w[ids] @ x)
            # log-likelihood of P(grade) = F(cut[g] - s) - F(cut[g-1] - s), logistic F
            low = 1 / (1 + np.exp(np.clip(s - cuts[grade - 1], -30, 30))) if grade else 0.0
            high = 1 / (1 + np.exp(np.clip(s - cuts[grade], -30, 30))) if grade < len(cuts) else 1.0
            p = max(high - low, 1e-6)
            dl, dh = low * (1 - low) / p, high * (1 - high) / p
            g = (1 - high - low) * x  # of the loss by the weights
            seen[ids] += g * g
            w[ids] -= RATE * g / np.sqrt(seen[ids])
            step = np.zeros(len(cuts))
            if grade:
                step[grade - 1] -= dl
            if grade < len(cuts):
                step[grade] += dh
            seen_cuts += step * step
            cuts = np.sort(cuts + RATE * step / np.sqrt(seen_cuts))
    return w, cuts


def _shard_fitter(seed: int, start):
    def run(key, table):
        w0, cuts0 = start.value
        table = table.sort_by("doc_id")
        own = [(g, np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for g, i, x in zip(*(table.column(c).to_pylist() for c in ("grade", "ids", "x")), strict=True)]
        df = np.bincount(np.concatenate([i for _, i, _ in own]), minlength=1 << BITS)
        own = [(g, i[df[i] >= LEAST_DF], x[df[i] >= LEAST_DF]) for g, i, x in own]
        w, cuts = _fit_shard(own, w0, cuts0, seed)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(own)], pa.int64()), "w": pa.array([w.tobytes()], pa.binary()), "cuts": pa.array([cuts.tobytes()], pa.binary())})

    return run


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds. Shards of a bounded sample of rated documents fit side by side; their averages, weighted
    by rows, start the next round. Rows with a null or unknown grade teach nothing; with no rated row all weights are 0.
    Of documents that share an id one teaches, that of the smallest text. Shards are dealt by a hash of the id and sorted
    by it: the model depends on the rows alone, not on how they were read or shuffled.
    """
    spark = docs.sparkSession
    rated = ratings.select(F.col(id_col).cast("long").alias("doc_id"), F.col(grade_col).cast("int").alias("grade")).where(f"doc_id is not null and grade between 0 and {GRADES - 1}")
    rated = save(rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "rated")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(small(rated, SAMPLE), "doc_id")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.by_size(batch, 2):
                out = [(i, g, *(x.tobytes() for x in t)) for i, g, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), features(part.column(2)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "grade", "ids", "x"])

    rows = sample.select("doc_id", "grade", "text").mapInArrow(prepare, "doc_id long, grade int, ids binary, x binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("ids", "x", "grade")).alias("r")).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).alias("shard"), "r.*")
    rows = save(rows, "rated-features")
    w, cuts = np.zeros(1 << BITS, np.float32), np.linspace(-1.0, 1.0, GRADES - 1)
    for r in range(ROUNDS):
        start = spark.sparkContext.broadcast((w, cuts))

        fitted = rows.groupBy("shard").applyInArrow(_shard_fitter(r, start), "shard long, n long, w binary, cuts binary").collect()  # SHARDS rows of 1 MB
        fitted.sort(key=lambda f: f["shard"])
        n = sum(f["n"] for f in fitted)
        if not n:
            break
        w = sum(np.frombuffer(f["w"], np.float32) * (f["n"] / n) for f in fitted).astype(np.float32)
        cuts = np.sort(sum(np.frombuffer(f["cuts"], np.float64) * (f["n"] / n) for f in fitted))
    return w, cuts


def grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, expected_grade (0 to 2), p_above_0, tail (P(grade = 2)), keep (tail >= 0.5).

    The whole text counts. Null and empty texts, and texts of white space alone, have no evidence for them: expected
    grade 0, tail 0, not kept; a text of signs alone is graded by its signs. An empty table gives no rows; repeated rows repeat; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cuts = shared.value
        for batch in (part for batch in batches for part in words.by_size(batch, 1)):
            tails = []
            for ids, x in features(batch.column(1)):
                tails.append(_tail(float(w[ids] @ x), cuts) if len(ids) else np.zeros(len(cuts)))
            t = np.array(tails).reshape(len(tails), len(cuts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t.sum(axis=1)), pa.array(t[:, 0]), pa.array(t[:, -1]), pa.array(t[:, -1] >= 0.5)], names=["doc_id", "expected_grade", "p_above_0", "tail", "keep"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, p_above_0 double, tail double, keep boolean")


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from 0/1 labels: toxic text is grade 0, poor text 1, good text 2; null toxic counts as not toxic."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
