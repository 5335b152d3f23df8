"""Vector code compression: part-wise codebooks fitted by delta-maintained Lloyd rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import drop, save, small

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components become floor(SCALE * x). Integers beyond +-LARGEST are held at it: squared distances of parts of up to
#: 2,048 components then are whole numbers below 2^63, of up to 2 they are below 2^53; see `_nearest`.
SCALE, LARGEST = 256.0, 1 << 24
#: Components that a task holds as numbers at once.
HELD = 1 << 20
_STATE = "vec_id long, label string, x binary, code binary"


def _quantised(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """Integers (vector, part, position) of a column of kept vectors, zeros beyond their width up to equal parts."""
    each = -(-width // parts)
    out = np.zeros((len(column), each * parts), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        out[:, :width] = np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).reshape(len(column), width)
    return out.reshape(len(column), parts, each)


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, ties to the lower, and its squared distance: both exact.

    Floats hold the products exactly while they stay below 2^53, which embeddings do; larger ones take integers.
    """
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * x.shape[2] * top * top < 1 << 53 else np.int64
    codes, far = np.empty(x.shape[:2], np.uint8), np.empty(x.shape[:2], np.int64)
    for p in range(x.shape[1]):
        own, entries = x[:, p].astype(kind), book[p].astype(kind)
        d = (own * own).sum(axis=1)[:, None] - 2 * (own @ entries.T) + (entries * entries).sum(axis=1)[None, :]
        codes[:, p] = d.argmin(axis=1)
        far[:, p] = d[np.arange(len(d)), codes[:, p]]
    return codes, far


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their vectors have about `HELD` components together."""
    rows = max(1, HELD // width)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _blobs(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _first_codes(width: int, parts: int, shared):
    """Assigns rows of the table for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, width):
            x = _quantised(batch.column(2), width, parts)
            codes, _ = _nearest(x, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _blobs(x.astype(np.int32)), _blobs(codes)], names=["vec_id", "label", "x", "code"])

    return run


def _parts_of(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32).reshape(batch.num_rows, parts, -1).astype(np.int64)


def _codes_of(batch: pa.RecordBatch, name: str, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(batch.num_rows, parts)


def _next_codes(width: int, parts: int, shared):
    """Assigns rows of the state anew; the assignment of the round before stays beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, width):
            codes, _ = _nearest(_parts_of(batch, parts), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "x")), _blobs(codes), batch.column("code")], names=["vec_id", "label", "x", "code", "before"])

    return run


def _contributions(parts: int, entries: int, each: int):
    """What a task's changed parts add to their new entries and take from their old ones: a row for each of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((parts * entries, each), np.int64), np.zeros(parts * entries, np.int64)
        for batch in _slices(batches, parts * each):
            x, now = _parts_of(batch, parts), _codes_of(batch, "code", parts).astype(np.int64)
            place = np.arange(parts) * entries
            first = batch.schema.get_field_index("before") < 0
            moved = np.ones(now.shape, bool) if first else _codes_of(batch, "before", parts) != now
            signs = [(now, 1)] if first else [(now, 1), (_codes_of(batch, "before", parts).astype(np.int64), -1)]
            for codes, sign in signs:
                at = (codes + place)[moved]
                np.add.at(sums, at, sign * x[moved])
                np.add.at(n, at, sign)
        held = np.flatnonzero((n != 0) | (sums != 0).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, each)), pa.array(np.tile(np.arange(each), len(held))), pa.array(sums[held].ravel()), pa.array(np.repeat(n[held], each))], names=["entry", "position", "total", "n"])

    return run


def _added(state: DataFrame, parts: int, entries: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Plus and minus contributions of a round, summed over all tasks: at most parts x entries x positions numbers."""
    columns = [c for c in ("x", "code", "before") if c in state.columns]
    changed = state.where("code <> before") if "before" in columns else state
    found = changed.select(*columns).mapInArrow(_contributions(parts, entries, each), "entry long, position long, total long, n long")
    sums, n = np.zeros((parts * entries, each), np.int64), np.zeros(parts * entries, np.int64)
    for r in found.groupBy("entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        sums[r["entry"], r["position"]], n[r["entry"]] = r["total"], r["n"]
    return sums, n


def _results(width: int, parts: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, width):
            codes, far = _nearest(_parts_of(batch, parts), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(far.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all kept vectors (vec_id, label as text, code, error) and the final codebooks (part, entry, position).

    Components become integers floor(256 * x). Codebooks start as the parts of the vectors with the smallest ids. The
    assignment of every part is kept in a table between rounds, the sums and counts of every entry beside it; a round
    reads only vectors of which a part has changed its entry, and shuffles only what those parts add to one entry and
    take from another, added up in each task first (at most parts x entries rows of a task). An entry becomes
    floor(sum / count); one without parts stays. After the rounds the parts are assigned once more.

    Dropped are null vectors and those with null or non-finite components, empty ones, and ones whose length isn't the
    most frequent of the kept ones (ties: the longer), as they can't be compared. If the parts don't divide that length,
    zeros follow it. Rows that share an id each count, in order of their components; a null id comes after all others.
    Integers beyond 2^24 are held at it. With fewer vectors than entries codebooks are shorter; an empty table gives no
    rows and empty codebooks. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    context = vectors.sparkSession.sparkContext
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    kept = rows.where("v is not null and not exists(v, c -> c is null or isnan(c) or abs(c) = double('Infinity'))").where("size(v) > 0")
    most = kept.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = most["width"] if most else parts
    kept = kept.where(F.size("v") == width)
    each = -(-width // parts)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()  # as many rows as a codebook has entries
    values = pa.array([r["v"] for r in first], pa.list_(pa.float64()))
    book = _quantised(values, width, parts).transpose(1, 0, 2) if first else np.zeros((parts, 0, each), np.int64)
    if not first:
        return save(kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), "codes"), book
    state = save(kept.mapInArrow(_first_codes(width, parts, context.broadcast(book)), _STATE), "assigned")
    sums, n = np.zeros((parts * entries, each), np.int64), np.zeros(parts * entries, np.int64)
    for r in range(rounds):
        if r:
            after = save(state.select("vec_id", "label", "x", "code").mapInArrow(_next_codes(width, parts, context.broadcast(book)), f"{_STATE}, before binary"), "assigned")
            drop(state)
            state = after
        more, count = _added(state, parts, entries, each)
        sums, n = sums + more, n + count
        found = (sums // np.maximum(n, 1)[:, None]).reshape(parts, entries, each)[:, : book.shape[1]]
        book = np.where((n > 0).reshape(parts, entries, 1)[:, : book.shape[1]], found, book)
    codes = save(state.select("vec_id", "label", "x").mapInArrow(_results(width, parts, context.broadcast(book)), "vec_id long, label string, code string, error long"), "codes")
    drop(state)
    return codes, book


def label_errors(codes: DataFrame) -> DataFrame:
    """`codes` with label_error: the error summed over rows of an equal label, null labels together (a sum beyond a long
    is held at the largest long). Errors are added up before they are shuffled; a label may hold any share of the rows."""
    largest = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = save(codes.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), largest).cast("long").alias("label_error")), "label-errors")
    return codes.join(small(sums, sums.count()), codes["label"].eqNullSafe(sums["of"])).select(*codes.columns, "label_error")
