"""Benchmark decontamination: latent semantic retrieval, then longest common subsequence and answer checks.

1. Whole documents become numbers of benchmark words (other words keep their places, as -1), once for all items.
2. Frequencies of these words over all passages of 32 words.
3. For each block of items one distributed pass sketches A'A of the TF-IDF passage matrix A with a random test matrix; the Nystrom form of the
   randomised SVD gives the leading right singular vectors.
4. Windows of every document and the items are compared by cosine in that space; candidates are verified word by word.
   An item's rarest words that together weigh more than may be missing are its pivots; a stretch that passes the checks
   holds one of them, so windows whose stretch holds no pivot of any item of their length are not compared.
5. What the cosine loses is found exactly: the surroundings of every pivot are checked too for the items that no
   candidate of the document holds whole. Without this step (exact=False) the search is measured alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import words
from tidewright.llm.common import drop, free, named, save, small

#: Words of a passage; latent dimensions and extra columns of the sketch; items that are searched at once.
PASSAGE, RANK, EXTRA, BLOCK = 32, 96, 16, 2_000
#: Items of fewer words are sought as exact phrases.
PHRASE = 3
#: (longest item, window, stride) by item length: an item fills most of some window.
SCALES = ((24, 24, 10), (56, 56, 20), (240, 112, 40), (1 << 30, 240, 80))
#: (longest item, words beside it) of the stretches that are checked exactly; longer items have at least LONGER.
SPANS, LONGER = ((24, 24), (56, 56)), 112
#: Words, a multiple of PASSAGE, windows and pairs of a place and an item that are handled at once: they bound a task's memory, not what it handles.
PIECE, WINDOWS, PAIRS = 1 << 15, 1024, 1 << 20
#: Runs of rows that are left to be added up one by one.
FEW = 8
#: Singular values below this share of the largest belong to the sketch's own noise.
NOISE = 0.02
#: Cosine of a candidate; share of the item's words in a common subsequence; share of its IDF weight and of its answer
#: (its last quarter) that must be found.
COSINE, COMMON, WEIGHT, ANSWER = 0.55, 0.7, 0.7, 0.5
#: Words of more than this share of the passages carry no latent features, but for each item's RAREST rarest.
FREQUENT, RAREST = 0.03, 3


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(words.SIGNS).split()


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = sorted({w for t in batch.column(0).cast(pa.binary()).to_pylist() for w in words_of(t)})
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["word"])


def _numbered(keys, kind):
    """Packed numbers of a text's words, places of their hashes in the sorted keys; -1 for words that no item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = keys.value
        for batch in batches:
            for part in words.by_size(batch, 2, 8 << 20):
                out = []
                for _, counts, h in words.blocks(part.column(2), words.SIGNS):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    ids = np.where(known[at] == h, at, -1).astype(kind)
                    data, ends = ids.tobytes(), (np.concatenate(([0], np.cumsum(counts))) * ids.itemsize).tolist()
                    out += [data[x:y] for x, y in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], names=["doc_id", "text_key", "ids"])
        words.release()

    return run


def _pieces(batch: pa.RecordBatch, kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbered words of a batch's texts and each text's length, PIECE words at most; a longer text is cut between passages."""
    size = np.dtype(kind).itemsize
    held, total = [], 0
    for d in batch.column(0).to_pylist():
        for x in (d[at : at + PIECE * size] for at in range(0, len(d), PIECE * size)):
            if total + len(x) > PIECE * size:
                yield np.frombuffer(b"".join(held), kind).astype(np.int64), np.array([len(h) // size for h in held])
                held, total = [], 0
            held.append(x)
            total += len(x)
    if held:
        yield np.frombuffer(b"".join(held), kind).astype(np.int64), np.array([len(h) // size for h in held])


def _entries(ids: np.ndarray, lengths: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, word and count of every non-zero entry of some texts' passages."""
    starts = np.cumsum(lengths) - lengths
    passages = -(-lengths // PASSAGE)
    of = np.repeat(np.cumsum(passages) - passages, lengths) + (np.arange(len(ids)) - np.repeat(starts, lengths)) // PASSAGE
    known = ids >= 0
    keys, n = np.unique(of[known] * v + ids[known], return_counts=True)
    return keys // v, keys % v, n


def _frequencies(kind, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(v, np.int64), 0
        for batch in batches:
            for ids, lengths in _pieces(batch, kind):
                df += np.bincount(_entries(ids, lengths, v)[1], minlength=v)
                total += int((-(-lengths // PASSAGE)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([df.tobytes()], pa.binary())], names=["n", "df"])

    return run


def _run_sums(table: np.ndarray, of: np.ndarray, starts: np.ndarray, sizes: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
    """Sums of the rows table[of] (times x) over runs of `of`, which may overlap: a step adds the k-th row of every run that
    has one, until FEW runs are left, which are added up one by one."""

    def rows(at):
        own = table.take(of[at], axis=0)
        return own if x is None else own * x[at, None]

    order = np.argsort(-sizes, kind="stable")
    sums = np.zeros((len(sizes), table.shape[1]), table.dtype)
    begin, size = starts[order], sizes[order]
    down, steps = -size, int(size[FEW]) if len(size) > FEW else 0
    for k in range(steps):
        n = np.searchsorted(down, -k)
        sums[:n] += rows(begin[:n] + k)
    for i in range(min(FEW, len(size))):
        sums[i] += rows(np.arange(begin[i] + steps, begin[i] + size[i])).sum(axis=0)
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _sketched(kind, shared):
    """Each task's share of A' (A Omega), rows of A being unit TF-IDF vectors of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, idf, used, omega = shared.value
        v, total = len(idf), np.zeros(omega.shape, np.float64)
        for batch in batches:
            for ids, lengths in _pieces(batch, kind):
                ids = local[ids]
                passage, word, n = _entries(ids, lengths, v)
                own = used[word]
                passage, word, n = passage[own], word[own], n[own]
                if not len(word):
                    continue
                x = (n * idf[word]).astype(np.float32)
                heads = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
                norm = np.sqrt(np.add.reduceat(x * x, heads))
                sizes = np.diff(np.append(heads, len(x)))
                x /= np.repeat(np.maximum(norm, 1e-9), sizes)
                y = _run_sums(omega, word, heads, sizes, x)
                order = np.argsort(word, kind="stable")
                w = word[order]
                at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                row = np.repeat(np.arange(len(heads)), sizes)[order]
                total[w[at]] += _run_sums(y, row, at, np.diff(np.append(at, len(w))), x[order])
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["z"])
        words.release()

    return run


def _total(rows: DataFrame, column: str, dtype, shape) -> np.ndarray:
    """Sum of the tasks' equal-sized arrays, added up in a tree of tasks first; the driver gets at most 16."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                x = np.frombuffer(x, dtype)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    parts = rows.select(column).repartition(16).mapInArrow(add, "x binary").collect()
    return sum((np.frombuffer(p["x"], dtype) for p in parts), np.zeros(int(np.prod(shape)), dtype)).reshape(shape)


def _least(item: list[int]) -> float:
    return COMMON if len(item) >= 12 else 0.9


def _verified(item: list[int], weight: np.ndarray, stretch: np.ndarray) -> float:
    """Share of the item in the common subsequence, or 0 if a check fails."""
    near = stretch[stretch >= 0]
    held = frozenset(near.tolist())
    own = list(dict.fromkeys(item))
    idf = weight[own]
    if sum(x for w, x in zip(own, idf, strict=True) if w in held) < WEIGHT * idf.sum():
        return 0.0
    answer = item[-max(2, len(item) // 4) :]
    if sum(w in held for w in answer) < ANSWER * len(answer):
        return 0.0
    share = words.common_subsequence(item, near.tolist()) / len(item)
    return share if share >= _least(item) else 0.0


def span(length: int) -> int:
    """Words of the longest stretch of a document in which an item of `length` words is looked for."""
    return next((beside for most, beside in SPANS if length <= most), max(LONGER, length)) + length + 8


def _pivots(items: list[list[int]], weight: np.ndarray, wanted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each word where its items start in a list, and that list: the items of which the word is a pivot."""
    pivots, of = [], []
    for i in range(len(items)) if wanted is None else wanted:
        own = sorted(set(items[i]), key=lambda w: (-weight[w], w))
        total = np.cumsum(weight[own])
        most = int(np.searchsorted(total, (1 - WEIGHT) * total[-1] + 1e-9, side="right")) + 1
        pivots += own[:most]
        of += [i] * len(own[:most])
    order = np.argsort(pivots, kind="stable")
    return np.searchsorted(np.array(pivots, np.int64)[order], np.arange(len(weight) + 1)), np.array(of, np.int64)[order]


def _pivots_verified(ids, lengths, pivots, items, weight, hits) -> None:
    """Adds to the documents' hits every item that they don't hold whole yet and that passes the checks in a stretch of
    span() words, which no candidate's stretch exceeds. Longer stretches, by a sixteenth of the item, are checked at fewer starts: none that passes is lost."""
    starts, of = pivots
    ends = np.cumsum(lengths)
    n = np.append(np.diff(starts), 0)  # -1 is the last
    all_at = np.flatnonzero(n[ids])
    mask = np.zeros(len(weight) + 1, bool)
    cuts = np.flatnonzero(np.diff(np.cumsum(n[ids[all_at]]) // PAIRS)) + 1
    for at in np.split(all_at, cuts):
        k = n[ids[at]]
        place = np.repeat(at, k)
        item = of[np.repeat(starts[ids[at]], k) + np.arange(len(place)) - np.repeat(np.cumsum(k) - k, k)]
        doc = np.searchsorted(ends, place, side="right")
        order = np.lexsort((place, doc, item))
        place, item, doc = place[order], item[order], doc[order]
        heads = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])))) if len(place) else []
        for i, d, own in zip(item[heads].tolist(), doc[heads].tolist(), np.split(place, heads[1:]), strict=True) if len(place) else ():
            x = items[i]
            reach, step, need = span(len(x)), max(1, len(x) // 16), int(np.ceil(_least(x) * len(x) - 1e-9))
            due = WEIGHT * weight[list(set(x))].sum() - 1e-9
            mask[x] = True
            for run in np.split(own, np.flatnonzero(np.diff(own) > 2 * reach) + 1) if len(own) > 1 else (own,):
                lo, hi = max(ends[d] - lengths[d], run[0] - reach + 1), min(ends[d], run[-1] + reach)
                q = lo + np.flatnonzero(mask[ids[lo : min(ends[d], hi + reach + step)]])
                if len(q) < need or weight[list(set(ids[q].tolist()))].sum() < due:  # what all stretches lack together, each lacks
                    continue
                q = q[: np.searchsorted(q, hi)]
                done = lo
                for s in q[np.searchsorted(q, q + reach) - np.arange(len(q)) >= need].tolist():
                    if s >= done and hits[d].get(i, 0) < 1:
                        done = s + step
                        if share := _verified(x, weight, ids[s : min(ends[d], s + reach + step)]):
                            hits[d][i] = max(hits[d].get(i, 0), share)
            mask[x] = False


def _phrases_found(ids, lengths, phrases: np.ndarray, of: list[list[int]], v: int, hits) -> None:
    """Adds items of one or two words, wherever they stand; phrases are sorted keys (first + 1) (v + 1) + second + 1."""
    if not len(phrases) or not len(ids):
        return
    ends = np.cumsum(lengths)
    first, second = ids + 1, np.append(ids[1:], -1) + 1
    second[ends[lengths > 0] - 1] = 0  # the last word of a document has none behind it
    for keys in (first * (v + 1), first * (v + 1) + second):
        at = np.minimum(np.searchsorted(phrases, keys), len(phrases) - 1)
        for place in np.flatnonzero((phrases[at] == keys) & (first > 0)).tolist():
            found = hits[int(np.searchsorted(ends, place, side="right"))]
            found.update(dict.fromkeys(of[at[place]], 1.0))


def _searched(kind, shared, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, weight, used, vectors, items, names = shared.value
        long = [i for i, x in enumerate(items) if len(x) >= PHRASE]
        pivots = _pivots(items, weight, long)
        v = len(weight)
        short: dict[int, list[int]] = {}
        for i, x in enumerate(items):
            if len(x) < PHRASE:
                short.setdefault((x[0] + 1) * (v + 1) + (x[1] + 1 if len(x) > 1 else 0), []).append(i)
        phrases, of = np.array(sorted(short), np.int64), [short[k] for k in sorted(short)]
        groups = []
        for k, (most, window, stride) in enumerate(SCALES):
            least = SCALES[k - 1][0] if k else 0
            own = [i for i in long if least < len(items[i]) <= most]
            if own:
                q = np.array([vectors[items[i]].sum(axis=0) for i in own])
                rare = np.append(np.diff(_pivots(items, weight, own)[0]) > 0, False)  # -1 is the last
                groups.append((min(window, max(len(items[i]) for i in own) * 2), stride, own, rare, (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).T.astype(np.float32)))
        used, vectors = np.append(used, False), vectors.astype(np.float32)
        for batch in batches:
            for part in words.by_size(batch, 2, 1 << 20):
                data = part.column(2).to_pylist()
                ids, lengths = local[np.frombuffer(b"".join(data), kind)], np.array([len(d) for d in data]) // np.dtype(kind).itemsize
                hits = _candidates_verified(ids, lengths, used, vectors, groups, items, weight)
                if exact:
                    _pivots_verified(ids, lengths, pivots, items, weight, hits)
                _phrases_found(ids, lengths, phrases, of, v, hits)
                found = [sorted({names[i] for i in h}) for h in hits]
                scores = [float(max(h.values(), default=0)) for h in hits]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(scores, pa.float64())], names=["doc_id", "text_key", "item_ids", "overlap"])
        words.release()

    return run


def _beside(length: int) -> int:
    """Words on either side of a window in which an item of `length` words is looked for, too."""
    return length // 2 + 4


def _candidates_verified(ids, lengths, used, vectors, groups, items, weight) -> list[dict[int, float]]:
    """For each of some documents, whose words follow one another in `ids`, the items found with their shares."""
    hits: list[dict[int, float]] = [{} for _ in lengths]
    ends = np.cumsum(lengths)
    at = np.flatnonzero(used[ids])  # places of words that carry features
    if not len(at):
        return hits
    features, before = ids[at], np.concatenate(([0], np.cumsum(used[ids])))
    for window, stride, own, rare, q in groups:
        pivots = np.concatenate(([0], np.cumsum(rare[ids])))
        if not pivots[-1]:
            continue
        n = np.maximum(1, -(-(lengths - window) // stride) + 1)
        doc = np.repeat(np.arange(len(lengths)), n)
        first = (ends - lengths)[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * stride
        last = np.minimum(first + window, ends[doc])
        most = _beside(max(len(items[i]) for i in own))
        some = pivots[np.minimum(last + most, ends[doc])] > pivots[np.maximum(first - most, (ends - lengths)[doc])]
        some &= before[last] - before[first] >= 2
        doc, first, last = doc[some], first[some], last[some]
        lo, hi = before[first], before[last]
        for k in range(0, len(doc), WINDOWS):
            x = _run_sums(vectors, features, lo[k : k + WINDOWS], (hi - lo)[k : k + WINDOWS])
            cosine = (x @ q) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            for r, c in zip(*(y.tolist() for y in np.nonzero(cosine >= COSINE)), strict=True):
                i, d = own[c], doc[k + r]
                if hits[d].get(i, 0) < 1:
                    reach = _beside(len(items[i]))
                    share = _verified(items[i], weight, ids[max(ends[d] - lengths[d], first[k + r] - reach) : min(ends[d], last[k + r] + reach)])
                    if share:
                        hits[d][i] = max(hits[d].get(i, 0), share)
    return hits


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", exact: bool = True) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (sorted, distinct), overlap (largest share found, 0 to 1).

    Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII letters. An item is found in a document where a window
    is a candidate by latent cosine and 70 % of the item's words (90 % of a short item's) stand there in the item's
    order, with 70 % of its IDF weight and half of its answer, the last quarter; or where this holds in any stretch of
    span() words, whatever the cosine; `exact=False` leaves that route out, for measuring the search alone. Items of one or two words are found where they stand as a phrase. Null, empty
    and wordless texts and items match nothing; repeated item texts are all named; repeated document rows repeat; an
    empty documents table gives no rows, an empty benchmark leaves all clean; other columns are ignored.

    The benchmark's distinct words are broadcast (8 bytes each), and its items in blocks of 2,000. Texts are read once
    and their numbers again for each block; words weigh the same in every block, so blocks don't change what is found.
    """
    spark = docs.sparkSession
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.xxhash64(named(text_col).cast("string")).alias("text_key"), named(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    vocabulary = [bytes(r["word"]) for r in items.select("text").mapInArrow(_vocabulary, "word binary").distinct().collect()]
    v = len(vocabulary)
    if not v:
        return rows.select("doc_id", F.lit(False).alias("contaminated"), F.array().cast("array<bigint>").alias("item_ids"), F.lit(0.0).alias("overlap"))
    hashes = words.hashed_words(b" ".join(vocabulary))[1]
    order = np.argsort(hashes)
    number = {vocabulary[k]: i for i, k in enumerate(order.tolist())}
    kind = np.int16 if v < 32_000 else np.int32
    numbered = save(rows.mapInArrow(_numbered(spark.sparkContext.broadcast(hashes[order]), kind), "doc_id long, text_key long, ids binary"), "numbered")
    counted = save(numbered.select("ids").mapInArrow(_frequencies(kind, v), "n long, df binary"), "passage-frequencies")
    df, n = _total(counted, "df", np.int64, (v,)), counted.agg(F.sum("n")).first()[0] or 0
    drop(counted)
    blocks = max(1, -(-items.count() // BLOCK))
    found = []
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text").collect()
        own = [(r["item"], ws) for r in own if (ws := [number[w] for w in words_of(r["text"].encode())])]
        if own:
            found.append(_search_block(numbered, own, df, n, kind, exact))
    if len(found) == 1:
        out = found[0]
    else:  # equal texts are found alike, so rows of one id and text have one result
        hits = found[0]
        for other in found[1:]:
            hits = hits.unionByName(other)
        hits = hits.where("size(item_ids) > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("overlap").alias("overlap"))
        out = numbered.select("doc_id", "text_key").join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
        out = out.select("doc_id", F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
    out = save(out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "overlap"), "contamination")
    drop(numbered)
    return out


def _search_block(numbered: DataFrame, items: list[tuple[int, list[int]]], df: np.ndarray, n: int, kind, exact: bool) -> DataFrame:
    """(doc_id, text_key, item_ids, overlap) of all documents for a block of items; its words are numbered anew."""
    spark = numbered.sparkSession
    own = np.array(sorted({w for _, ws in items for w in ws}))
    v = len(own)
    local = np.full(len(df) + 1, -1, np.int64)  # the last stands for -1
    local[own] = np.arange(v)
    numbers = [local[ws].tolist() for _, ws in items]
    df = df[own]
    idf = np.log((1 + n) / (1 + df)) + 0.05
    used = df <= FREQUENT * n
    for x in numbers:
        used[sorted(set(x), key=lambda w: (df[w] == 0, df[w], w))[:RAREST]] = True  # words that no passage holds find nothing
    width = min(RANK + EXTRA, v)
    omega = np.random.default_rng(7).standard_normal((v, width)).astype(np.float32) * used[:, None]
    sketch = save(numbered.select("ids").mapInArrow(_sketched(kind, spark.sparkContext.broadcast((local, idf, used, omega))), "z binary"), "sketch")
    z = _total(sketch, "z", np.float32, (v, width)).astype(np.float64)
    drop(sketch)
    # Nystrom: A'A is near Z (Omega' Z)^-1 Z'; its leading eigenvectors are A's right singular vectors
    shift = 1e-6 * max(np.linalg.norm(z), 1e-12)
    z = z + shift * omega
    core = omega.T.astype(np.float64) @ z
    values, turn = np.linalg.eigh((core + core.T) / 2)
    values = np.maximum(values, shift)
    u, sigma, _ = np.linalg.svd(z @ (turn / np.sqrt(values)), full_matrices=False)
    rank = min(RANK, width)
    # latent dimensions count alike, as the leading ones only tell languages apart; but those whose singular values are
    # next to nothing are noise of the sketch, and go
    scale = np.where(sigma[:rank] >= NOISE * sigma[0], 1 / np.maximum(sigma[:rank], 0.1 * sigma[0] + 1e-12), 0.0)
    vectors = u[:, :rank] * (idf * used)[:, None] * scale
    shared = spark.sparkContext.broadcast((local, idf, used, vectors, numbers, [i for i, _ in items]))
    return numbered.mapInArrow(_searched(kind, shared, exact), "doc_id long, text_key long, item_ids array<long>, overlap double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose document holds no benchmark item (null ids stay)."""
    key = free("bad_id", *docs.columns)
    bad = save(find_contaminated(docs, benchmark, id_col, text_col).where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.join(small(bad, bad.count()), named(id_col) == F.col(key), "left_anti")
