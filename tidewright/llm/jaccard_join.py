"""N-gram Jaccard join: grouped prefix join over the distinct five-word shingles of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import words
from tidewright.llm.common import drop, free, named, partitions, save, small
from tidewright.llm.components import connected_components

WORDS = 5
#: Similarity as a fraction of integers, so that the test is exact: 100 * intersection >= 75 * union.
NUM, DEN = 75, 100
#: A shingle in this many documents or more may be ordered behind the others; this many such shingles at most are
#: sent to the executors (12 bytes each). The choice steers the work only: any order gives the same links.
COMMON_FROM, COMMON_MOST = 8, 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text of a column the sorted distinct 64-bit hashes of its shingles.

    A-Z is lower-cased, ASCII white space separates words; under five words the whole sequence is one shingle.
    """
    for _, counts, h in words.blocks(column, words.WHITE):
        ends = np.cumsum(counts)
        x = h[: max(0, len(h) - WORDS + 1)]
        for k in range(1, WORDS):
            x = words.mix(x + _STEP) + h[k : len(h) - WORDS + 1 + k]
        x = words.mix(x)
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            if n >= WORDS:
                s = np.sort(x[end - n : end - WORDS + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif n:
                own = np.array([n], np.uint64)
                for w in h[end - n : end]:
                    own = words.mix(own + _STEP) + w
                yield words.mix(own)
            else:
                yield np.empty(0, np.uint64)


def prefix_length(n: int) -> int:
    """Two sets of this similarity share a shingle among so many first ones of each, in any common order."""
    return n - -(-NUM * n // DEN) + 1


def _packed(gaps: np.ndarray) -> bytes:
    return (b"h" + gaps.astype("<u2").tobytes()) if not len(gaps) or gaps.max() < 65536 else b"w" + gaps.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data[1:], "<u2" if data[:1] == b"h" else "<u4").astype(np.int64))


def _counted(bits: int):
    """Emit per bucket of the top `bits` of the hash the next 24 bits, as gaps, and how often those above 1 came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            keys, counts = np.unique(np.concatenate(held) >> np.uint64(40 - bits), return_counts=True)
            keys = keys.astype(np.int64)
            bucket = keys >> 24
            cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(keys)]))
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                k, c = keys[a:b] & 0xFFFFFF, counts[a:b]
                more = np.flatnonzero(c > 1)
                out.append((int(bucket[a]), _packed(np.diff(k, prepend=0)), more.astype("<u4").tobytes(), c[more].astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "more", "counts"])

        held, n = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                if len(s):
                    held.append(s)
                    n += len(s)
                if n >= 4_000_000:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket lie next to each other: add up their counts, keep the common keys."""

    def finish(bucket, held):
        keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sums = np.add.reduceat(counts, heads)
        keep = sums >= COMMON_FROM
        return (bucket << 24) | keys[heads][keep], sums[keep]

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], names=["key", "n"])

    last, held, found, size = None, [], [], 0
    for batch in batches:
        for bucket, keys, more, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last and held:
                found.append(finish(last, held))
                held = []
            last = bucket
            k = _unpacked(keys)
            c = np.ones(len(k), np.int64)
            c[np.frombuffer(more, "<u4")] = np.frombuffer(counts, "<u4")
            held.append((k, c))
            size = sum(len(x) for x, _ in found)
        if size > 50_000:
            yield batch_of(found)
            found = []
    if held:
        found.append(finish(last, held))
    if found:
        yield batch_of(found)


def _common_shingles(texts: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (top 24 + bits of the hash) of the most common shingles of all documents, sorted, with their counts."""
    rows = texts.select("text").mapInArrow(_counted(bits), "bucket long, keys binary, more binary, counts binary")
    common = save(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_common, "key long, n long"), "common")
    sizes = {r["s"]: r["c"] for r in common.groupBy(F.floor(F.log2("n")).alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()}  # 64 rows at most
    least, total = 64, 0
    for s in sorted(sizes, reverse=True):
        if total + sizes[s] > COMMON_MOST:
            break
        least, total = s, total + sizes[s]
    found = common.where(F.col("n") >= 2.0**least).toPandas()
    drop(common)
    order = np.argsort(found["key"].to_numpy(np.int64))
    return found["key"].to_numpy(np.int64)[order], found["n"].to_numpy(np.int64)[order]


def _prefixes(common, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = common.value
        for batch in batches:
            out = []
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                n = len(s)
                if n and len(keys):
                    own = (s >> np.uint64(40 - bits)).astype(np.int64)
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    rank = np.where(keys[at] == own, counts[at], 0)
                    first = s[np.argsort(rank, kind="stable")]  # rare ones first, by hash; then by count
                else:
                    first = s
                first = first[: prefix_length(n)] if n else first
                out.append((i, n, xxhash.xxh3_128_digest(s.tobytes()), xxhash.xxh3_128_digest(first.tobytes()), first.astype("<u8").tobytes()))
                if len(out) >= 2000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return run


_PREFIX = "doc_id long, n int, content binary, prefix_key binary, prefix binary"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n", "content", "prefix_key", "prefix"])


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group_id, n, prefix) -> a row for each shingle of the prefix and its place."""
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            data = part.column(2).to_pylist()
            lengths = np.array([len(x) // 8 for x in data])
            if not lengths.sum():
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(b"".join(data), "<i8")),
                    pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in lengths])),
                    pa.array(np.repeat(part.column(1).to_numpy(), lengths).astype(np.int32)),
                    pa.array(np.repeat(part.column(0).to_numpy(), lengths)),
                ],
                names=["token", "pos", "n", "group_id"],
            )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one hub lie together, the hub's own text first (member null): compare every member with it."""
    hub_id, hub, links = None, None, []
    for batch in batches:
        for h, m, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(3)), strict=True):
            if m is None:
                hub_id, hub = h, s
                continue
            both = len(np.intersect1d(hub, s, assume_unique=True)) if h == hub_id else 0
            if both and DEN * both >= NUM * (len(hub) + len(s) - both):
                links.append((h, m))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])
            links = []


def _linked(pairs: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    """Of distinct pairs (a, b) those that link. Texts travel once for each pair, and a hub's once per salt."""
    n = pairs.count()
    if not n:
        return pairs.sparkSession.createDataFrame([], "a long, b long")
    ids = save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{label}-ids")
    texts = texts.join(small(ids, ids.count()), "doc_id", "left_semi")
    salt = (F.xxhash64("b") % 64).alias("salt")
    members = texts.join(small(pairs, n), texts["doc_id"] == pairs["b"]).select("a", salt, F.col("doc_id").alias("member"), "text")
    hubs = pairs.select("a", salt).distinct()
    hubs = texts.join(small(hubs, n), texts["doc_id"] == hubs["a"]).select("a", "salt", F.lit(None).cast("long").alias("member"), "text")
    rows = hubs.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("member").asc_nulls_first())
    out = save(rows.mapInArrow(_verify, "a long, b long"), label)
    drop(ids)
    return out


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links).

    A-Z is lower-cased, words are what stands between ASCII white space; a document's set holds its distinct five-word
    shingles, or the whole sequence if it has fewer words; null, empty and wordless documents have an empty set and
    link with nothing. Documents link when 100 * intersection >= 75 * union. Equal sets link. Repeated rows repeat; rows
    that share a doc_id are one document, compared by one of their texts (that of the smallest digest) where the texts
    differ. A row with a null doc_id has its n_shingles, a null component_id and no links. Other columns are ignored.

    Equal sets collapse first. The rest keeps the first quarter of its shingles, rare ones first, and documents with
    the same prefix and size form one group. Groups meet where they share a prefix shingle. Dense clusters are joined
    through one hub per shingle and size class, so that thousands of near copies cost one comparison each; pairs that
    are then still in different components are all compared, where their sizes and the places of the shared shingle
    allow the similarity, so no link between components is missed. Links inside a component change nothing.
    """
    spark = docs.sparkSession
    bits = max(6, min(16, (16 * partitions(spark) - 1).bit_length()))
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    nameless, texts = texts.where("doc_id is null"), texts.where("doc_id is not null")
    common = spark.sparkContext.broadcast(_common_shingles(texts, bits))
    sets = save(texts.mapInArrow(_prefixes(common, bits), _PREFIX), "prefixes")
    full = sets.where("n > 0")
    same = save(full.groupBy("content", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "same-sets")

    # groups of equal prefix and size, over one document for each distinct set
    reps = full.select("doc_id", "n", "content", "prefix_key").join(same.select("content", F.col("rep").alias("doc_id")), ["content", "doc_id"], "left_semi")
    reps = reps.groupBy("doc_id").agg(F.min(F.struct("content", "n", "prefix_key")).alias("x")).select("doc_id", "x.*")
    groups = reps.groupBy("n", "prefix_key").agg(F.min("doc_id").alias("group_id"))
    members = save(reps.join(groups, ["n", "prefix_key"]).select("doc_id", "n", "group_id", "content"), "members")
    heads = members.where("doc_id = group_id").select("doc_id", "content")
    entries = full.join(small(heads, heads.count()), ["doc_id", "content"], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("group_id"), "n", "prefix")
    packed = save(entries, "entries")
    # the wide table goes before prefixes are unfolded: from here on sets are needed without their prefixes only
    narrow = save(sets.select("doc_id", "n", "content"), "sets")
    drop(sets)
    entries = packed.mapInArrow(_unfold, "token long, pos int, n int, group_id long")
    # counts are added up before they are shuffled; the join may split a shingle that very many groups share
    tokens = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    shared = save(entries.join(tokens, "token", "left_semi"), "shared")
    drop(packed)

    # one hub per shingle and size class, and per group
    size_class = F.floor(F.log("n") / F.log(F.lit(DEN / NUM)))
    seen = members.where("doc_id <> group_id").select(F.col("group_id").alias("a"), F.col("doc_id").alias("b"))
    component = members.select("doc_id", F.col("doc_id").alias("component_id"))
    found: list[DataFrame] = []
    for k in range(star_rounds):
        own = shared.join(component.withColumnRenamed("doc_id", "group_id"), "group_id") if k else shared.withColumn("component_id", F.col("group_id"))
        own = own.withColumn("size_class", size_class).withColumn("side", F.lit(k % 2))
        # of each component that holds the shingle one document, so that what is joined already isn't joined again
        one = own.groupBy("token", "size_class", "component_id").agg(F.min(F.struct("group_id", "n")).alias("x"))
        hub = one.groupBy("token", "size_class").agg((F.min if k % 2 == 0 else F.max)("x").alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        pairs = one.join(hub, ["token", "size_class"]).where("x.group_id <> h.group_id").where(f"{DEN} * least(x.n, h.n) >= {NUM} * greatest(x.n, h.n)").select(F.col("h.group_id").alias("a"), F.col("x.group_id").alias("b"))
        pairs = (pairs.unionByName(seen) if k == 0 else pairs).distinct()
        pairs = save(pairs, "star-pairs")
        found.append(_linked(pairs, texts, "star-links"))
        drop(pairs)
        component = _components_of(members, reduce(DataFrame.unionByName, found))
    # what is left: all pairs of documents in different components that share a prefix shingle or a group
    rest = shared.join(members.select("group_id", "doc_id"), "group_id").join(component, "doc_id").select(F.struct("token").alias("key"), "pos", "n", "doc_id", "component_id")
    inside = members.join(component, "doc_id").select(F.struct("group_id").alias("key"), F.lit(0).alias("pos"), "n", "doc_id", "component_id")
    mixed = [_mixed(rest), _mixed(inside)]
    pairs = save(_across(mixed[0]).unionByName(_across(mixed[1])).distinct(), "cross-pairs")
    drop(shared, *mixed)
    found.append(_linked(pairs, texts, "cross-links"))
    component = _components_of(members, reduce(DataFrame.unionByName, found))
    drop(pairs)

    # back to all documents: through its set's representative; the smallest document of a component is one
    of_set = same.join(component, same["rep"] == component["doc_id"]).select("content", "component_id")
    labelled = narrow.where("n > 0").join(of_set, "content").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = nameless.mapInArrow(_prefixes(common, bits), _PREFIX).select("doc_id", "n").unionByName(narrow.where("n = 0").select("doc_id", "n"))
    return labelled.unionByName(alone.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of keys that more than one component holds; the others pair nothing."""
    mixed = rows.groupBy("key").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo < hi").select("key")
    return save(rows.join(mixed, "key", "left_semi"), "mixed")


def _across(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents of different components that share a key, where sizes and the places of what they share
    allow the similarity. All conditions stand in the join itself."""
    side = lambda s: rows.select("key", *(F.col(c).alias(c + s) for c in rows.columns if c != "key"))
    may = f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b) and {NUM + DEN} * least(n_a - pos_a, n_b - pos_b) >= {NUM} * (n_a + n_b)"
    pairs = side("_a").join(side("_b"), "key").where("component_id_a < component_id_b")
    return pairs.where(may).select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b"))


def _components_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every member, linked or not."""
    found = connected_components(links).withColumnRenamed("node", "doc_id")
    return save(members.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id")), "components")


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without those whose doc_id isn't the smallest of its class (null ids stay)."""
    key = free("gone_id", *docs.columns)
    gone = save(jaccard_classes(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(small(gone, gone.count()), named(id_col) == F.col(key), "left_anti")
