"""Spelling variants: words one edit apart, found in a positional q-gram index cut into bounded shards."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import LOWER, UPPER, drop, save, small

#: Length of words and of the index's grams; words of one shard beyond which it is cut again.
LEAST, Q, MOST = 7, 2, 1024
TIMES = 10
RUN = "[A-Za-z\\u00C0-\\u00FF]"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = 2) -> DataFrame:
    """(word, n): distinct words of at least `least` code points that occur `times` times or more in all texts.

    Runs of Latin letters, A-Z lower-cased; where 31 divides the crc32 of `<id>:<run>`, the run loses its code point
    crc32 % length. A null id is written as empty text; null texts have no words. Copies count as often as they stand.
    """
    # deletion only shortens a run, so shorter ones can't become words
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("run"))
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    hashed = runs.select("id", low.alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _key() -> Column:
    """Of a word without its gap: what its shard's words agree on. A longer word's gap is one longer, its class the
    shorter word's length. Equal hashes of unequal rests only add candidates."""
    rest = F.concat(F.substring(F.col("word"), F.lit(1), F.col("low")), F.lit("\0"), F.substring(F.col("word"), F.col("high") + 1 + F.col("longer"), F.length("word")))
    return F.xxhash64("class", "low", "high", rest)


def shards(vocabulary: DataFrame, least: int = LEAST, most: int = MOST) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (shard, class, low, high, longer, word, n), and the scratch tables that they are read from. Every two words one
    edit apart share the shard in which the shorter one's gap [low, high) holds the edit, and agree outside the gap.

    A word of length L is cut in two as the shorter or equal word of a pair (class L) and as the longer one (class
    L - 1). Shards of more than `most` words are cut again, their gap halved, until they are small or their gap has a
    single code point: then at most as many words as the alphabet has one- and two-letter strings are in it.
    """
    length = F.length("word")
    classes = vocabulary.select("word", "n", F.explode(F.array(F.struct(length.alias("class"), F.lit(0).alias("longer")), F.struct((length - 1).alias("class"), F.lit(1).alias("longer")))).alias("c")).select("word", "n", "c.*")
    classes = classes.where(F.col("class") >= least).withColumn("half", (F.col("class") / 2).cast("int"))
    gaps = F.array(F.struct(F.lit(0).alias("low"), F.col("half").alias("high")), F.struct(F.col("half").alias("low"), F.col("class").alias("high")))
    level = classes.select("word", "n", "class", "longer", F.explode(gaps).alias("g")).select("word", "n", "class", "longer", "g.*").withColumn("shard", _key())
    level, done, scratch = save(level, "shards"), None, []
    while True:
        large = save(level.where("high - low > 1").groupBy("shard").count().where(F.col("count") > most).select("shard"), "large-shards")
        n = large.count()
        scratch += [level, large]
        fit = level.join(small(large, n), "shard", "left_anti") if n else level
        done = fit if done is None else done.unionByName(fit)
        if not n:
            return done, scratch
        half = ((F.col("low") + F.col("high")) / 2).cast("int")
        gaps = F.array(F.struct(F.col("low"), half.alias("high")), F.struct(half.alias("low"), F.col("high")))
        cut = level.join(small(large, n), "shard", "left_semi").select("word", "n", "class", "longer", F.explode(gaps).alias("g"))
        level = save(cut.select("word", "n", "class", "longer", "g.*").withColumn("shard", _key()), "shards")


def grams(gap: str) -> list[str]:
    """Q-grams of a gap's text between two edges (what stands outside is the same in the whole shard)."""
    edged = f"\0{gap}\0"
    return [edged[k : k + Q] for k in range(len(edged) - Q + 1)]


def merged(lists: list[list[int]], bound: int) -> list[int]:
    """Members that stand in at least `bound` of the sorted lists.

    The shortest lists but bound - 1 are merged by a heap: a member of enough lists is in one of these. Those it yields are
    looked up in the longest lists.
    """
    lists = sorted(lists, key=len)
    cut = len(lists) - bound + 1
    short, rest = lists[:cut], [x for x in lists[cut:] if x]
    out, last, n = [], -1, 0

    def held(x: list[int]) -> bool:
        at = bisect_left(x, last)
        return at < len(x) and x[at] == last

    def ends():
        if last >= 0 and n + len(rest) >= bound and n + sum(map(held, rest)) >= bound:
            out.append(last)

    for member in heapq.merge(*[x for x in short if x]):
        if member == last:
            n += 1
        else:
            ends()
            last, n = member, 1
    ends()
    return out


def one_edit(a: str, b: str) -> int:
    """Where the shorter or equal `a` first differs from `b`, if one inserted or replaced code point makes it `b`; else -1."""
    if a == b or not 0 <= len(b) - len(a) <= 1:
        return -1
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return k if a[k + (len(a) == len(b)) :] == b[k + 1 :] else -1


def near_in_shard(rows: list[tuple[int, int, int, int, str, int]]) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of rows of a shard whose words are one edit apart, each once over all shards.

    Every shorter row looks up its grams among rows of its length (at the same place) and among rows one longer (at the
    same place or the next), and keeps those in enough lists: one replaced code point spoils Q grams, an inserted one
    Q - 1. What is left is compared whole.
    """
    low, high = rows[0][1], rows[0][2]
    lists: dict[tuple[int, str, int], list[int]] = defaultdict(list)
    texts = []
    for i, (_, _, _, longer, word, _) in enumerate(rows):
        texts.append(word[low : high + longer])
        for at, g in enumerate(grams(texts[i])):
            lists[longer, g, at].append(i)
    empty: list[int] = []
    equal = [i for i, r in enumerate(rows) if not r[3]]
    for i in equal:
        own = grams(texts[i])
        same = [lists.get((0, g, at), empty) for at, g in enumerate(own)]
        found = merged(same, len(own) - Q) if len(own) > Q else equal
        # an inserted code point leaves a gram where it was or moves it on by one: both lists as one
        more = [list(heapq.merge(lists.get((1, g, at), empty), lists.get((1, g, at + 1), empty))) for at, g in enumerate(own)]
        found = [j for j in found if j > i] + merged(more, max(1, len(own) - Q + 1))
        klass, _, _, _, word, _ = rows[i]
        for j in found:
            k = one_edit(word, rows[j][4])
            if k >= 0 and low <= min(k, klass - 1) < high:
                yield i, j


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of each shard, its near words there: how many, and the best by n, then by code points."""
    held: list[tuple] = []
    shard = None
    out: list[tuple[str, int, int, str]] = []

    def flush():
        best: dict[int, tuple[int, int, str]] = {}
        for i, j in near_in_shard(held):
            for x, y in ((i, j), (j, i)):
                count, n, word = best.get(x, (0, 0, ""))
                _, _, _, _, other, m = held[y]
                best[x] = (count + 1, m, other) if m > n or m == n and other < word else (count + 1, n, word)
        out.extend((held[x][4], *found) for x, found in best.items())

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "n", "form"])

    for batch in batches:
        for hashed, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "class", "low", "high", "longer", "word", "n")), strict=True):
            key = (hashed, *row[:3])  # one hash may stand for several gaps
            if key != shard and held:
                flush()
                held = []
                if len(out) > 10_000:
                    yield batch_of(out)
                    out = []
            shard = key
            held.append(tuple(row))
    if held:
        flush()
    if out:
        yield batch_of(out)


def near_words(vocabulary: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(word, n_near, form_n, near): of each word with near words their number, and the one of largest n (ties: the
    first in code-point order)."""
    rows, scratch = shards(vocabulary, least, most)
    dealt = rows.select("shard", "class", "low", "high", "longer", "word", "n").repartition("shard").sortWithinPartitions("shard", "class", "low", "high", "longer", "word")
    found = dealt.mapInArrow(_index, "word string, n_near long, n long, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "form")).alias("b"))
    out = save(best.select("word", "n_near", (-F.col("b.less")).alias("form_n"), F.col("b.form").alias("near")), "near-words")
    drop(*scratch)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last form that following forms reaches.

    Each round joins every word's last known form with that form's own, so the distance followed doubles. Forms must not
    lead in circles: each occurs more often than its word.
    """
    current = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = save(current.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        drop(current)
        current = after
        if not moved:
            return current.select("word", "root")


def variants(vocabulary: DataFrame, least: int = LEAST, times: int = TIMES, most: int = MOST) -> DataFrame:
    """(word, n) -> one row per word: word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of largest
    n (ties: the smallest in code-point order) if that n is at least `times` the word's own; else null. Its root is what
    following forms ends at; the word itself without a form. Words must be distinct, of at least `least` code points and
    not null. Every pair of near words counts, whatever the size of its shard. No words give no rows.
    """
    vocabulary = save(vocabulary.select("word", "n"), "vocabulary")
    near = near_words(vocabulary, least, most)
    likely = F.col("form_n") >= times * F.col("n")
    found = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("near")).alias("form"), F.when(likely, F.col("form_n")).alias("form_n"))
    found = save(found, "forms")
    drop(vocabulary, near)
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`variants` of the `words` of whole texts. Empty tables and null texts give no words; repeated rows count again;
    other columns are ignored."""
    return variants(words(docs, id_col, text_col))
