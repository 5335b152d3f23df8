"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewright.llm import words

#: Length of a language's profile and of a document's, and the n-grams' lengths.
PROFILE, DOCUMENT, LONGEST = 400, 300, 3
UNKNOWN = "und"
#: Characters of a text that are counted at once, and counted n-grams that a worker holds before it hands them on:
#: they bound a task's memory, not what it counts.
PIECE, HELD = 1 << 19, 200_000
_EDGE = ord("_")
_BITS = np.int64(21)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For every code point whether it is a letter (Unicode category L)."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _points(low: str) -> np.ndarray:
    """Code points of a text, whatever isn't a letter turned into the edge of a word, an edge at both ends."""
    x = np.frombuffer(f"_{low}_".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(_is_letter()[x], x, _EDGE)


def _keys(x: np.ndarray) -> np.ndarray:
    """Every n-gram of the words in `x`, each word between two edges, as a number that sorts as the n-gram does.

    Three code points of 21 bits, the first one highest, so a key is the n-gram itself. An n-gram holds a letter and no
    edge but its first or last character.
    """
    letter = x != _EDGE
    one, two = x << (2 * _BITS), x << _BITS
    pair = one[:-1] | two[1:]
    return np.concatenate([one[letter], pair[letter[:-1] | letter[1:]], (pair[:-1] | x[2:])[letter[1:-1]]])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[heads], np.diff(np.append(heads, len(keys)))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key of several counted parts."""
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def count_ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams of a whole text, lower-cased, in order of the n-grams."""
    text = text.lower()
    if len(text) <= PIECE:
        return _counted(_keys(_points(text)))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    last = np.array([_EDGE], np.int64)
    for k in range(0, len(text), PIECE):
        own = _points(text[k : k + PIECE])
        own = own[1:] if k + PIECE >= len(text) else own[1:-1]
        # the two characters before a piece join the n-grams that span the cut; those within them are counted already
        found = _keys(np.concatenate([last, own]))
        parts = [_counted(found)]
        if k:
            keys, n = _counted(_keys(last))
            parts.append((keys, -n))
        out = [_added([*out, *parts])]
        last = np.concatenate([last, own])[-2:]
    keys, n = out[0]
    return keys[n > 0], n[n > 0]


def ngram(key: int) -> str:
    return "".join(chr(c) for c in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c)


def key_of(gram: str) -> int:
    out = 0
    for c in gram.ljust(LONGEST, "\0"):
        out = out << 21 | ord(c)
    return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of each language, added up in the worker and handed on whenever it holds many."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def rows(lang):
        keys, n = _added(held.pop(lang))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([ngram(k) for k in keys.tolist()], pa.string()), pa.array(n, pa.int64())], names=["lang", "ngram", "n"])

    def joined(texts):
        """Texts under an edge each, joined up to a piece; a longer one alone."""
        own, size = [], 0
        for t in texts:
            if own and size + len(t) > PIECE:
                yield "_".join(own)
                own, size = [], 0
            own.append(t)
            size += len(t) + 1
        if own:
            yield "_".join(own)

    for batch in batches:
        for part in words.by_size(batch, 1):
            texts: dict[str, list[str]] = {}
            for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(t)
            for lang, own in texts.items():
                held[lang] = [_added([*held.get(lang, []), *map(count_ngrams, joined(own))])]
                if len(held[lang][0][0]) > HELD:
                    yield rows(lang)
    for lang in sorted(held):
        yield rows(lang)
    words.release()


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, ngram, place): the most frequent n-grams of each language over all given documents, place from 0.

    Rows with a null language or text teach nothing; an empty table gives no profiles. Equal counts are ordered by the
    n-gram. Repeated rows count as often as they stand; other columns are ignored.
    """
    rows = docs.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counted = rows.mapInArrow(_count_grams, "lang string, ngram string, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    # a bound on row_number() itself lets each task keep PROFILE rows of a language before they are shuffled
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "ngram"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= PROFILE).select("lang", "ngram", (F.col("rank") - 1).alias("place"))


class Nearest:
    """Distances of documents to a few profiles: rows of (lang, ngram, place)."""

    def __init__(self, profiles: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in profiles})
        self.keys = np.array(sorted({key_of(g) for _, g, _ in profiles}) or [-1], np.int64)
        # the last column stands for n-grams that no profile holds
        self.places = np.full((max(1, len(self.langs)), len(self.keys) + 1), PROFILE, np.int64)
        for lang, g, place in profiles:
            self.places[self.langs.index(lang), np.searchsorted(self.keys, key_of(g))] = place

    def distances(self, text: str) -> np.ndarray | None:
        """Mean out-of-place distance to each language, 0 to 1; None for a text without a letter."""
        keys, n = count_ngrams(text)
        if not len(keys):
            return None
        less = n.max() - n
        top = keys[np.argsort(less.astype(np.uint16) if n.max() < 1 << 16 else less, kind="stable")[:DOCUMENT]]
        at = np.searchsorted(self.keys, top)
        at[at == len(self.keys)] = 0
        place = self.places[:, np.where(self.keys[at] == top, at, len(self.keys))]
        return np.where(place == PROFILE, PROFILE, np.abs(place - np.arange(len(top)))).mean(axis=1) / PROFILE

    def predict(self, text: str | None) -> tuple[str, float]:
        d = self.distances(text) if text and self.langs else None
        if d is None:
            return UNKNOWN, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        first, second = np.argsort(d, kind="stable")[:2]
        return self.langs[first], float((d[second] - d[first]) / d[second]) if d[second] > 0 else 0.0


def with_language(docs: DataFrame, profiles: DataFrame, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """`docs` with all its columns and the two of `identify`, under these names (they must not be columns of docs)."""
    if clash := {lang_name, score_name} & set(docs.columns):
        raise ValueError(f"docs has columns of these names already: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast([(r["lang"], r["ngram"], r["place"]) for r in profiles.select("lang", "ngram", "place").collect()])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(shared.value)
        for batch in batches:
            for part in words.by_size(batch, at):
                found = [nearest.predict(t) for t in part.column(at).cast(pa.string()).to_pylist()]
                new = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "lang", "score"])
        words.release()

    # names with dots can't be handed to a worker: there columns go by their place
    plain = [f"c{k}" for k in range(len(docs.columns))]
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema.fields, strict=True)), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*docs.columns, lang_name, score_name)


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    A document's n-grams are ranked by count (ties by n-gram); its distance to a language is the mean over its 300 most
    frequent of how far each is out of place, an n-gram that the profile lacks being a whole profile's length out. The
    nearest language is predicted (ties: the first by name); score is how much nearer it is than the next, from 0 to 1.
    `und` with score 0 if the text is null or has no letter (Unicode category L), or if no language is known.
    Profiles (languages x 400 rows) are collected: their size doesn't depend on the documents. Texts of any length are
    counted whole, a piece at a time. An empty table gives no rows; repeated rows repeat; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_language(rows, profiles).select("doc_id", "lang_pred", "score")


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
