"""A corpus pipeline: language identification, line dedup, near-duplicate removal, decontamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup
from tidewright.llm.common import drop, free, named, save, table
from tidewright.llm.queries import word_vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, null and empty texts among them; the predicted language takes the place of the
    given one. Profiles are learned from all documents that aren't held out; where none has a language, all go. Whole
    texts of any length count; of languages equally near the first by name is taken; repeated rows are judged alike. An
    empty table stays empty, and other columns pass through, whatever their names."""
    lang, score = (free(c, *docs.columns) for c in ("lang_pred", "lang_score"))
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out("doc_id")))
    found = language_id.with_language(docs, profiles, lang_name=lang, score_name=score).where(F.col(lang) != language_id.UNKNOWN)
    return found.select(*[F.col(lang).alias("lang") if c == "lang" else named(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; n_chars follows. A document that loses all its lines goes; null and
    short texts stay as they are. First comes the smallest doc_id (null before all), then the place in the text; rows
    that repeat id and text stay together. An empty table stays empty; other columns pass through, whatever their names."""
    lines, removed, _ = line_dedup.added_names(docs.columns)
    out = line_dedup.line_dedup(docs).where((F.col(removed) < F.col(lines)) | (F.col(lines) == 0))
    return out.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else named(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays, with all rows of that id. Null, empty
    and wordless texts and rows without an id are like no other and stay. Whole texts count, whatever their length; an
    empty table stays empty; other columns pass through, whatever their names."""
    return jaccard_join.keep_one_per_class(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of that id; null and empty texts hold none, rows without an
    id stay, null items are in no text. An empty table or benchmark drops nothing; other columns pass through, whatever
    their names."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of the ids and of the text they decode to: a row for each
    row, repeated ones alike; a null or empty text has no ids. Texts of any length are encoded whole; an empty table
    gives no rows; other columns are ignored."""
    coded = bpe.bpe(docs, word_vocabulary())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("bpe", tokenise),
]

#: Language profiles, shingle links, latent retrieval and BPE are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next stage's input."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop(before)
        before = docs
    return docs
