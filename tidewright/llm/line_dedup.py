"""Line dedup over overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.common import free, named, save

WINDOW = 3


def _lines(text):
    return F.split(text, "\n", -1)


def removed_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_key, text) -> (doc_key, text_key, removed: sorted array of disjoint inclusive line ranges) of those that
    lose lines."""
    keyed = docs.select("doc_key", F.xxhash64("text").alias("text_key"), _lines(F.col("text")).alias("lines")).where(F.size("lines") >= WINDOW)
    # two 64-bit hashes of each line, then of each window: 128 bits tell windows of a very large corpus apart
    hashed = keyed.select(
        "doc_key",
        "text_key",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("p"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(7), x)).alias("q"),
    )
    windows = hashed.select(
        "doc_key",
        "text_key",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.size("p") - WINDOW),
                lambda i: F.struct(
                    F.xxhash64(*(F.get("p", i + k) for k in range(WINDOW))).alias("a"),
                    F.xxhash64(*(F.get("q", i + k) for k in range(WINDOW))).alias("b"),
                ),
            )
        ).alias("pos", "w"),
    ).select("doc_key", "text_key", "pos", "w.a", "w.b")
    windows = save(windows, "windows")
    place = F.struct("doc_key", "text_key", "pos")
    repeated = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = windows.join(repeated, ["a", "b"]).select("doc_key", "text_key", "pos", F.expr("first <=> struct(doc_key, text_key, pos)").alias("is_first"))
    covered = (
        hits.select("doc_key", "text_key", F.explode(F.sequence("pos", F.col("pos") + (WINDOW - 1))).alias("line"), "is_first")
        .groupBy("doc_key", "text_key", "line")
        .agg(F.max("is_first").alias("stays"))
        .where(~F.col("stays"))
    )
    by_doc = Window.partitionBy("doc_key", "text_key").orderBy("line")
    ranges = covered.withColumn("island", F.col("line") - F.row_number().over(by_doc)).groupBy("doc_key", "text_key", "island").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    return ranges.groupBy("doc_key", "text_key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("removed"))


def added_names(columns: list[str]) -> tuple[str, str, str]:
    """How `line_dedup` calls the columns that it adds: lines, lines removed, ranges removed."""
    n_lines, n_removed, removed = (free(f"line_dedup_{c}", *columns) for c in ("n_lines", "n_removed", "removed"))
    return n_lines, n_removed, removed


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `text_col` cleaned, and the columns line_dedup_n_lines, line_dedup_n_removed, line_dedup_removed.

    Every three consecutive lines form a window; lines end at \\n and are compared whole. A window that occurs more
    than once in all documents stays where it comes first, by doc_id (null first) and place; the lines that later
    occurrences cover go, unless a first occurrence covers them too. Documents of fewer than three lines have no
    window and stay. Null text stays null and has 0 lines; text whose lines all go becomes empty. Rows that
    repeat the same id and text are one document: each stays first where the other does. An empty table gives no rows;
    other columns pass through, whatever their names; where one has the name of an added column, the added one has
    underscores after it.
    """
    n_lines, n_removed, removed = added_names(docs.columns)
    taken = [*docs.columns, n_lines, n_removed, removed]
    id_, key, own, split_ = (free(f"line_dedup_{c}", *taken) for c in ("id", "key", "of", "lines"))
    gone = removed_lines(docs.select(named(id_col).alias("doc_key"), named(text_col).alias("text")))
    gone = gone.select(F.col("doc_key").alias(id_), F.col("text_key").alias(key), F.col("removed").alias(own))
    joined = docs.join(gone, named(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(named(text_col)) == F.col(key)), "left")
    n = F.when(named(text_col).isNull(), 0).otherwise(F.size(_lines(named(text_col))))
    found = F.coalesce(F.col(own), F.array().cast("array<struct<first:int,last:int>>"))
    joined = joined.select(*[named(c) for c in docs.columns], n.alias(n_lines), found.alias(removed))
    cuts, lines = F.col(removed), _lines(named(text_col))
    kept = F.transform(
        F.sequence(F.lit(0), F.size(cuts)),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["last"] + 1).alias("s"),
            F.when(i == F.size(cuts), F.col(n_lines) - 1).otherwise(F.get(cuts, i)["first"] - 1).alias("e"),
        ),
    )
    parts = F.transform(F.filter(kept, lambda k: k["e"] >= k["s"]), lambda k: F.array_join(F.slice(split_, k["s"] + 1, k["e"] - k["s"] + 1), "\n"))
    clean = F.when(F.size(cuts) == 0, named(text_col)).otherwise(F.array_join(parts, "\n"))
    gone_lines = F.aggregate(cuts, F.lit(0), lambda acc, c: acc + c["last"] - c["first"] + 1)
    out = joined.withColumn(split_, F.when(F.size(cuts) > 0, lines))
    shown = [clean.alias(c) if c == text_col else named(c) for c in docs.columns]
    return out.select(*shown, n_lines, gone_lines.alias(n_removed), removed)
