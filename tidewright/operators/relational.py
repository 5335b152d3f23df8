"""Relational building blocks: first-wins dedupe, arg-min, current version, scoped pages, upserts, folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def argmin(df: DataFrame, keys: list[str], value: Column, order: Column, name: str) -> DataFrame:
    """The value with the least order in each key: one partial aggregate, no sort."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(name))


def scoped_page(df: DataFrame, scope: Column, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Filter first, then sort and cut; `total` counts the scope by an aggregate, not by a global window."""
    inside = df.where(scope)
    total = inside.agg(F.count(F.lit(1)).alias("total"))
    return inside.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join: new values win, old ones stay; `change` says inserted, updated, unchanged or stale."""
    o, n = old.select(*keys, *[F.col(v).alias(f"_old_{v}") for v in values], F.lit(1).alias("_o")), new.select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values], F.lit(1).alias("_n"))
    j = o.join(n, keys, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"_old_{v}").eqNullSafe(F.col(f"_new_{v}"))
    change = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "stale").when(same, "unchanged").otherwise("updated")
    return j.select(*keys, *[F.coalesce(f"_new_{v}", f"_old_{v}").alias(v) for v in values], change.alias("change"))


def fold(df: DataFrame, key: str, id_col: str, first: list[str], sets: list[str]) -> DataFrame:
    """Duplicates by key become one row: least id, first non-null of some columns in id order, union of others."""
    return df.groupBy(key).agg(
        F.min(id_col).alias(id_col),
        F.count(F.lit(1)).alias("n"),
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(id_col))).alias(c) for c in first],
        *[F.array_sort(F.collect_set(c)).alias(c) for c in sets],
    )


def fingerprint(df: DataFrame, key: str, value: Column, name: str = "fingerprint") -> DataFrame:
    """SHA-256 over a key's values in their own order: equal inputs give equal prints, so unchanged keys can be skipped."""
    return df.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(value)), "|"), 256).alias(name))


def nearest(df: DataFrame, anchors: DataFrame, key: str, date: str, anchor: str) -> DataFrame:
    """Each row with the least distance in days to an anchor of its key (null without anchors).

    Two window passes, the last anchor on or before and the first after, instead of a join of all pairs.
    """
    both = df.select(key, F.col(date).alias("_at"), F.struct(*df.columns).alias("_row"), F.lit(None).cast("date").alias("_anchor")).unionByName(
        anchors.select(key, F.col(anchor).alias("_at"), F.lit(None).cast(df.select(F.struct(*df.columns)).schema[0].dataType).alias("_row"), F.col(anchor).alias("_anchor"))
    )
    by = Window.partitionBy(key).orderBy("_at")
    before = F.last("_anchor", ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_anchor", ignorenulls=True).over(by.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    out = both.withColumn("_b", before).withColumn("_a", after).where("_row is not null")
    gap = F.least(F.date_diff("_at", "_b"), F.date_diff("_a", "_at"))
    return out.select("_row.*", gap.alias("days_to_anchor"))


def page_of(pages: DataFrame, hits: DataFrame, key: str, page: str, text: str, at: str, name: str = "page") -> DataFrame:
    """`hits` (key, at) with the last page that begins at or before the offset; pages are joined by one character.

    Offsets and hits are merged into one sorted window, so there is no range join.
    """
    by = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    begins = pages.select(key, F.col(page).alias("_p"), F.coalesce(F.sum(F.length(text) + 1).over(by), F.lit(0)).cast("long").alias("_o"))
    both = begins.unionByName(hits.select(key, F.lit(None).cast(begins.schema["_p"].dataType).alias("_p"), F.col(at).cast("long").alias("_o")))
    # a RANGE frame takes in pages that begin just there, whatever the order of equals
    last = F.max("_p").over(Window.partitionBy(key).orderBy("_o").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn(name, last).where("_p is null").select(key, F.col("_o").alias(at), name)


def remap(df: DataFrame, col: str, kept: DataFrame) -> DataFrame:
    """Ids in `col` that were merged away (kept: old, kept) become the id that stays."""
    return df.join(kept, F.col(col) == F.col("old"), "left").withColumn(col, F.coalesce("kept", col)).drop("old", "kept")
