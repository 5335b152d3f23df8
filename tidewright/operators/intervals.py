"""Inclusive date intervals: merge, subtract, clip, gaps, N-th counted day, closing of open intervals.

Every operator takes key columns, so it partitions by them; within a key it is a window, never a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions.dates import inclusive_days


def merge(iv: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or adjacent intervals of a key become one; reversed and null ones are dropped."""
    rows = iv.select(*keys, F.col(start).alias("start"), F.col(end).alias("end")).where("start <= end").distinct()
    by = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") > F.date_add(before, 1)), 1).otherwise(0)
    island = F.sum("_opens").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_opens", opens).withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What of the (merged) intervals of a no interval of b covers, by a boundary sweep: two rows an interval, whatever its length."""

    def edges(iv: DataFrame, column: str) -> DataFrame:
        return merge(iv, keys).select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.date_add("end", 1).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.at", F.col("e.d").alias(column))

    both = edges(a, "da").withColumn("db", F.lit(0)).unionByName(edges(b, "db").withColumn("da", F.lit(0)))
    turns = both.groupBy(*keys, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    by = Window.partitionBy(*keys).orderBy("at")
    inside = (F.sum("da").over(by) > 0) & (F.sum("db").over(by) == 0)
    parts = turns.select(*keys, F.col("at").alias("start"), F.date_sub(F.lead("at").over(by), 1).alias("end"), inside.alias("inside")).where("inside")
    return merge(parts, keys)


def clip(iv: DataFrame, stop: Column, start: str = "start", end: str = "end") -> DataFrame:
    return iv.where(F.col(start) <= stop).withColumn(end, F.least(F.col(end), stop))


def gaps(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Days between consecutive merged intervals, as intervals."""
    after = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    return merged.withColumn("_next", after).where("_next is not null").select(*keys, F.date_add("end", 1).alias("start"), F.date_sub("_next", 1).alias("end"))


def days(iv: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each day (inclusive); for short spans, else prefer the sweep."""
    return iv.where("start <= end").select(*keys, F.explode(F.sequence("start", "end")).alias("day"))


def counted_days(iv: DataFrame, excluded: DataFrame, keys: list[str], target: int) -> DataFrame:
    """(keys, counted_days, reached): days of iv that aren't excluded, and the target-th of them (null if there are
    fewer; the first of all for a target of 0 or less). The days are never materialised: the excluded intervals are cut out and lengths are added up."""
    left = subtract(iv, excluded, keys).withColumn("n", inclusive_days(F.col("start"), F.col("end")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = left.withColumn("before", before)
    target = max(target, 1)
    hit = F.when((F.col("before") < target) & (F.col("before") + F.col("n") >= target), F.date_add("start", (F.lit(target) - F.col("before") - 1).cast("int")))
    return left.groupBy(*keys).agg(F.sum("n").alias("counted_days"), F.min(hit).alias("reached"))


def close_open(starts: DataFrame, terminators: DataFrame, keys: list[str], today: Column) -> DataFrame:
    """(keys, start, end): each start ends at the first terminator on or after it, else today. `at` is the date column of both."""
    both = starts.select(*keys, "at", F.lit(True).alias("opens")).unionByName(terminators.select(*keys, "at", F.lit(False).alias("opens")))
    # a RANGE frame holds the rows of the same day whatever their order
    end = F.min(F.when(~F.col("opens"), F.col("at"))).over(Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return both.withColumn("end", end).where("opens").select(*keys, F.col("at").alias("start"), F.coalesce("end", today).alias("end"))


def overlap_days(a: DataFrame, b: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """(keys, overlap): days that both merged sides share, by bins of `width` days so that the join has an equal key."""

    def binned(iv: DataFrame, s: str, e: str) -> DataFrame:
        day = lambda c: F.floor(F.unix_date(c) / width)
        return merge(iv, keys).select(*keys, F.col("start").alias(s), F.col("end").alias(e), F.explode(F.sequence(day("start"), day("end"))).alias("bin"))

    first = F.col("bin") * width
    joined = binned(a, "s1", "e1").join(binned(b, "s2", "e2"), [*keys, "bin"])
    lo = F.greatest(F.unix_date("s1"), F.unix_date("s2"), first)
    hi = F.least(F.unix_date("e1"), F.unix_date("e2"), first + (width - 1))
    return joined.withColumn("n", F.greatest(hi - lo + 1, F.lit(0))).groupBy(*keys).agg(F.sum("n").alias("overlap")).where("overlap > 0")
