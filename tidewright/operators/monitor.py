"""Condition monitoring: keyed alerts, windows before a date, lifecycle against the stored state, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def due_alerts(df: DataFrame, due: Column, today: Column, key: Column) -> DataFrame:
    """One alert a row whose date is near: the first window (30, 7, 0 days) that fits, smallest first; overdue by then."""
    left = F.date_diff(due, today)
    kind = F.when(left < 0, "OVERDUE").when(left == 0, "DUE_0").when(left <= 7, "DUE_7").when(left <= 30, "DUE_30")
    severity = F.when(F.col("kind").isin("OVERDUE", "DUE_0"), "critical").when(F.col("kind") == "DUE_7", "warning").otherwise("info")
    return df.withColumn("kind", kind).where("kind is not null").withColumn("severity", severity).withColumn("dedupe_key", F.concat_ws(":", F.col("kind"), key.cast("string")))


def lifecycle(stored: DataFrame, current: DataFrame, today: Column, escalate_after: int = 3) -> DataFrame:
    """(dedupe_key, state, opened_on, escalated) from stored alerts (dedupe_key, state, opened_on, escalated) and the
    keys that hold now: new ones open, gone ones resolve, resolved ones that return reopen, old open ones escalate once."""
    s = stored.select("dedupe_key", F.col("state").alias("s"), F.col("opened_on").alias("o"), F.col("escalated").alias("e"))
    j = s.join(current.select("dedupe_key", F.lit(True).alias("now")).distinct(), "dedupe_key", "full_outer")
    state = F.when(F.col("s").isNull(), "open").when(F.col("now").isNull(), "auto_resolved").when(F.col("s") == "auto_resolved", "reopened").otherwise(F.col("s"))
    opened = F.when(F.col("s").isNull() | ((F.col("s") == "auto_resolved") & F.col("now")), today).otherwise(F.col("o"))
    out = j.select("dedupe_key", state.alias("state"), opened.alias("opened_on"), F.coalesce("e", F.lit(False)).alias("e"))
    late = (F.col("state") != "auto_resolved") & (F.date_diff(today, F.col("opened_on")) >= escalate_after)
    return out.select("dedupe_key", "state", "opened_on", (F.col("e") | late).alias("escalated"))


def transitions(changes: DataFrame, days: int = 3) -> DataFrame:
    """(dedupe_key, at, transition, severity) of changes (dedupe_key, at, seq, action, severity): what the stream form of
    the lifecycle gives out, as windows over the whole table.

    The first `holds` opens; after it the last `holds` or `gone` before a row tells whether the alert is open; the first
    `acknowledged` of an open alert ends it. Escalation falls into the first stretch that is open at its due time or
    later; it isn't known yet if that lies behind the latest row of the table (to the millisecond).
    """
    by = Window.partitionBy("dedupe_key").orderBy("at", "seq", F.col("action").asc_nulls_first(), F.col("severity").asc_nulls_first())
    seen, all_ = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    rows = changes.where("dedupe_key is not null and at is not null")
    said = rows.withColumn("last", F.last(F.when(F.col("action").isin("holds", "gone"), F.col("action")), ignorenulls=True).over(seen)).withColumn("started", F.max(F.col("action") == "holds").over(all_))
    said = said.where("started").withColumn("opens", ~F.coalesce(F.max(F.col("action") == "holds").over(seen), F.lit(False)))
    # after the first row that opens, a stretch is open while the last of holds and gone is holds
    open_ = ~F.col("opens") & (F.col("last") == "holds")
    said = said.withColumn("acks", F.sum(((F.col("action") == "acknowledged") & open_).cast("int")).over(all_))
    said = said.where("acks = 0 or (acks = 1 and action = 'acknowledged')").withColumn("nth", F.row_number().over(Window.partitionBy("dedupe_key", "acks").orderBy("at", "seq"))).where("acks = 0 or nth = 1")
    kind = F.when(F.col("opens"), "opened").when((F.col("action") == "holds") & (F.col("last") == "gone"), "reopened").when((F.col("action") == "gone") & open_, "auto_resolved").when((F.col("action") == "acknowledged") & open_, "acknowledged")
    moved = said.withColumn("transition", kind).where("transition is not null")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = moved.withColumn("severity", F.first("severity").over(whole)).withColumn("due", F.first("at").over(whole) + F.make_dt_interval(F.lit(days))).withColumn("until", F.lead("at").over(by))
    out = moved.select("dedupe_key", "at", "transition", "severity")
    start = F.greatest("due", "at")
    horizon = rows.agg(F.date_trunc("millisecond", F.max("at")).alias("horizon"))
    late = moved.where(F.col("transition").isin("opened", "reopened") & F.col("severity").isin("critical", "high")).withColumn("start", start)
    late = late.where("until is null or until > start").join(F.broadcast(horizon), F.col("start") <= F.col("horizon"))  # one row
    return out.unionByName(late.groupBy("dedupe_key").agg(F.min("start").alias("at"), F.lit("escalated").alias("transition"), F.min("severity").alias("severity")))


def unchanged(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Keys whose input fingerprint already has a result: they needn't be computed again."""
    return inputs.join(results.select(key, "fingerprint"), [key, "fingerprint"], "left_semi")
