"""Custody timelines: recorded events become counted intervals, with the flags a reviewer needs.

Events are (person_id, case_id, type, start, end, is_primary, confidence); a case sees its own events and those that
name no case. Everything below a person and case is a window or an equal-key join on them, so it scales with people.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions.dates import inclusive_days
from tidewright.operators import intervals
from tidewright.sources.scratch import checkpointed

# Kinds of events.
COUNTING = ["police_custody", "judicial_custody", "hospitalised_in_custody"]
STARTERS = ["arrest", "re_arrest", "surrendered", "transfer"]
TERMINATORS = ["released", "escaped"]
EXCLUSIONS = ["on_bail", "absconding"]
CASE = ["person_id", "case_id"]


def scoped_events(cases: DataFrame, events: DataFrame, lenient: bool = False) -> DataFrame:
    """Events under the case they are counted for; `lenient` also takes those of the person's other cases."""
    e = events.withColumnRenamed("case_id", "_of")
    own = F.lit(True) if lenient else F.col("_of").isNull() | (F.col("_of") == F.col("case_id"))
    return cases.select(*CASE).join(e, "person_id").where(own)


def arrests(scoped: DataFrame, threshold: float) -> DataFrame:
    """(case, arrest_date, arrest_confidence, arrest_conflict, primary_conflict): the earliest arrest in a primary
    source, else the earliest of all, whose confidence then stays below the threshold."""
    a = scoped.where("type = 'arrest'").withColumn("_pool", F.max("is_primary").over(Window.partitionBy(*CASE)))
    pool = F.col("is_primary") == F.col("_pool")
    a = a.withColumn("_chosen", F.min(F.when(pool, F.col("start"))).over(Window.partitionBy(*CASE)))
    sure = F.max(F.when(pool & (F.col("start") == F.col("_chosen")), F.col("confidence")))
    return a.groupBy(*CASE).agg(
        F.min("_chosen").alias("arrest_date"),
        F.when(F.max("is_primary"), sure).otherwise(F.least(sure, F.lit(threshold - 0.01))).alias("arrest_confidence"),
        (F.min("start") < F.max("start")).alias("arrest_conflict"),
        (F.min(F.when(F.col("is_primary"), F.col("start"))) < F.max(F.when(F.col("is_primary"), F.col("start")))).alias("primary_conflict"),
    )


def normalised(scoped: DataFrame, today: Column, threshold: float) -> DataFrame:
    """Every event that opens, holds or interrupts custody, with `role` (custody, excluded or null), closed dates,
    `explicit` and the `flag` of what was wrong with it."""
    later = Window.partitionBy(*CASE).orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    closing = F.min(F.when(F.col("type").isin(TERMINATORS), F.col("start"))).over(later)
    e = scoped.withColumn("_closing", closing).join(arrests(scoped, threshold).select(*CASE, "arrest_date"), CASE, "left")
    counts, excludes = F.col("type").isin(COUNTING + STARTERS), F.col("type").isin(EXCLUSIONS)
    e = e.where(counts | excludes).where((F.col("type") != "arrest") | (F.col("start") == F.col("arrest_date")))
    shut = F.when(excludes, F.least(F.coalesce("end", "_closing", today), today)).otherwise(F.least(F.coalesce("end", "_closing", today), F.when(F.col("end").isNull(), F.lit("9999-12-31").cast("date")).otherwise(today)))
    wrong = F.when(excludes & ((F.col("start") > today) | (shut < F.col("start"))), "INVALID_EXCLUSION_RANGE").when(counts & (F.col("start") > today), "FUTURE_START_DATE").when(counts & (shut < F.col("start")), "END_BEFORE_START")
    return e.select(
        *CASE,
        "type",
        "confidence",
        "start",
        shut.alias("shut"),
        F.when(wrong.isNull(), F.when(counts, "custody").otherwise("excluded")).alias("role"),
        (F.col("type").isin(COUNTING) & F.col("end").isNotNull()).alias("explicit"),
        (counts & F.col("end").isNull() & F.col("_closing").isNull() & wrong.isNull()).alias("uses_today"),
        F.coalesce(wrong, F.when(counts & (F.col("end") > today), "FUTURE_END_DATE")).alias("flag"),
    )


def _spans(events: DataFrame, role: str) -> DataFrame:
    return events.where(F.col("role") == role).select(*CASE, "start", F.col("shut").alias("end"))


def counted(events: DataFrame, cases: DataFrame) -> DataFrame:
    """Merged custody of each case without its exclusions, cut at the case's stop_date (null: not cut)."""
    left = intervals.subtract(_spans(events, "custody"), _spans(events, "excluded"), CASE)
    stops = cases.select(*CASE, "stop_date")
    return left.join(stops, CASE).where("stop_date is null or start <= stop_date").withColumn("end", F.least("end", "stop_date")).drop("stop_date")


def gap_flags(custody: DataFrame, events: DataFrame, scoped: DataFrame) -> DataFrame:
    """Gaps that neither an exclusion inside nor a release from the day before on explains."""
    excluded = _spans(events, "excluded").select(*CASE, F.col("start").alias("s"), F.col("end").alias("t"))
    ends = scoped.where(F.col("type").isin(TERMINATORS)).select(*CASE, F.date_add("start", 1).alias("s"), F.date_add("start", 1).alias("t"))
    ends = ends.unionByName(ends.select(*CASE, F.date_sub("s", 1).alias("s"), F.date_sub("t", 1).alias("t")))
    why = excluded.unionByName(ends)
    gaps = intervals.gaps(custody, CASE)
    same = [gaps[c] == why[c] for c in CASE]
    return gaps.join(why, [*same, why["s"] <= gaps["end"], why["t"] >= gaps["start"]], "left_anti")


def timelines(cases: DataFrame, events: DataFrame, today: Column, threshold: float = 0.8) -> DataFrame:
    """The first of `timelines_and_custody`."""
    return timelines_and_custody(cases, events, today, threshold)[0]


def timelines_and_custody(cases: DataFrame, events: DataFrame, today: Column, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """One row a case, and its custody as merged intervals (person_id, case_id, start, end).

    A row holds custody_days, lenient_days (null without custody in other cases), in_custody, arrest_date,
    arrest_confidence, flags (sorted codes) and n_low, the count of uncertain inputs.

    `cases` are (person_id, case_id, anchor_date, stop_date): lenient days count from the anchor, else from the
    case's first event. Cases without events have 0 days.
    """
    # what several parts read is written once
    scoped = checkpointed(scoped_events(cases, events))
    own = checkpointed(normalised(scoped, today, threshold))
    strict = checkpointed(counted(own, cases))
    days = strict.groupBy(*CASE).agg(F.sum(inclusive_days(F.col("start"), F.col("end"))).alias("custody_days"), F.max((F.col("start") <= today) & (F.col("end") >= today)).alias("in_custody"))

    others = events.where("case_id is not null").select("person_id", F.col("case_id").alias("_of")).distinct()
    torn = cases.select(*CASE).join(others, "person_id").where("_of <> case_id").select(*CASE).distinct()
    wide = normalised(scoped_events(cases.join(torn, CASE, "left_semi"), events, lenient=True), today, threshold)
    anchor = cases.join(scoped.groupBy(*CASE).agg(F.min("start").alias("_first")), CASE, "left").select(*CASE, F.coalesce("anchor_date", "_first").alias("_anchor"))
    lenient = counted(wide, cases).join(anchor, CASE).withColumn("start", F.greatest("start", "_anchor"))
    lenient = torn.join(lenient.groupBy(*CASE).agg(F.sum(inclusive_days(F.col("start"), F.col("end"))).alias("lenient_days")), CASE, "left").select(*CASE, F.coalesce("lenient_days", F.lit(0)).alias("lenient_days"))

    overlap = own.where("role = 'excluded'").alias("x").join(own.where("role = 'custody' and explicit").alias("c"), [F.col(f"x.{k}") == F.col(f"c.{k}") for k in CASE] + [F.col("x.start") <= F.col("c.shut"), F.col("x.shut") >= F.col("c.start")], "left_semi")
    marks = own.where("flag is not null").select(*CASE, "flag")
    marks = marks.unionByName(own.where("uses_today").select(*CASE, F.lit("CURRENT_CUSTODY_USES_TODAY").alias("flag")))
    marks = marks.unionByName(overlap.select(*CASE, F.lit("CUSTODY_EXCLUSION_OVERLAP").alias("flag")))
    marks = marks.unionByName(gap_flags(strict, own, scoped).select(*CASE, F.lit("UNEXPLAINED_GAP").alias("flag")))
    marks = marks.distinct().groupBy(*CASE).agg(F.array_sort(F.collect_set("flag")).alias("_marks"))
    low = own.groupBy(*CASE).agg(F.count_if(F.col("flag").isin("FUTURE_START_DATE", "END_BEFORE_START", "INVALID_EXCLUSION_RANGE") | ((F.col("role") == "custody") & (F.col("confidence") < threshold))).alias("_low"))

    out = cases.select(*CASE, "stop_date").join(days, CASE, "left").join(lenient, CASE, "left").join(arrests(scoped, threshold), CASE, "left").join(marks, CASE, "left").join(low, CASE, "left")
    out = out.withColumn("custody_days", F.coalesce("custody_days", F.lit(0)))
    more = F.array_compact(
        F.array(
            F.when(F.col("arrest_conflict"), "CONFLICTING_ARREST_DATES"),
            F.when(F.col("stop_date").isNotNull(), "CONVICTED"),
            F.when(F.col("lenient_days") != F.col("custody_days"), "CUSTODY_IN_OTHER_CASE"),
        )
    )
    n_low = F.coalesce("_low", F.lit(0)) + F.coalesce((F.col("arrest_confidence") < threshold).cast("int"), F.lit(0)) + F.coalesce(F.col("primary_conflict").cast("int"), F.lit(0))
    rows = out.select(
        *CASE,
        "custody_days",
        "lenient_days",
        F.coalesce("in_custody", F.lit(False)).alias("in_custody"),
        "arrest_date",
        "arrest_confidence",
        F.array_sort(F.concat(F.coalesce("_marks", F.array().cast("array<string>")), more)).alias("flags"),
        n_low.alias("n_low"),
    )
    return rows, strict


def delay_days(hearings: DataFrame, custody: DataFrame, keys: list[str], threshold: float = 0.8) -> DataFrame:
    """(keys, accused_days, uncertain_days, flags, n_needs) from hearings (date, next_date, attribution, confidence,
    verified) and custody intervals.

    Days count as a set, so repeated or overlapping adjournments take a day once; what the accused caused isn't also
    uncertain. A next date that isn't later makes a hearing void.
    """
    h = hearings.groupBy(*keys, "date", "next_date", "attribution").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.max("verified").alias("verified"))
    void = F.col("next_date") <= F.col("date")
    span = lambda who: h.where(who & (F.col("next_date") > F.col("date"))).select(*keys, F.col("date").alias("start"), F.date_sub("next_date", 1).alias("end"))
    accused = span(F.col("attribution") == "accused")
    unclear = intervals.subtract(span(F.col("attribution").isin("unknown", "both")), accused, keys)
    one = intervals.overlap_days(accused, custody, keys).withColumnRenamed("overlap", "accused_days")
    two = intervals.overlap_days(unclear, custody, keys).withColumnRenamed("overlap", "uncertain_days")
    sides = h.where("attribution <> 'unknown'").groupBy(*keys, "date").agg(F.count_distinct("attribution").alias("_n"), F.max(F.col("attribution") == "accused").alias("_a")).where("_n > 1")
    sides = sides.groupBy(*keys).agg(F.count(F.lit(1)).alias("_torn"), F.count_if("_a").alias("_torn_accused"))
    is_accused = F.col("attribution") == "accused"
    unsure = is_accused & (F.col("next_date") > F.col("date")) & ~F.col("verified") & (F.col("confidence") < threshold)
    seen = h.groupBy(*keys).agg(
        F.max(F.col("n") > 1).alias("_twice"),
        F.max(void).alias("_void"),
        F.max(is_accused & F.col("next_date").isNull()).alias("_endless"),
        F.max(F.col("attribution").isin("unknown", "both") & ~F.coalesce(void, F.lit(False))).alias("_unclear"),
        (F.count_if(is_accused & void) + F.count_if(unsure)).alias("_needs"),
    )
    out = seen.join(one, keys, "left").join(two, keys, "left").join(sides, keys, "left")
    marks = F.array_compact(
        F.array(
            F.when(F.col("_endless"), "ACCUSED_DELAY_NO_NEXT_DATE"),
            F.when(F.col("_unclear"), "DELAY_ATTRIBUTION_UNCERTAIN"),
            F.when(F.col("_twice"), "DUPLICATE_HEARING"),
            F.when(F.col("_torn") > 0, "HEARING_ATTRIBUTION_CONFLICT"),
            F.when(F.col("_void"), "HEARING_DATES_INVALID"),
        )
    )
    return out.select(*keys, F.coalesce("accused_days", F.lit(0)).cast("long").alias("accused_days"), F.coalesce("uncertain_days", F.lit(0)).cast("long").alias("uncertain_days"), marks.alias("flags"), (F.col("_needs") + F.coalesce("_torn_accused", F.lit(0))).alias("n_needs"))
