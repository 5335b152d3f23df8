"""Decision of a case from its records: custody and delays, law and priors, status, findings, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions.dates import ceil_threshold, inclusive_days
from tidewright.functions.scores import rank_of
from tidewright.operators import intervals, law, rules, timeline
from tidewright.operators.timeline import CASE
from tidewright.sources.scratch import checkpointed

# Statuses under which a case is pending, and under which it has ended without a conviction.
PENDING = ["investigation", "charge_sheet_filed", "trial"]
ENDED = ["acquitted", "discharged", "disposed"]
# Prior convictions that count against a first offence.
COUNTED_PRIORS = ["final", "under_appeal"]


def reassessed(cases: DataFrame, convictions: DataFrame) -> DataFrame:
    """`cases` with status_now, in which a conviction that was set aside is a pending trial, and set_aside."""
    gone = convictions.where("status = 'set_aside'").select(F.col("person_id").alias("_p"), F.col("case_id").alias("_c")).distinct()
    j = cases.join(gone, (cases["person_id"] == F.col("_p")) & (cases["case_id"] == F.col("_c")), "left")
    aside = F.col("_c").isNotNull() & (F.col("status") == "convicted")
    return j.withColumn("set_aside", aside).withColumn("status_now", F.when(aside, "trial").otherwise(F.col("status"))).drop("_p", "_c")


def first_offenders(cases: DataFrame, convictions: DataFrame, juvenile_counts: bool = False) -> DataFrame:
    """(person_id, case_id, first_offender, prior_flags): whether no conviction in another case counts."""
    v = convictions.select("person_id", F.col("case_id").alias("_of"), F.col("status").alias("_status"))
    j = cases.select(*CASE).join(v, "person_id", "left").where("_of is null or _of <> case_id or _status is null")
    counts = F.col("_status").isin(COUNTED_PRIORS) | (F.lit(juvenile_counts) & (F.col("_status") == "juvenile"))
    mine = cases.select(*CASE).join(j.groupBy(*CASE).agg(F.count_if(counts).alias("n"), F.count_if(F.col("_status") == "juvenile").alias("j"), F.count_if(F.col("_status") == "under_appeal").alias("a")), CASE, "left")
    return mine.select(*CASE, (F.coalesce("n", F.lit(0)) == 0).alias("first_offender"), rules.flags((F.col("j") > 0, "JUVENILE_ADJUDICATION"), (F.col("a") > 0, "PRIOR_CONVICTION_UNDER_APPEAL")).alias("prior_flags"))


def reached_on(custody: DataFrame, excluded: DataFrame, targets: DataFrame, target: str) -> DataFrame:
    """(person_id, case_id, reached): the day on which the counted days of a case come to its target; the first day of
    custody for a target of 0 or less, null if there are too few."""
    left = intervals.subtract(custody, excluded, CASE).withColumn("_n", inclusive_days(F.col("start"), F.col("end")))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*CASE).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = left.withColumn("_before", before).join(targets.select(*CASE, F.col(target).alias("_target")), CASE)
    hit = F.when(F.col("_target") <= 0, F.col("start")).when((F.col("_before") < F.col("_target")) & (F.col("_before") + F.col("_n") >= F.col("_target")), F.date_add("start", (F.col("_target") - F.col("_before") - 1).cast("int")))
    return j.groupBy(*CASE).agg(F.min(hit).alias("reached"))


def decide(cases: DataFrame, events: DataFrame, hearings: DataFrame, charges: DataFrame, records: DataFrame, mapping: DataFrame, convictions: DataFrame, today: Column, cutoff: Column, threshold: float = 0.8, surety_days: int = 7) -> DataFrame:
    """One row a case: days, limits, status_out, findings, urgency, eligible_from, projected and decision_flags.

    Everything joins on person and case: custody events become intervals, adjournments are cut out, active charges get
    their governing law and maximum, priors the fraction, and the ordered table in `rules` decides. Uncertain inputs turn
    gated outcomes into REVIEW; findings (default bail, bail without release, time served) stand beside the status of
    cases that are pending in custody.
    """
    c = reassessed(cases, convictions).withColumn("stop_date", F.when(F.col("status_now") == "convicted", F.col("conviction_date")))
    pending = F.col("status_now").isin(PENDING).cast("int")
    c = checkpointed(c.withColumn("n_other_pending", F.sum(pending).over(Window.partitionBy("person_id")) - pending))
    span = c.select(*CASE, "anchor_date", "stop_date")
    days, custody = timeline.timelines_and_custody(span, events, today, threshold)
    days = checkpointed(days.withColumnRenamed("flags", "timeline_flags"))
    delays = timeline.delay_days(hearings, custody, CASE, threshold).select(*CASE, "accused_days", "uncertain_days", F.col("n_needs").alias("n_delay"))
    known = law.maxima(law.governed(law.active(charges, today), records, mapping, cutoff), CASE, threshold)
    held = custody.join(c.select(*CASE, "acquittal_date", F.date_add("bail_granted_date", surety_days).alias("_check")), CASE).groupBy(*CASE).agg(
        F.coalesce(F.sum(F.when(F.col("end") > F.col("acquittal_date"), inclusive_days(F.greatest("start", F.date_add("acquittal_date", 1)), F.col("end")))), F.lit(0)).alias("days_after_end"),
        F.max((F.col("_check") <= today) & (F.col("start") <= F.col("_check")) & (F.col("end") >= F.col("_check"))).alias("_held"),
    )
    w = c.join(days, CASE, "left")
    for other in (delays, known, held, first_offenders(c, convictions)):
        w = w.join(checkpointed(other), CASE, "left")
    zero = lambda *names: {n: F.coalesce(n, F.lit(0)) for n in names}
    w = w.withColumns(zero("accused_days", "uncertain_days", "n_delay", "n_charges", "n_unknown", "n_offences", "n_law", "days_after_end"))
    w = w.withColumns({n: F.coalesce(n, F.lit(False)) for n in ("all_fine_only", "special_law", "_held")})
    counted = F.greatest(F.col("custody_days") - F.col("accused_days"), F.lit(0))
    needs = F.col("n_low") + F.col("n_delay") + F.col("n_law") + (F.col("status_confidence") < threshold).cast("int")
    w = w.withColumn("counted_days", counted).withColumn("n_needs", needs).withColumn("detained_after_end", F.col("days_after_end") > 0)
    w = w.withColumn("lenient_days", F.col("lenient_days") - F.col("accused_days")).withColumn("special_period", F.col("period_days"))
    w = rules.default_bail(w, today)
    w = rules.case_status(w.withColumn("status_recorded", F.col("status")).withColumn("status", F.col("status_now")))
    live = F.col("status").isin(PENDING) & F.col("in_custody")
    half = ceil_threshold(F.col("term_months"))
    served = (
        F.when(F.col("min_months").isNotNull() & (F.col("counted_days") >= ceil_threshold(F.col("min_months"))), "TIME_SERVED_EXCEEDS_MINIMUM")
        .when((F.col("term_kind") == "term") & (F.col("counted_days") * 2 >= half), "TIME_SERVED_SUBSTANTIAL")
    )
    w = w.withColumn("findings", F.when(live, F.array_compact(F.array("default_bail", F.when(F.col("_held"), "CRITICAL_BAIL_NOT_FURNISHED"), served))).otherwise(F.array().cast("array<string>")))
    rank = lambda code: F.struct(rank_of(code, rules.URGENCY).alias("r"), code.alias("code"))
    w = w.withColumn("urgency", F.array_min(F.transform(F.concat(F.array("status_out"), "findings"), rank))["code"])
    # days that the accused's adjournments took from custody no longer count
    accused = hearings.where("attribution = 'accused' and next_date > date").select(*CASE, F.col("date").alias("start"), F.date_sub("next_date", 1).alias("end"))
    released = F.col("status_out") == "CRITICAL_MUST_RELEASE"
    w = checkpointed(w).withColumn("_target", F.when(F.col("days_overdue").isNotNull(), F.when(released, F.col("max_days")).otherwise(F.col("threshold_days"))))
    reached = reached_on(custody, accused, w.where("_target is not null"), "_target").withColumnRenamed("reached", "eligible_from")
    w = w.join(reached, CASE, "left")
    compared = live & (F.col("term_kind") == "term") & ~F.col("all_fine_only") & (F.col("counted_days") < F.col("threshold_days")) & ~F.col("special_law")
    alt = F.greatest(F.col("counted_days") - F.col("uncertain_days"), F.lit(0))
    affects = live & (F.col("term_kind") == "term") & (F.col("uncertain_days") > 0) & (((F.col("counted_days") >= F.col("max_days")) & (alt < F.col("max_days"))) | ((F.col("counted_days") >= F.col("threshold_days")) & (alt < F.col("threshold_days"))))
    ended = F.col("status").isin(ENDED) & F.col("detained_after_end")
    marks = rules.flags(
        (F.col("set_aside"), "CONVICTION_SET_ASIDE_REASSESS"),
        (ended & (F.col("n_other_pending") == 0), "ACQUITTED_BUT_DETAINED"),
        (ended & (F.col("n_other_pending") > 0), "DETAINED_IN_OTHER_CASE"),
        (affects, "DELAY_ATTRIBUTION_AFFECTS_RESULT"),
        (F.col("status_out").isin("CRITICAL_MUST_RELEASE", "CRITICAL_ACQUITTED_DETAINED") & (F.col("n_needs") > 0), "CRITICAL_NEEDS_VERIFICATION"),
    )
    return w.withColumn("projected", F.when(compared, F.date_add(today, (F.col("threshold_days") - F.col("counted_days")).cast("int")))).withColumn("decision_flags", marks)
