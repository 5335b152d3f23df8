"""Ordered decision tables with their flags: effective maxima, default bail, case status, roll-up.

Each table is one CASE over a wide row: the order of the branches is the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.dates import ceil_threshold
from tidewright.functions.scores import rank_of

# Statuses, most urgent first.
URGENCY = [
    "CRITICAL_ACQUITTED_DETAINED",
    "CRITICAL_MUST_RELEASE",
    "URGENT_DEFAULT_BAIL",
    "CRITICAL_BAIL_NOT_FURNISHED",
    "ELIGIBLE",
    "REVIEW_MULTIPLE_CASES",
    "REVIEW",
    "NOT_YET",
    "EXCLUDED_479",
    "NOT_APPLICABLE",
]


def flags(*pairs: tuple[Column, str]) -> Column:
    """Codes whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, code) for c, code in pairs]))


def default_bail(cases: DataFrame, today: Column, short: int = 60, long: int = 90, long_from_months: int = 120, warn_days: int = 7) -> DataFrame:
    """`cases` with `default_bail`, an outcome code or null, and `accrual`.

    Needs first_remand_date, charge_sheet_date, default_bail_application_date (dates), status, term_kind (term, life,
    death, none or null), term_months, min_months and special_period. A maximum of just the boundary that may be read
    either way gives review wherever the readings differ.
    """
    c = F.col
    severe = c("term_kind").isin("life", "death")
    is_long = severe | ((c("term_kind") == "term") & (c("term_months") >= long_from_months))
    period = F.greatest(F.when(is_long, long).otherwise(short), F.coalesce(c("special_period"), F.lit(0)))
    accrual, other = F.date_add("first_remand_date", period), F.date_add("first_remand_date", short)
    cs, app = c("charge_sheet_date"), c("default_bail_application_date")
    boundary = (c("term_kind") == "term") & (c("term_months") == long_from_months) & (F.coalesce(c("min_months"), F.lit(0)) < long_from_months) & (period != short)
    unclear = boundary & F.when(cs.isNull(), (other <= today) & (today < accrual)).otherwise((other <= cs) & (cs < accrual))
    outcome = (
        F.when(c("first_remand_date").isNull(), F.when(cs.isNull() & (c("status") == "investigation"), "DEFAULT_BAIL_REVIEW"))
        .when(c("term_kind").isNull(), None)
        .when(cs < c("first_remand_date"), "DEFAULT_BAIL_REVIEW")
        .when(unclear, "DEFAULT_BAIL_REVIEW")
        .when(cs.isNull() & (today >= accrual), F.when(app >= accrual, "DEFAULT_BAIL_RIGHT_ASSERTED").otherwise("URGENT_DEFAULT_BAIL"))
        .when(cs.isNull(), F.when(F.date_diff(accrual, today) <= warn_days, "DEFAULT_BAIL_WINDOW_SOON"))
        .when(cs < accrual, None)
        .when((app >= accrual) & (app < cs), "DEFAULT_BAIL_RIGHT_ASSERTED")
        .when(app == cs, "DEFAULT_BAIL_REVIEW")
        .when(app < accrual, "DEFAULT_BAIL_REVIEW")
        .otherwise("DEFAULT_BAIL_RIGHT_LOST")
    )
    return cases.withColumn("accrual", F.when(c("term_kind").isNotNull(), accrual)).withColumn("default_bail", outcome)


def case_status(cases: DataFrame) -> DataFrame:
    """`cases` with threshold_days, max_days, status_out, days_overdue and flags.

    Needs status, in_custody, detained_after_end, n_other_pending, n_charges, n_offences, all_fine_only, special_law,
    term_kind, term_months, first_offender, counted_days, lenient_days (null: the same) and n_needs, the count of
    uncertain inputs, which turn gated outcomes into REVIEW; with a column n_low, those of the custody record alone, these
    hold for people who seem to be out of custody as well.
    """
    c = F.col
    max_days = F.when(c("term_kind") == "term", ceil_threshold(c("term_months")))
    third, half = ceil_threshold(c("term_months"), 1, 3), ceil_threshold(c("term_months"), 1, 2)
    df = cases.withColumn("max_days", max_days).withColumn("threshold_days", F.when(c("term_kind") == "term", F.when(c("first_offender"), third).otherwise(half)))
    reached = c("counted_days") >= c("threshold_days")
    flips = c("lenient_days").isNotNull() & ((c("lenient_days") >= c("threshold_days")) != reached)
    gate = lambda s: F.when(c("n_needs") > 0, "REVIEW").otherwise(s)
    out = (
        F.when(c("status") == "convicted", "NOT_APPLICABLE")
        .when(c("status").isin("acquitted", "discharged", "disposed"), F.when(c("detained_after_end") & (c("n_other_pending") == 0), "CRITICAL_ACQUITTED_DETAINED").otherwise("NOT_APPLICABLE"))
        .when(~c("in_custody"), F.when(c("n_low") > 0, "REVIEW").otherwise("NOT_APPLICABLE") if "n_low" in cases.columns else F.lit("NOT_APPLICABLE"))
        .when(c("n_charges") == 0, "REVIEW")
        .when(c("term_kind").isin("life", "death"), gate("EXCLUDED_479"))
        .when(c("all_fine_only"), "REVIEW")
        .when(c("counted_days") >= c("max_days"), "CRITICAL_MUST_RELEASE")
        .when(c("special_law"), "REVIEW")
        .when(c("n_other_pending") > 0, "REVIEW_MULTIPLE_CASES")
        .when(c("n_offences") > 1, "REVIEW")
        .when(flips, "REVIEW")
        .when(reached, gate("ELIGIBLE"))
        .otherwise(gate("NOT_YET"))
    )
    marks = flags(
        (c("all_fine_only"), "UNUSUAL_DETENTION_FINE_ONLY"),
        (c("special_law"), "SPECIAL_LAW"),
        (c("n_offences") > 1, "MULTIPLE_OFFENCES"),
        (F.abs(c("counted_days") - c("threshold_days")) <= 2, "BORDERLINE"),
    )
    overdue = F.when(F.col("status_out") == "CRITICAL_MUST_RELEASE", c("counted_days") - c("max_days")).when(reached & F.col("status_out").isin("ELIGIBLE", "REVIEW", "REVIEW_MULTIPLE_CASES"), c("counted_days") - c("threshold_days"))
    return df.withColumn("status_out", out).withColumn("flags", marks).withColumn("days_overdue", overdue)


def most_serious(charges: DataFrame, key: str) -> DataFrame:
    """(key, term_kind, term_months, n_charges, n_offences): the gravest term, the first charge of equals."""
    severity = F.struct(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("none", 0, "term", 1, "life", 2, "death", 3)]), F.col("term_kind")), F.lit(-1)).alias("r"), F.coalesce("term_months", F.lit(0)).alias("m"), (-F.col("ordinal")).alias("o"))
    return charges.groupBy(key).agg(
        F.max_by("term_kind", severity).alias("term_kind"),
        F.max_by("term_months", severity).alias("term_months"),
        F.count(F.lit(1)).alias("n_charges"),
        F.count_distinct("offence").alias("n_offences"),
    )


def roll_up(results: DataFrame, key: str) -> DataFrame:
    """A person's most urgent status, longest overdue and number of cases."""
    return results.groupBy(key).agg(F.min_by("status_out", rank_of(F.col("status_out"), URGENCY)).alias("status"), F.max("days_overdue").alias("days_overdue"), F.count(F.lit(1)).alias("n_cases"))


# What a companion provision makes of a maximum: numerator, denominator of the term.
FRACTIONS = {"attempt": (1, 2), "abetment": (1, 1), "abetment_not_committed": (1, 4), "common_intention": (1, 1)}


def derived_term(kind: Column, months: Column, modifier: Column, life_years: int = 20, not_committed_years: int = 7, serious_years: int = 2, otherwise_months: int = 6) -> Column:
    """struct(kind, months) of an offence's maximum under a modifier (null: as it is).

    A fraction is rounded up to whole months; life counts as so many years for fractions; conspiracy to a serious
    offence is punished like it, else with a short term; a fine-only offence stays one.
    """
    grave = kind.isin("life", "death")
    life = F.lit(life_years * 12)
    part = F.coalesce(*[F.when(modifier == m, F.ceil(F.when(grave, life).otherwise(months) * n / d)) for m, (n, d) in FRACTIONS.items() if n < d]).cast("int")
    term = lambda m: F.struct(F.lit("term").alias("kind"), m.cast("int").alias("months"))
    same = F.struct(kind.alias("kind"), months.cast("int").alias("months"))
    return (
        F.when((kind == "none") | modifier.isNull(), same)
        .when(modifier == "conspiracy", F.when(grave | (months >= serious_years * 12), same).otherwise(term(F.lit(otherwise_months))))
        .when((modifier == "abetment_not_committed") & grave, term(F.lit(not_committed_years * 12)))
        .when(part.isNotNull(), term(part))
        .otherwise(same)
    )
