"""Punishing law of charges: records, mapping between codes, verification overlay, maxima of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.rules import derived_term, flags

# The old and the new code.
OLD, NEW = "IPC", "BNS"


def overlaid(records: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """`records` with the `verified` and `verified_by` of the overlay (key, verified, verified_by) where it has them."""
    o = overlay.select(F.col(key).alias("_key"), F.col("verified").alias("_verified"), F.col("verified_by").alias("_by"))
    own = F.col("verified_by") if "verified_by" in records.columns else F.lit(None).cast("string")
    j = records.join(o, records[key] == F.col("_key"), "left")
    return j.withColumn("verified_by", F.when(F.col("_key").isNotNull(), F.col("_by")).otherwise(own)).withColumn("verified", F.coalesce("_verified", "verified")).drop("_key", "_verified", "_by")


def active(charges: DataFrame, on: Column) -> DataFrame:
    """Charges that aren't dropped on a day."""
    return charges.where(F.col("dropped_on").isNull() | (F.col("dropped_on") > on))


def governed(charges: DataFrame, records: DataFrame, mapping: DataFrame, cutoff: Column) -> DataFrame:
    """`charges` with the record that governs punishment (act_of, section_of and the record's columns) and law_flags.

    Charges need act, section, modifier, offence_date and aggravated; records act, section, kind, max_kind, max_months,
    aggravated_kind, aggravated_months, min_months, special_law, period_days and verified; mapping (old, new, verified).
    An offence before the cutoff is punished by the old code, from it on by the new one, whichever was charged; the
    other code's section is used only if the mapping names just one. Other acts stand for themselves.
    """
    sides = mapping.select(F.lit(OLD).alias("m_act"), F.col("old").alias("m_section"), F.col("new").alias("target"), "verified").unionByName(
        mapping.select(F.lit(NEW).alias("m_act"), F.col("new").alias("m_section"), F.col("old").alias("target"), "verified")
    )
    one = sides.groupBy("m_act", "m_section").agg(F.count_distinct("target").alias("m_n"), F.min("target").alias("m_target"), F.min("verified").alias("m_verified"))
    core = F.col("act").isin(OLD, NEW)
    law = F.when(~core | F.col("offence_date").isNull(), F.col("act")).when(F.col("offence_date") < cutoff, OLD).otherwise(NEW)
    c = charges.withColumn("act_of", law).withColumn("_other", F.col("act_of") != F.col("act"))
    c = c.join(one, (c["act"] == one["m_act"]) & (c["section"] == one["m_section"]), "left")
    c = c.withColumn("section_of", F.when(~F.col("_other"), F.col("section")).when(F.col("m_n") == 1, F.col("m_target")))
    r = records.select(F.col("act").alias("r_act"), F.col("section").alias("r_section"), *[c for c in records.columns if c not in ("act", "section")])
    j = c.join(r, (c["act_of"] == r["r_act"]) & (c["section_of"] == r["r_section"]), "left")
    found, unclear = F.col("r_act").isNotNull(), F.col("_other") & (F.coalesce("m_n", F.lit(0)) != 1)
    marks = flags(
        (core & F.col("offence_date").isNull(), "OFFENCE_DATE_UNKNOWN"),
        (F.col("_other"), "IPC_BNS_TRANSITION_MISMATCH"),
        (unclear, "MAPPING_AMBIGUOUS_OR_MISSING"),
        (~found & ~unclear, "UNKNOWN_SECTION"),
        (F.col("_other") & found & ~F.col("m_verified"), "UNVERIFIED_MAPPING"),
        (~found, "NO_RECORD"),
        (found & (F.col("kind") == "liability_rule"), "LIABILITY_RULE_ONLY"),
    )
    harder = F.col("aggravated") & F.col("aggravated_kind").isNotNull()
    term = derived_term(F.when(harder, F.col("aggravated_kind")).otherwise(F.col("max_kind")), F.when(harder, F.col("aggravated_months")).otherwise(F.col("max_months")), F.col("modifier"))
    j = j.withColumn("law_flags", marks).withColumn("term", F.when(found & (F.col("kind") != "liability_rule"), term))
    return j.withColumn("record_key", F.when(found, F.concat_ws(":", "act_of", "section_of"))).drop("_other", "m_act", "m_section", "m_n", "m_target", "m_verified", "r_act", "r_section")


def maxima(law: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """One row a case: the gravest term and its record's minimum and period, counts, and n_law, the uncertain inputs.

    Liability rules have no maximum of their own; of equal terms the charge with the smallest ordinal counts. A charge
    without a record has no known maximum, so it is never taken for a fine: it asks for review instead.
    """
    known, liable = F.col("term").isNotNull(), F.array_contains("law_flags", "LIABILITY_RULE_ONLY")
    severity = F.struct(F.element_at(F.create_map(*[F.lit(x) for x in ("none", 0, "term", 1, "life", 2, "death", 3)]), F.col("term.kind")).alias("r"), F.when(F.col("term.kind") == "term", F.col("term.months")).otherwise(0).alias("m"), (-F.col("ordinal")).alias("o"))
    top = F.max(F.when(known, F.struct(severity.alias("s"), F.col("term.kind").alias("kind"), F.col("term.months").alias("months"), "min_months", "period_days", "record_key")))
    missing = ~known & ~liable
    return law.groupBy(*keys).agg(
        top.alias("_top"),
        F.count_if(known).alias("n_charges"),
        F.count_if(missing).alias("n_unknown"),
        F.count_distinct(F.when(known, F.col("record_key"))).alias("n_offences"),
        F.coalesce(F.min(F.when(known, F.col("term.kind") == "none")), F.lit(False)).alias("all_fine_only"),
        F.coalesce(F.max(F.when(known, F.col("special_law"))), F.lit(False)).alias("special_law"),
        (F.count_if(~liable & (F.col("confidence") < threshold)) + F.count_if(missing) + F.count_if(known & ~F.col("verified"))).alias("n_law"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(~liable, F.col("law_flags")))))).alias("law_flags"),
    ).select(*keys, F.col("_top.kind").alias("term_kind"), F.when(F.col("_top.kind") == "term", F.col("_top.months")).alias("term_months"), "_top.min_months", "_top.period_days", "_top.record_key", "n_charges", "n_unknown", "n_offences", "all_fine_only", "special_law", "n_law", "law_flags")
