"""Records against what documents say: conflicts, unsupported values, the best fact of a field, expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.sources.scratch import checkpointed

#: How a reading contradicts the record, by field: any other date, or only an earlier one.
EARLIER = ["remand_date", "arrest_datetime"]


def usable(facts: DataFrame) -> DataFrame:
    """Facts that weren't rejected; those of a held document only once a reviewer has confirmed or corrected them."""
    held = F.exists("notes", lambda n: F.startswith(n, F.lit("UNVERIFIED_DOCUMENT")))
    return facts.where(F.col("review_status") != "rejected").where(F.col("review_status").isin("confirmed", "corrected") | ~F.coalesce(held, F.lit(False)))


def conflicts(facts: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Facts (keys, field, value, alternatives) that contradict the recorded value (keys, field, recorded), with
    `conflict`: MISSING, EARLIER or DIFFERS. The first reading governs; another one clears only if it fits exactly."""
    j = facts.join(recorded, [*keys, "field"], "left")
    cleared = F.array_contains(F.coalesce("alternatives", F.array().cast("array<date>")), F.col("recorded"))
    early = F.col("field").isin(EARLIER)
    kind = (
        F.when(F.col("value").isNull(), None)
        .when(F.col("recorded").isNull(), "MISSING")
        .when(cleared, None)
        .when(early & (F.col("value") < F.col("recorded")), "EARLIER")
        .when(~early & (F.col("value") != F.col("recorded")), "DIFFERS")
    )
    return j.withColumn("conflict", kind).where("conflict is not null")


def unsupported(entries: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Entries for which no fact with the same key and value exists."""
    return entries.join(facts.select(*on), on, "left_anti")


def best(facts: DataFrame, keys: list[str], reviewed: Column, confidence: Column, tie: Column) -> DataFrame:
    """One fact for each key: reviewed ones first, then by confidence, then the least tie. One partial aggregate."""
    rank = F.struct((~reviewed).alias("r"), (-confidence).alias("c"), tie.alias("t"))
    rest = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_x")).select(*keys, "_x.*")


def expectations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, broken, n): rows that break each rule or leave it open, all rules in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"r{k}") for k, c in enumerate(rules.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{k}").alias("broken"), F.col("n").alias("n")) for k, name in enumerate(rules)])).alias("x")).select("x.*")


def visible(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """All conditions that are given, at once: dynamic filters that reach the scan as one predicate."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


# What ends or suspends custody, and fields whose conflicts block a decision.
OUTSIDE = ["released", "escaped", "on_bail", "absconding"]
BLOCKING = ["charge_sheet_date", "remand_date", "arrest_datetime", "release_date"]


def _within(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """(fact_id) of points (fact_id, keys, x) that lie in a span (keys, start, end) with start <= x < end (null: open).

    A point lies in a span if the latest end of all spans that have begun by then is behind it: a running maximum over
    both sides by date, not a range join."""
    far = F.lit("9999-12-31").cast("date")
    both = points.select(*keys, F.col("x").alias("at"), F.lit(None).cast("date").alias("end"), "fact_id").unionByName(spans.select(*keys, F.col("start").alias("at"), F.coalesce("end", far).alias("end"), F.lit(None).cast(points.schema["fact_id"].dataType).alias("fact_id")))
    begun = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("reach", F.max("end").over(begun)).where("fact_id is not null and reach > at").select("fact_id").distinct()


def field_conflicts(facts: DataFrame, cases: DataFrame, custody: DataFrame, hearings: DataFrame) -> DataFrame:
    """(fact_id, case_id, field, conflict, blocking): what seven fields read from documents say against the record.

    facts (fact_id, person_id, case_id, field, value, alternative): `alternative` is the other reading of an ambiguous,
    unreviewed date. The first reading governs; the other one clears a conflict only if it fits the record exactly.
    cases (case_id, person_id, charge_sheet_date, first_remand_date, offence_date); custody (person_id, case_id, type,
    start, end), a null case belonging to all of the person's; hearings (case_id, date). A fact without a case belongs
    to its person's only case; without that, or without a date, it says nothing.

    A charge sheet or remand that the record lacks is MISSING, a charge sheet or offence of another date DIFFERS, a
    remand before the first recorded one or an arrest before all custody is EARLIER, a release that isn't recorded while
    custody goes on CONTINUES, a transfer or a hearing that the record (if it has hearings) lacks is UNRECORDED.
    """
    only = cases.groupBy("person_id").agg(F.count(F.lit(1)).alias("_n"), F.min("case_id").alias("_only")).where("_n = 1")
    f = facts.where("value is not null").join(only, "person_id", "left").withColumn("case_id", F.coalesce("case_id", "_only")).drop("_n", "_only")
    f = checkpointed(f.join(cases.drop("person_id"), "case_id"))  # every rule reads it
    value, other = F.col("value"), F.col("alternative")

    # against dates of the case itself
    recorded = F.when(F.col("field") == "charge_sheet_date", F.col("charge_sheet_date")).when(F.col("field") == "remand_date", F.col("first_remand_date")).when(F.col("field") == "offence_datetime", F.col("offence_date"))
    off = F.when(F.col("field") == "remand_date", value < recorded).otherwise(value != recorded)
    kind = F.when(recorded.isNull(), F.when(F.col("field") != "offence_datetime", "MISSING")).when(off & ~other.eqNullSafe(recorded), F.when(F.col("field") == "remand_date", "EARLIER").otherwise("DIFFERS"))
    own = f.where(F.col("field").isin("charge_sheet_date", "remand_date", "offence_datetime")).withColumn("conflict", kind)

    # arrests against the nearest start of custody: the first one of the case, or of no case
    starts = custody.select("person_id", F.col("case_id").alias("_case"), "start")
    first = starts.groupBy("person_id", "_case").agg(F.min("start").alias("first"))
    arrest = f.where("field = 'arrest_datetime'")
    named, anyone = first.where("_case is not null").select("person_id", F.col("_case").alias("case_id"), "first"), first.where("_case is null").select("person_id", F.col("first").alias("first_any"))
    arrest = arrest.join(named, ["person_id", "case_id"], "left").join(anyone, "person_id", "left").where(value < F.least("first", "first_any"))
    fits = starts.select("person_id", "_case", F.col("start").alias("alternative"))
    clear = arrest.select("fact_id", "person_id", "case_id", "alternative").join(fits, ["person_id", "alternative"]).where("_case is null or _case = case_id").select("fact_id")
    arrest = arrest.join(clear, "fact_id", "left_anti").withColumn("conflict", F.lit("EARLIER"))

    # releases while custody goes on
    release = f.where("field = 'release_date'")
    ends = custody.where(F.col("type").isin("released", "escaped")).select("person_id", F.col("start").alias("x")).distinct()
    said = release.select("fact_id", "person_id", F.explode(F.array_compact(F.array("value", "alternative"))).alias("x"))
    release = release.join(said.join(ends, ["person_id", "x"]).select("fact_id"), "fact_id", "left_anti")
    inside = custody.where(~F.col("type").isin(OUTSIDE))
    points = release.select("fact_id", "person_id", "case_id", value.alias("x"))
    held = _within(points, inside.where("case_id is not null"), ["person_id", "case_id"]).unionByName(_within(points, inside.where("case_id is null"), ["person_id"])).distinct()
    release = release.join(held, "fact_id", "left_semi").withColumn("conflict", F.lit("CONTINUES"))

    # transfers and hearings that nobody recorded
    moves = custody.where("type = 'transfer'").select("person_id", F.col("start").alias("value"))
    moved = f.where("field = 'transfer_date'").join(moves, ["person_id", "value"], "left_anti")
    heard = f.where("field = 'hearing'").join(hearings.select("case_id").distinct(), "case_id", "left_semi")
    listed = hearings.select("case_id", F.col("date").alias("x")).distinct()
    known = heard.select("fact_id", "case_id", F.explode(F.array_compact(F.array("value", "alternative"))).alias("x")).join(listed, ["case_id", "x"]).select("fact_id")
    absent = moved.select(*f.columns).unionByName(heard.join(known, "fact_id", "left_anti").select(*f.columns)).withColumn("conflict", F.lit("UNRECORDED"))

    columns = ["fact_id", "case_id", "field", "conflict"]
    out = own.where("conflict is not null").select(columns).unionByName(arrest.select(columns)).unionByName(release.select(columns)).unionByName(absent.select(columns))
    return out.withColumn("blocking", F.col("field").isin(BLOCKING))
