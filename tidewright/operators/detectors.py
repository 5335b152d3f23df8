"""Detectors of procedural lapses: conditions over one wide row of facts a case, each with its weight and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scores import insight_rank
from tidewright.operators.consistency import best

# How the record says that nobody independent saw a seizure, who belongs to the police or is a party, how open
# reports and parades are put, to whom a confession was made, and what no step may advise.
UNSEEN = r"(?i)no independent|without (independent|panch)|no panch"
POLICE = r"(?i)\b(HC|PC|ASI|SI|PSI|CPC|WPC|Inspector|Constable|Head Constable|IO|police)\b"
PARTY = r"(?i)complainant|victim|informant|CW-1\b"
OPEN_REPORT = r"(?i)pending|awaited|not (received|sent|obtained)|nil"
NOT_HELD = r"(?i)not held|no|nil"
TO_POLICE = r"(?i)police|investigating officer|\bIO\b|inspector|sub.?inspector"
ABSENT = r"(?i)witness\w* (absent|not present)|summons to be re-?issued|NBW"
FORBIDDEN = r"(?i)contact(ing)? (the )?(witness|victim|complainant)|influenc|pressur|threat(en)? (the )?witness|persuade (the )?(witness|victim)|fabricat|abscond|evade"
WARNING = "do not approach or pressure the victim"

#: Fields that a detector looks at.
FIELDS = [
    "grounds_of_arrest", "arrest_datetime", "production_datetime", "arrest_memo_attested", "relative_informed", "gender", "night_arrest_permission", "woman_officer_present",
    "medical_examination", "remand_reasons", "recovery", "offence_datetime", "fir_datetime", "fir_delay_reason", "charge_sheet_offence_date", "confession", "witnesses", "fsl_status", "tip_status",
]


def wide_facts(facts: DataFrame, key: str) -> DataFrame:
    """One row a case with a struct(value, confidence) for each field: the best fact of it, reviewed ones first.

    `facts` are (key, field, value, confidence, reviewed, fact_id). The fields are named, so the pivot needs no pass of its own.
    """
    one = best(facts.where(F.col("field").isin(FIELDS)), [key, "field"], F.col("reviewed"), F.col("confidence"), F.col("fact_id"))
    return one.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.struct("value", "confidence"))).alias(f) for f in FIELDS])


def _lacking(field: str) -> Column:
    return F.coalesce(F.col(f"{field}.value").isin("no", "not_recorded"), F.lit(False))


def _at(field: str) -> Column:
    """A time if the value has one, else null: "2024-01-05T19:30"."""
    v = F.col(f"{field}.value")
    return F.when(F.contains(v, F.lit("T")), F.try_to_timestamp(F.replace(v, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm")))


def _day(field: str) -> Column:
    return F.try_to_date(F.substring(F.col(f"{field}.value"), 1, 10), "yyyy-MM-dd")


def rules(max_hours: int = 24, fir_days: int = 2) -> list[tuple[str, str, Column, list[str], int, int]]:
    """(code, severity, condition, evidence fields, impact, urgency), in the order in which they are reported."""
    hour = F.hour(_at("arrest_datetime"))
    hours = (F.unix_timestamp(_at("production_datetime")) - F.unix_timestamp(_at("arrest_datetime"))) / 3600
    late = F.date_diff(_day("fir_datetime"), _day("offence_datetime"))
    named = F.filter(F.transform(F.split("witnesses.value", "[;,]"), F.trim), lambda w: w != "")
    free = F.filter(named, lambda w: ~F.rlike(w, F.lit(POLICE)) & ~F.rlike(w, F.lit(PARTY)))
    given = F.coalesce(F.trim("fir_delay_reason.value") != "", F.lit(False))
    return [
        ("GROUNDS_NOT_COMMUNICATED", "high", _lacking("grounds_of_arrest"), ["grounds_of_arrest"], 3, 2),
        ("PRODUCTION_BEYOND_24H", "critical", hours > max_hours, ["arrest_datetime", "production_datetime"], 3, 3),
        ("ARREST_MEMO_DEFECTS", "medium", _lacking("arrest_memo_attested") | _lacking("relative_informed"), ["arrest_memo_attested", "relative_informed"], 1, 1),
        ("WOMAN_ARRESTED_AT_NIGHT", "high", F.startswith(F.lower("gender.value"), F.lit("f")) & ((hour >= 18) | (hour < 6)) & (_lacking("night_arrest_permission") | _lacking("woman_officer_present")), ["arrest_datetime"], 2, 2),
        ("NO_MEDICAL_EXAMINATION", "medium", _lacking("medical_examination"), ["medical_examination"], 1, 1),
        ("MECHANICAL_REMAND", "medium", F.size(F.filter(F.split(F.trim("remand_reasons.value"), r"\s+"), lambda w: w != "")) <= 3, ["remand_reasons"], 2, 1),
        ("SEIZURE_WITHOUT_INDEPENDENT_WITNESS", "high", F.rlike("recovery.value", F.lit(UNSEEN)), ["recovery"], 1, 1),
        ("FIR_DELAY_UNEXPLAINED", "high", (late > fir_days) & ~given, ["offence_datetime", "fir_datetime"], 1, 1),
        ("DATE_CONTRADICTION_FIR_CHARGESHEET", "high", _day("charge_sheet_offence_date") != _day("offence_datetime"), ["offence_datetime", "charge_sheet_offence_date"], 1, 1),
        ("NO_INDEPENDENT_WITNESSES", "medium", (F.size(named) > 0) & (F.size(free) == 0), ["witnesses"], 1, 0),
        ("FSL_PENDING", "medium", F.rlike("fsl_status.value", F.lit(OPEN_REPORT)), ["fsl_status"], 1, 1),
        ("TIP_NOT_HELD", "low", F.rlike("tip_status.value", F.lit(NOT_HELD)), ["tip_status"], 0, 0),
        ("CONFESSION_TO_POLICE", "high", F.rlike("confession.value", F.lit(TO_POLICE)), ["confession"], 1, 1),
    ]


def detect(wide: DataFrame, key: str, table=None) -> DataFrame:
    """(key, code, severity, rank) for every rule that holds. A code without evidence isn't reported: its support is the
    least confidence of the facts it rests on."""
    made = []
    for code, severity, condition, evidence, impact, urgency in table or rules():
        support = F.array_min(F.array_compact(F.array(*[F.col(f"{e}.confidence") for e in evidence])))
        support = support * 0.8 if code == "TIP_NOT_HELD" else support
        made.append(F.when(condition & support.isNotNull(), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), insight_rank(support, F.lit(impact), F.lit(urgency)).alias("rank"))))
    return wide.select(key, F.explode(F.array_compact(F.array(*made))).alias("x")).select(key, "x.*")


def hearing_lapses(hearings: DataFrame, key: str, reason: str, absences: int = 3) -> DataFrame:
    """(key, code, severity, rank) of what the order sheet shows: witnesses absent again and again, or hostile."""
    seen = hearings.groupBy(key).agg(F.count_if(F.rlike(reason, F.lit(ABSENT))).alias("a"), F.count_if(F.rlike(reason, F.lit("(?i)hostile"))).alias("h"))
    made = lambda when, code, support, impact, urgency: F.when(when, F.struct(F.lit(code).alias("code"), F.lit("medium").alias("severity"), insight_rank(F.lit(support), F.lit(impact), F.lit(urgency)).alias("rank")))
    out = F.array(made(F.col("a") >= absences, "PROSECUTION_WITNESSES_ABSENT", 0.85, 2, 1), made(F.col("h") > 0, "WITNESS_HOSTILE", 0.8, 1, 0))
    return seen.select(key, F.explode(F.array_compact(out)).alias("x")).select(key, "x.*")


def release_routes(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, severity, rank) that follow from a decided case (status_out, findings, first_offender, term_kind)."""
    has = lambda code: F.array_contains("findings", code)
    s = F.col("status_out")
    table = [
        ("DETAINED_BEYOND_MAXIMUM", "critical", s == "CRITICAL_MUST_RELEASE", 0.95, 3, 3),
        ("SECTION_479_RELEASE", "high", s == "ELIGIBLE", 0.9, 3, 3),
        ("DEFAULT_BAIL", "critical", has("URGENT_DEFAULT_BAIL"), 0.9, 3, 3),
        ("SURETY_RELIEF", "critical", has("CRITICAL_BAIL_NOT_FURNISHED"), 0.9, 3, 3),
        ("TIME_SERVED", "medium", has("TIME_SERVED_EXCEEDS_MINIMUM") | has("TIME_SERVED_SUBSTANTIAL"), 0.8, 2, 1),
        ("PROBATION_CONSIDERATION", "low", F.col("first_offender") & F.col("term_kind").isNotNull() & ~F.col("term_kind").isin("life", "death"), 0.7, 1, 0),
    ]
    made = [F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), insight_rank(F.lit(support), F.lit(impact), F.lit(urgency)).alias("rank"))) for code, severity, when, support, impact, urgency in table]
    return decisions.select(*keys, F.explode(F.array_compact(F.array(*made))).alias("x")).select(*keys, "x.*")


def missing_ingredients(charges: DataFrame, told: DataFrame, ingredients: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, charge, ingredient, lesser): charges whose essential ingredient the case's text doesn't mention.

    `ingredients` are (charge, ingredient, any_of array, lesser); a case without text says nothing either way.
    """
    j = charges.join(ingredients, "charge").join(told.where(F.trim(text_col) != ""), key)
    mentioned = F.exists("any_of", lambda w: F.contains(F.lower(text_col), F.lower(w)))
    return j.where(~mentioned).select(key, "charge", "ingredient", "lesser").distinct()


def allowed(steps: Column) -> Column:
    """Whether proposed steps advise nothing that is forbidden; the standing warning itself is no advice."""
    return ~F.rlike(F.replace(steps, F.lit(WARNING), F.lit("")), F.lit(FORBIDDEN))
