"""Classes of documents and causes of adjournments, by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.text import once

# Patterns of each class of document, in order of preference.
CLASSES = {
    "fir": ["first information report", r"\bF\.?I\.?R\b", "ಪ್ರಥಮ ಮಾಹಿತಿ ವರದಿ", "प्रथम सूचना रिपोर्ट"],
    "arrest_memo": ["arrest memo", "grounds of arrest", "inspection memo", "ಬಂಧನ ಪಂಚನಾಮೆ"],
    "remand_order": ["order on remand", "remanded to", "ರಿಮಾಂಡ್ ಆದೇಶ", "judicial custody"],
    "charge_sheet": ["charge ?sheet", "final report", "u/s 173", "u/s 193 BNSS", "ದೋಷಾರೋಪಣ ಪಟ್ಟಿ"],
    "court_order": ["order sheet", "call on", "adjourned"],
    "judgment": [r"\bjudgment\b", "point(s)? for (my )?consideration", "in the result", "is hereby acquitted", "is convicted"],
    "bail_order": ["enlarged on bail", "bail (is )?granted", "bail application", "surety"],
    "jail_record": ["jail admission", "UTP No", "prisoner", "ಕಾರಾಗೃಹ ದಾಖಲೆ", "ಕೈದಿ ಸಂಖ್ಯೆ"],
    "medical_record": ["medical examination report", "MLC", "injury certificate", "discharge summary"],
    "release_order": ["release order", "order of release", "released from (the )?(jail|prison|custody)", "set at liberty", "release warrant", "date of release"],
    "transfer_record": ["transfer of (the )?prisoner", "jail transfer", "transfer order", "date of transfer", "transferred to"],
}
# What a document of a class must hold; of each inner list one field suffices.
REQUIRED = {
    "fir": [["fir_number"], ["offence_datetime", "fir_datetime"], ["charge"]],
    "arrest_memo": [["arrest_datetime"], ["person"]],
    "remand_order": [["remand_date", "production_datetime"]],
    "charge_sheet": [["charge_sheet_date"], ["charge"]],
    "court_order": [["hearing"]],
    "jail_record": [["admission_date", "prisoner_number"]],
    "release_order": [["release_date"]],
    "transfer_record": [["transfer_date"]],
}
# Causes of adjournments, the first that matches counts: pattern, who caused it, confidence.
CAUSES = [
    (r"not produced|escort not available|escort not provided|video ?link (not|failed)|jail authorities", "prosecution", 0.95),
    (r"both (sides|counsel|parties)|request of both|joint(ly)? request", "both", 0.93),
    (r"boycott|abstain|strike|bar resolution|no work", "other", 0.93),
    (r"covid|pandemic|lockdown|proceedings suspended", "other", 0.93),
    (r"vacation|presiding officer|\bP\.?O\.? on leave|judge on leave|court (is )?busy|part[- ]heard|time over|ನ್ಯಾಯಾಧೀಶರು ರಜೆ|न्यायाधीश अवकाश", "court", 0.92),
    (r"accused (is )?ill|hospital|medical certificate", "accused", 0.6),
    (r"vakalat|new counsel|counsel changed|change of counsel", "accused", 0.7),
    (r"\bP\.?P\.? (sought|seeks|requested)|prosecution (sought|to file|witness)|witness(es)? (absent|not present)|\bI\.?O\.? (absent|not present)|case diary|fsl|summons|NBW|ಸಾಕ್ಷಿ|ಅಭಿಯೋಜಕ", "prosecution", 0.9),
    (r"(request|instance) of (the )?accused|accused('s)? (counsel )?(sought|seeks|requested)|accused absent|exemption petition|defen[cs]e sought|accused counsel (on leave|absent|not present)|counsel for accused not present|ಆರೋಪಿಯ ಪರ ವಕೀಲರ ಕೋರಿಕೆ", "accused", 0.93),
    (r"(defen[cs]e|accused) counsel (requested|sought)", "accused", 0.9),
    (r"turned hostile|cross[- ]examin|evidence (recorded|closed)|\bP\.?W\.?[- ]?\d+ (examined|deposed)", "other", 0.85),
    (r"^\s*(adjourned\.?)?\s*$", "unknown", 0.9),
]


def document_class(text: Column, classes: dict[str, list[str]] = CLASSES, head: int | None = 3000) -> Column:
    """struct(label, confidence, method) by how many patterns of a class the head of a text matches (None: all
    of it).

    Two or more hits decide if no other class has as many, one only if no other has any; otherwise the first of the best
    classes stands with confidence 0.5, and a text without a hit is unknown.
    """
    start = F.coalesce(text, F.lit("")) if head is None else F.substring(F.coalesce(text, F.lit("")), 1, head)
    made = lambda label, sure, how: F.struct(label.alias("label"), sure.cast("double").alias("confidence"), F.lit(how).alias("method"))

    def ranking(start: Column) -> Column:
        hits = {k: sum((F.rlike(start, F.lit(f"(?iu){p}")).cast("int") for p in ps), F.lit(0)) for k, ps in classes.items()}
        return F.array_sort(F.array(*[F.struct((-n).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("label")) for i, (k, n) in enumerate(hits.items())]))

    def decided(ranked: Column) -> Column:
        best, top, second = F.get(ranked, F.lit(0))["label"], -F.get(ranked, F.lit(0))["n"], -F.get(ranked, F.lit(1))["n"]
        return (
            F.when((top >= 2) & (top > second), made(best, F.round(F.least(F.lit(0.95), 0.6 + 0.15 * top), 2), "rules"))
            .when((top == 1) & (second == 0), made(best, F.lit(0.7), "rules"))
            .when(top > 0, made(best, F.lit(0.5), "rules_tie"))
            .otherwise(made(F.lit("unknown"), F.lit(0.0), "none"))
        )

    return once(start, lambda start: once(ranking(start), decided))  # every pattern is looked for once


def missing_fields(label: Column, fields: Column, required: dict[str, list[list[str]]] = REQUIRED) -> Column:
    """Of each group of fields of which a class needs one, "a / b" where an array of fields has none; in order."""
    out = F.array().cast("array<string>")
    for k, groups in required.items():
        lacking = F.array_compact(F.array(*[F.when(~F.arrays_overlap(fields, F.array(*map(F.lit, g))), " / ".join(sorted(g))) for g in groups]))
        out = F.when(label == k, lacking).otherwise(out)
    return out


def delay_cause(reason: Column, causes=CAUSES) -> Column:
    """struct(label, confidence) of who caused an adjournment, by the first pattern found; null where none is. A missing
    reason counts as empty."""
    said = F.coalesce(reason, F.lit(""))
    out = None
    for pattern, label, sure in causes:
        hit, found = F.rlike(said, F.lit(f"(?iu){pattern}")), F.struct(F.lit(label).alias("label"), F.lit(sure).alias("confidence"))
        out = F.when(hit, found) if out is None else out.when(hit, found)
    return out
