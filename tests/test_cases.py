"""Decisions, law, registers and detectors on cases made by hand; latent retrieval against a full decomposition."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import decision, detectors, law, registers, retrieval
from tidewright.sources import scratch

TODAY = dt.date(2024, 6, 1)


def test_governing_law(spark):
    charges = spark.createDataFrame([(1, "IPC", "379", None, dt.date(2024, 1, 1), False), (2, "IPC", "379", "attempt", dt.date(2024, 8, 1), False), (3, "BNS", "303", None, dt.date(2023, 1, 1), False), (4, "IPC", "34", None, None, False), (5, "IPC", "999", None, dt.date(2024, 1, 1), False), (6, "BNS", "500", None, dt.date(2024, 1, 1), False)], "id int, act string, section string, modifier string, offence_date date, aggravated boolean")
    rec = "act string, section string, kind string, max_kind string, max_months int, aggravated_kind string, aggravated_months int, min_months int, special_law boolean, period_days int, verified boolean"
    records = spark.createDataFrame([("IPC", "379", "offence", "term", 36, None, None, None, False, None, True), ("BNS", "303", "offence", "term", 35, None, None, None, False, None, True), ("IPC", "34", "liability_rule", "none", 0, None, None, None, False, None, True)], rec)
    mapping = spark.createDataFrame([("379", "303", True), ("1", "500", True), ("2", "500", True)], "old string, new string, verified boolean")
    got = {r.id: r for r in law.governed(charges, records, mapping, F.lit("2024-07-01").cast("date")).collect()}
    assert (got[1].record_key, got[1].term.months, got[1].law_flags) == ("IPC:379", 36, [])
    assert (got[2].record_key, got[2].term.months, got[2].law_flags) == ("BNS:303", 18, ["IPC_BNS_TRANSITION_MISMATCH"])
    assert (got[3].record_key, got[3].term.months) == ("IPC:379", 36)
    assert got[4].law_flags == ["OFFENCE_DATE_UNKNOWN", "LIABILITY_RULE_ONLY"] and got[4].term is None
    assert got[5].law_flags == ["UNKNOWN_SECTION", "NO_RECORD"]
    assert got[6].law_flags == ["IPC_BNS_TRANSITION_MISMATCH", "MAPPING_AMBIGUOUS_OR_MISSING", "NO_RECORD"]


def test_decision_of_one_case(spark):
    """A year in custody less ten days of the accused's own adjournment, against a third of thirty months."""
    day = lambda n: TODAY - dt.timedelta(days=n)
    cases = spark.createDataFrame([("p", "c", "trial", 0.9, None, None, day(364), day(330), None, day(30), None)], "person_id string, case_id string, status string, status_confidence double, conviction_date date, acquittal_date date, first_remand_date date, charge_sheet_date date, default_bail_application_date date, bail_granted_date date, anchor_date date")
    events = spark.createDataFrame([("p", "c", "arrest", day(364), None, True, 0.95)], "person_id string, case_id string, type string, start date, end date, is_primary boolean, confidence double")
    hearings = spark.createDataFrame([("p", "c", day(100), day(90), "accused", 0.9, True)], "person_id string, case_id string, date date, next_date date, attribution string, confidence double, verified boolean")
    charges = spark.createDataFrame([("p", "c", "IPC", "379", None, dt.date(2023, 1, 1), False, 0.9, None, 1)], "person_id string, case_id string, act string, section string, modifier string, offence_date date, aggravated boolean, confidence double, dropped_on date, ordinal int")
    records = spark.createDataFrame([("IPC", "379", "offence", "term", 30, None, None, 6, False, None, True)], "act string, section string, kind string, max_kind string, max_months int, aggravated_kind string, aggravated_months int, min_months int, special_law boolean, period_days int, verified boolean")
    mapping = spark.createDataFrame([], "old string, new string, verified boolean")
    convictions = spark.createDataFrame([("p", "other", "juvenile")], "person_id string, case_id string, status string")
    r = decision.decide(cases, events, hearings, charges, records, mapping, convictions, F.lit(TODAY), F.lit("2024-07-01").cast("date")).first()
    assert (r.custody_days, r.counted_days, r.max_days, r.threshold_days, r.first_offender) == (365, 355, 914, 305, True)
    assert r.status_out == "ELIGIBLE" and r.days_overdue == 50
    assert r.eligible_from == day(364) + dt.timedelta(days=304 + 10)  # ten excluded days lie before it
    assert r.findings == ["CRITICAL_BAIL_NOT_FURNISHED", "TIME_SERVED_EXCEEDS_MINIMUM"] and r.urgency == "CRITICAL_BAIL_NOT_FURNISHED"
    routes = {x.code for x in detectors.release_routes(spark.createDataFrame([r.asDict()], "case_id string, status_out string, findings array<string>, first_offender boolean, term_kind string"), ["case_id"]).collect()}
    assert routes == {"SECTION_479_RELEASE", "SURETY_RELIEF", "TIME_SERVED", "PROBATION_CONSIDERATION"}


def test_forbidden_steps(spark):
    steps = [("File the application.", True), ("Persuade the witness to stay away.", False), ("Settle, but do not approach or pressure the victim.", True), ("Pressure the victim.", False)]
    assert [r.ok for r in spark.createDataFrame(steps, "s string, want boolean").select(detectors.allowed(F.col("s")).alias("ok"), "want").collect()] == [w for _, w in steps]


def test_registers(spark):
    df = spark.createDataFrame([(1, {"a": 1}, {"a": 2, "b": 3}, None), (2, {}, {"c": 1}, '{"intake": "held"}')], "id int, l map<string,int>, r map<string,int>, j string")
    got = df.select(registers.merged_map(F.col("l"), F.col("r")).alias("m"), registers.json_or(F.col("j"), "intake", "verified").alias("i"), registers.canonical_json(["j", "id"]).alias("c")).collect()
    assert [(r.m, r.i) for r in got] == [({"a": 2, "b": 3}, "verified"), ({"c": 1}, "held")] and got[0].c == '{"id":1,"j":null}'
    v = registers.variants(F.lit("b"), F.array(F.lit("c"), F.lit("b")), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("c")))
    assert df.select(v.alias("v")).first().v == ["a", "c"]


def test_latent_vectors_by_full_decomposition(spark):
    rng = np.random.default_rng(1)
    pool = [f"word{k}" for k in range(40)]
    texts = [" ".join(rng.choice(pool[10 * (k % 4) : 10 * (k % 4) + 14], 12)) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    queries = spark.createDataFrame([(0, texts[3]), (1, "word1 word2 word3 nothing")], "id long, t string")
    d, q = retrieval.latent_vectors(docs, queries, "id", "t", "id", "t", rank=5, rounds=40)
    got = {(r.query, r.id): r.score for r in retrieval.cosines(d, q).collect()}
    grams = lambda t: (ws := re.findall(r"\b\w\w+\b", t.lower())) + [" ".join(x) for x in zip(ws, ws[1:], strict=False)]
    vocabulary = sorted({g for t in texts for g in grams(t)})
    df = np.array([sum(g in set(grams(t)) for t in texts) for g in vocabulary])
    idf = np.log((1 + len(texts)) / (1 + df)) + 1

    def row(t):
        tf = np.array([grams(t).count(g) for g in vocabulary], float)
        x = np.where(tf > 0, (1 + np.log(np.maximum(tf, 1))) * idf, 0)
        return x / max(np.linalg.norm(x), 1e-12)

    a = np.array([row(t) for t in texts])
    v = np.linalg.svd(a, full_matrices=False)[2][:5].T
    for i, t in ((0, texts[3]), (1, "word1 word2 word3 nothing")):
        x = row(t) @ v
        for k in range(30):
            y = a[k] @ v
            assert got[i, k] == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y), abs=1e-4)


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Fake:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        scratch.shared_folder(Fake)
