"""Timelines, extraction and consistency on small cases worked out by hand."""

import datetime as dt
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import extract, text
from tidewright.functions.extract import _dates, _segments
from tidewright.operators import consistency, matching, pairs, relational, timeline
from tidewright.plans import records

D0 = dt.date(2024, 1, 1)
day = lambda n: None if n is None else D0 + dt.timedelta(days=n)
TODAY = day(100)
EVENTS = "person_id long, case_id long, type string, start date, end date, is_primary boolean, confidence double"
CASES = "person_id long, case_id long, anchor_date date, stop_date date"


def run(spark, events, cases=((1, 1, None, None),)):
    e = spark.createDataFrame([(1, c, k, day(a), day(b), p, f) for c, k, a, b, p, f in events], EVENTS)
    c = spark.createDataFrame([(p, i, day(a), day(s)) for p, i, a, s in cases], CASES)
    return {r.case_id: r for r in timeline.timelines(c, e, F.lit(TODAY)).collect()}


def test_no_events(spark):
    r = run(spark, [])[1]
    assert (r.custody_days, r.lenient_days, r.in_custody, r.arrest_date, r.flags, r.n_low) == (0, None, False, None, [], 0)


def test_bail_is_cut_out_and_gap_is_explained(spark):
    r = run(spark, [(1, "judicial_custody", 0, 29, True, 0.9), (None, "on_bail", 10, 14, True, 0.9), (1, "re_arrest", 40, None, True, 0.9), (1, "released", 44, None, True, 0.9)])[1]
    assert r.custody_days == 25 + 5
    assert r.flags == ["CUSTODY_EXCLUSION_OVERLAP", "UNEXPLAINED_GAP"]


def test_primary_arrest_wins_and_today_closes(spark):
    r = run(spark, [(1, "arrest", 50, None, False, 0.9), (1, "arrest", 60, None, True, 0.7)])[1]
    assert (r.arrest_date, r.custody_days, r.in_custody) == (day(60), 41, True)
    assert r.flags == ["CONFLICTING_ARREST_DATES", "CURRENT_CUSTODY_USES_TODAY"]
    assert r.n_low == 2


def test_wrong_ranges_are_flagged_and_left_out(spark):
    r = run(spark, [(1, "judicial_custody", 20, 10, True, 0.9), (1, "police_custody", 200, 210, True, 0.9), (1, "on_bail", 9, 5, True, 0.9), (1, "police_custody", 90, 300, True, 0.9)])[1]
    assert r.custody_days == 11
    assert r.flags == ["END_BEFORE_START", "FUTURE_END_DATE", "FUTURE_START_DATE", "INVALID_EXCLUSION_RANGE"]


def test_conviction_stops_and_other_cases_count_leniently(spark):
    events = [(1, "judicial_custody", 0, 19, True, 0.9), (2, "judicial_custody", 30, 49, True, 0.9)]
    r = run(spark, events, ((1, 1, None, 9), (1, 2, 40, None)))
    assert (r[1].custody_days, r[1].lenient_days) == (10, 10)
    assert (r[2].custody_days, r[2].lenient_days) == (20, 10)
    assert r[1].flags == ["CONVICTED"] and r[2].flags == ["CUSTODY_IN_OTHER_CASE"]


def test_delay_days_count_once(spark):
    h = spark.createDataFrame([(1, day(0), day(10), "accused", 0.9, True), (1, day(0), day(10), "accused", 0.9, True), (1, day(5), day(15), "accused", 0.5, False), (1, day(12), day(20), "unknown", 0.9, False), (1, day(30), day(30), "accused", 0.9, False), (1, day(0), day(9), "court", 0.9, False)], "k int, date date, next_date date, attribution string, confidence double, verified boolean")
    c = spark.createDataFrame([(1, day(2), day(17))], "k int, start date, end date")
    r = timeline.delay_days(h, c, ["k"]).first()
    assert (r.accused_days, r.uncertain_days) == (13, 3)
    assert r.flags == ["DELAY_ATTRIBUTION_UNCERTAIN", "DUPLICATE_HEARING", "HEARING_ATTRIBUTION_CONFLICT", "HEARING_DATES_INVALID"]
    assert r.n_needs == 3


def test_dates_never_overlap():
    found = _dates("12th January 2024, 05/03/2023 and Jan 2020", dt.date(2024, 6, 1))
    assert [(d[2], d[3]) for d in found] == [(dt.date(2024, 1, 12), 0.97), (dt.date(2023, 3, 5), 0.75), (dt.date(2020, 1, 1), 0.5)]
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


CHARGES = {
    "under section 34 IPC": [("IPC", "34", None, 0.9)],
    "u/s 323, 324 read with 149 IPC": [("IPC", "323", None, 0.9), ("IPC", "324", None, 0.9)],
    "rooms 12, 13": [],
    "": [],
    "379 r/w 34 IPC": [("IPC", "379", "common_intention", 0.9)],
    "Sec. 20(b)(ii)(A) NDPS Act": [("NDPS", "20(b)(ii)(A)", None, 0.9)],
    "S.379": [("UNKNOWN", "379", None, 0.7)],
    "sections 323, 324, 504 & 506 of the Indian Penal Code": [("IPC", x, None, 0.9) for x in ("323", "324", "504", "506")],
    "u/s 5O6 IPC": [("IPC", "506", None, 0.75)],
    "302 r/w 120B IPC and 61(2) BNS": [("IPC", "302", "conspiracy", 0.9), ("BNS", "61(2)", None, 0.9)],
}


def test_charges(spark):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(CHARGES)], "k int, t string")
    got = d.select("k", extract.charges_in("t").alias("c")).orderBy("k").collect()
    assert [[(c.act, c.section, c.modifier, c.confidence) for c in r.c] for r in got] == list(CHARGES.values())


def test_segments_keep_spans():
    t = "Police Station: A B   FIR No.: 7/2024\nno colon here\nName:\n"
    assert [(a, v, t[s:e]) for a, v, s, e in _segments(t)] == [("Police Station", "A B", "A B"), ("FIR No.", "7/2024", "7/2024"), ("Name", "", "")]


def test_columns(spark):
    d = spark.createDataFrame([("Ravi s/o Mohan, aged about 31 years",), ("Sita",)], "t string")
    assert [tuple(r.p) for r in d.select(extract.person(F.col("t")).alias("p")).collect()] == [("Ravi", "s/o", "Mohan", 31), ("Sita", None, None, None)]
    a = spark.createDataFrame([(x,) for x in ("Yes.", "No (see note)", "-", None, "perhaps", "Not obtained")], "t string")
    assert [r.y for r in a.select(text.yes_no(F.col("t")).alias("y")).collect()] == ["yes", "no", "not_recorded", "not_recorded", "unclear", "no"]
    m = spark.createDataFrame([("abc ಕನ್ನಡ",), ("123",), ("plain",)], "t string")
    assert [r.m for r in m.select(text.language_mix(F.col("t")).alias("m")).collect()] == ["kn+en", "unknown", "en"]
    s = spark.createDataFrame([("x" * 200 + " needle " + "y" * 400, ["needle"])], "t string, q array<string>")
    cut = s.select(extract.snippet(F.col("t"), F.col("q")).alias("s")).first().s
    assert cut.startswith("…") and cut.endswith("…") and "needle" in cut and len(cut) == 322


def test_page_of_takes_the_last_that_begins(spark):
    pages = spark.createDataFrame([(1, 1, "abcd"), (1, 2, "xy"), (1, 3, "z")], "k int, page int, t string")
    hits = spark.createDataFrame([(1, 0), (1, 4), (1, 5), (1, 8), (1, 99)], "k int, at long")
    assert sorted((r["at"], r.page) for r in relational.page_of(pages, hits, "k", "page", "t", "at").collect()) == [(0, 1), (4, 1), (5, 2), (8, 3), (99, 3)]


def test_citations_unknown_to_the_corpus_go(spark):
    d = spark.createDataFrame([(1, "see (2019) 5 SCC 123 and AIR 1979 SC 1360"), (2, None)], "id int, t string")
    k = spark.createDataFrame([("(2019) 5 scc 123",)], "c string")
    r = {x.id: x for x in extract.guard_citations(d, "id", "t", k, "c").collect()}
    assert r[1].removed == ["AIR 1979 SC 1360"] and r[1].t == f"see (2019) 5 SCC 123 and {extract.REMOVED}"
    assert r[2].removed == [] and r[2].t is None


def test_consistency(spark):
    f = spark.createDataFrame([(1, "confirmed", ["UNVERIFIED_DOCUMENT: x"]), (2, "pending", ["UNVERIFIED_DOCUMENT: x"]), (3, "pending", None), (4, "rejected", None)], "id int, review_status string, notes array<string>")
    assert sorted(r.id for r in consistency.usable(f).collect()) == [1, 3]
    facts = spark.createDataFrame([(1, "remand_date", day(5), []), (2, "remand_date", day(1), [day(3)]), (3, "remand_date", day(1), []), (4, "charge_sheet_date", day(1), [])], "k int, field string, value date, alternatives array<date>")
    rec = spark.createDataFrame([(1, "remand_date", day(3)), (2, "remand_date", day(3)), (3, "remand_date", day(3))], "k int, field string, recorded date")
    assert sorted((r.k, r.conflict) for r in consistency.conflicts(facts, rec, ["k"]).collect()) == [(3, "EARLIER"), (4, "MISSING")]
    assert consistency.visible(facts, None, F.col("k") > 2, F.col("field") == "remand_date").count() == 1


def _pairs(groups):
    return {p for g in groups for p in combinations(sorted(g), 2)}


def test_er_cluster_against_its_truth(spark):
    """Three customers in a row are one person: pairs of one cluster against pairs of one person."""
    clusters, persons = defaultdict(list), defaultdict(list)
    for r in records.er_cluster(spark, "/root/testdata/sf0.01").collect():
        clusters[r.cluster].append(r.id)
        persons[r.id // 3].append(r.id)
    found, true = _pairs(clusters.values()), _pairs(persons.values())
    assert len(found & true) / len(found) >= 0.95 and len(found & true) / len(true) >= 0.95


def test_hot_names_are_cut_not_skipped(spark):
    """More than 200 records of one name are one cluster if all else agrees; of another age they are compared with none
    that the age veto keeps apart, and an unknown age with all."""
    schema = "id int, name string, relative_name string, age int, district string, police_station string, address string, co_accused array<string>, cnrs array<string>"
    person = lambda k, age: (k, "Ravi Kumar", "Mohan Lal", age, "d", "p", "1 main road", ["Asha"], None)
    rows = [person(k, 30 + k % 2) for k in range(205)] + [person(300 + k, 60) for k in range(3)] + [person(400, None)]
    df = spark.createDataFrame(rows, schema)
    clusters, pairs = matching.resolve(df)
    found = {r.id: r.cluster for r in clusters.collect()}
    assert len({found[k] for k in range(205)}) == 1 and {found[300 + k] for k in range(3)} == {300}  # the unknown age joins one of them
    apart = pairs.where("a < 205 and b between 300 and 302").count()
    assert apart == 0 and pairs.where("b = 400").count() == 208
    assert {(r.key, r.n) for r in matching.oversized_keys(matching.prepared(df), "id", F.col("blocks")).collect()} == {("ravi", 209), ("kumar", 209)}
    ages = spark.createDataFrame([(a,) for a in [None, -3, *range(0, 240, 3)]], "age int").withColumn("b", matching.bands(F.col("age"))).collect()
    assert all(set(x.b) & set(y.b) for x in ages for y in ages if x.age is None or y.age is None or abs(x.age - y.age) < 10)


def test_texts_as_bits_equal_the_plain_functions():
    rng = random.Random(5)
    values = ["", "a", "é b", "x" * 70, "ab " * 30, *("".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 24))) for _ in range(60))]
    t = pairs._Texts(values)
    a, b = (np.array(x) for x in zip(*((i, j) for i in range(len(values)) for j in range(len(values))), strict=True))
    x, y = t.code[a], t.code[b]
    for exact, most, plain in ((t.jaro_winkler, t.jaro_winkler_at_most, text._jaro_winkler), (t.indel, t.indel_at_most, text._indel_ratio)):
        want = np.array([plain(values[i], values[j]) for i, j in zip(a, b, strict=True)])
        assert (exact(x, y) == want).all() and (most(x, y) >= want - 1e-12).all()


def test_blocks_in_parts_give_each_pair_once_and_clusters_need_links_alone(spark, monkeypatch):
    """Large keys are cut into parts that meet as arrays; a score to reach loses none of the pairs that have it; clusters from
    links that ask for other pairs equal those from all pairs."""
    people = records._people(spark, "/root/testdata/sf0.001")
    whole = {(r.a, r.b): r for r in matching.resolve(people)[1].collect()}
    ready = matching.prepared(people)
    plain = matching.scored_pairs(matching.pair_features(matching.blocked_pairs(ready, "id", F.col("blocks"), matching.bands(F.col("age"))), ready))
    assert {(r.a, r.b): r for r in plain.collect()} == whole
    monkeypatch.setattr(matching, "PART", 8)
    monkeypatch.setattr(pairs, "HELD_ROWS", 50)
    monkeypatch.setattr(pairs, "AT_ONCE", 64)
    under = matching.blocked(people, most=10)
    every = under.pairs().collect()
    cut = matching.blocked_pairs(ready, "id", F.col("blocks"), matching.bands(F.col("age")), 10).collect()
    assert len(every) == len(cut) and {(r.a, r.b): r for r in every} == {k: whole[k] for k in {(r.a, r.b) for r in cut}}
    for least in (0.45, 0.6, 0.92):
        assert sorted((r.a, r.b, r.p, r.vetoes, r.decision) for r in under.pairs(least).collect() if r.p >= least) == sorted((r.a, r.b, r.p, r.vetoes, r.decision) for r in every if r.p >= least)
    monkeypatch.setattr(pairs, "FEWEST_LINKS", 3)
    scored, thresholds = spark.createDataFrame(every, under.pairs().schema), [0.3, 0.6, 0.92]
    for ahead in (0, 8):
        monkeypatch.setattr(pairs, "AHEAD", ahead)
        got = under.clusters(scored.where("p >= 0.3"), ages=False, sweep=thresholds)
        assert set(got.collect()) == set(matching.vetoed_clusters(scored, sweep=thresholds).collect())
        got = under.clusters(scored.where("decision = 'link'"), ages=True)
        assert set(got.collect()) == set(matching.vetoed_clusters(scored, people.select("id", "age")).collect())
