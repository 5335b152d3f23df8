"""Operators against plain Python on small and on random inputs."""

import datetime as dt
import re
import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import dates, text
from tidewright.functions.text import _indel_ratio, _jaro_winkler, _token_set_ratio
from tidewright.operators import intervals, matching, monitor, rules
from tidewright.sources import readers
from tidewright.streaming import monitoring

D0 = dt.date(2024, 1, 1)
day = lambda n: D0 + dt.timedelta(days=n)


def frame(spark, rows):
    return spark.createDataFrame([(k, day(a), day(b)) for k, a, b in rows], "k int, start date, end date")


def as_days(df):
    out = set()
    for r in df.collect():
        out |= {(r.k, (r.start - D0).days + i) for i in range((r.end - r.start).days + 1)}
    return out


def sets(rows):
    return {(k, d) for k, a, b in rows for d in range(a, b + 1)}


@pytest.mark.parametrize("seed", range(3))
def test_interval_algebra_equals_day_sets(spark, seed):
    r = random.Random(seed)
    make = lambda n: [(r.randrange(4), s := r.randrange(60), s + r.randrange(-1, 9)) for _ in range(n)]
    a, b = make(40), make(30)
    merged = intervals.merge(frame(spark, a), ["k"])
    assert as_days(merged) == sets(a)
    spans = sorted((x.k, x.start, x.end) for x in merged.collect())
    assert all(p[0] != q[0] or (q[1] - p[2]).days > 1 for p, q in zip(spans, spans[1:]))
    left = sets(a) - sets(b)
    assert as_days(intervals.subtract(frame(spark, a), frame(spark, b), ["k"])) == left
    got = {x.k: (x.counted_days, x.reached) for x in intervals.counted_days(frame(spark, a), frame(spark, b), ["k"], 7).collect()}
    for k in {k for k, _ in left}:
        ds = sorted(d for q, d in left if q == k)
        assert got[k] == (len(ds), day(ds[6]) if len(ds) >= 7 else None)
    both = sets(a) & sets(b)
    assert {x.k: x.overlap for x in intervals.overlap_days(frame(spark, a), frame(spark, b), ["k"]).collect()} == {k: sum(q == k for q, _ in both) for k in {k for k, _ in both}}


def test_close_open_takes_the_same_day(spark):
    at = lambda ds: spark.createDataFrame([(1, day(d)) for d in ds], "k int, at date")
    out = intervals.close_open(at([0, 5, 9]), at([5, 7]), ["k"], F.lit(day(20)).cast("date"))
    assert sorted((r.start, r.end) for r in out.collect()) == [(day(0), day(5)), (day(5), day(5)), (day(9), day(20))]


def test_threshold_is_exact(spark):
    from fractions import Fraction
    from math import ceil

    rows = spark.range(1, 361).select(F.col("id").alias("m"), *[dates.ceil_threshold(F.col("id"), 1, d).alias(f"d{d}") for d in (1, 2, 3)]).collect()
    for r in rows:
        assert [r.d1, r.d2, r.d3] == [ceil(Fraction(36525, 1200) * r.m / d) for d in (1, 2, 3)]


@pytest.mark.parametrize(
    ("s", "value", "confidence"),
    [("on 15/01/2024.", dt.date(2024, 1, 15), 0.95), ("03-04-2023", dt.date(2023, 4, 3), 0.75), ("12/25/2023", dt.date(2023, 12, 25), 0.7), ("೧೫/೦೧/೨೦೨೪", dt.date(2024, 1, 15), 0.95), ("1.2.99", dt.date(1999, 2, 1), 0.65), ("20/12/2030", dt.date(2030, 12, 20), 0.3), ("40/40/2020", None, None), ("none", None, None)],
)
def test_numeric_dates(spark, s, value, confidence):
    r = spark.createDataFrame([(s,)], "s string").select(dates.parse_numeric_date(F.col("s"), F.lit(day(30)).cast("date")).alias("d")).first().d
    assert (r and (r.value, r.confidence)) == (value and (value, confidence))


def test_phonetic_variants_meet(spark):
    keys = [r.k for r in spark.createDataFrame([("Shivanna Gowda",), ("Sivana Gauda",), ("Shivana  Govda",)], "n string").select(text.phonetic_key(F.col("n")).alias("k")).collect()]
    assert keys[0] == keys[2]


def test_similarities():
    assert round(_jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert _jaro_winkler("", "") == 0.0
    assert _indel_ratio("abc", "abd") == pytest.approx(4 / 6)


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_similarity_is_symmetric(a, b):
    assert _indel_ratio(a, b) == _indel_ratio(b, a)
    assert 0 <= _jaro_winkler(a, b) <= 1


def test_vetoed_clusters_refuse_a_link(spark):
    rows = [(1, 2, 0.99, [], "link"), (2, 3, 0.95, [], "link"), (1, 3, 0.2, ["AGE_GAP"], "no_link"), (8, 9, 0.93, [], "link")]
    out = matching.vetoed_clusters(spark.createDataFrame(rows, "a long, b long, p double, vetoes array<string>, decision string"))
    assert {r.id: r.cluster for r in out.collect()} == {1: 1, 2: 1, 3: 3, 8: 8, 9: 8}


RECORD = "id string, name string, relative_name string, age int, district string, police_station string, address string, co_accused array<string>, cnrs array<string>"
PEOPLE = [
    ("a", "Ramesh Kumar", "Suresh", 30, "x", "p1", "12 Main Road", ["Anil"], None), ("b", "Sri Ramesh Kumarr", "Suresh", 31, "x", None, "Main Road 12", None, ["C1"]), ("c", "Ramesh Kumar", "Suresh", 55, "x", "p1", None, None, None),
    ("d", "Raju @ Ramesh Kumar s/o Suresh", "Suresha", 30, None, None, None, ["Anill"], ["C1", "C2"]), ("e", "Md. Rafiq", None, None, "y", None, None, None, ["C2"]), ("f", "Mohammed Rafiq K", "Basha", 41, "y", "p2", "9 Tank Street", None, None), ("g", None, None, None, None, None, None, None, None),
]


def plain_phonetic(token):
    out = re.sub("[^a-z]", "", token.lower())
    for x, y in text.PHONETIC:
        out = out.replace(x, y)
    out = re.sub(r"(.)\1+", r"\1", out)
    return re.sub("[aue]+$", "", out) if len(out) > 3 else out


def plain_tokens(name):
    raw = [t for t in re.split("[^a-z]+", (name or "").lower()) if t]
    out = [(t, k == len(raw) - 1 and len(raw) > 1) for k, t in enumerate(raw) if t not in text.HONORIFICS]
    return [text.SPELLED_INITIALS.get(text.EXPANSIONS.get(t, t), text.EXPANSIONS.get(t, t)) if last else text.EXPANSIONS.get(t, t) for t, last in out]


def plain_pair(x, y):
    """The fifteen features of two records, one by one."""
    key = lambda ts: " ".join(sorted(plain_phonetic(t) for t in ts if len(t) > 1))
    name = lambda r: [plain_tokens(p) for p in re.split("@| alias ", re.split(" s/o ", r[1] or "")[0]) if p.strip()] or [[]]
    (n1, *al1), (n2, *al2) = name(x), name(y)
    k1, k2, a1, a2 = key(n1), key(n2), {key(a) for a in al1}, {key(a) for a in al2}
    t1, t2 = ({plain_phonetic(t) for t in n if len(t) > 1} for n in (n1, n2))
    i1, i2 = {t[0] for t in n1}, {t[0] for t in n2}
    r1, r2 = (key(plain_tokens(r[2])) for r in (x, y))
    both = lambda k: bool(x[k] and y[k])
    share = lambda k: float(bool(set(x[k] or ()) & set(y[k] or ())))
    co = lambda r: {key(plain_tokens(c)) for c in r[7] or ()}
    gap = abs(x[3] - y[3]) if x[3] is not None and y[3] is not None else None
    rel = _jaro_winkler(r1, r2)
    f = [
        _indel_ratio(" ".join(sorted(n1)), " ".join(sorted(n2))), _jaro_winkler(k1, k2) if k1 and k2 else 0.0, len(t1 & t2) / max(1, min(len(t1), len(t2))), float(bool(a1 & ({k2} | a2) or a2 & {k1})), float(i1 <= i2 or i2 <= i1),
        rel if r1 and r2 else 0.5, float(not (r1 and r2)), 0.2 if gap is None else min(gap, 30) / 30, float(gap is None), float(both(4) and x[4] == y[4]), float(both(5) and x[5] == y[5]),
        _token_set_ratio(x[6].lower(), y[6].lower()) if both(6) else 0.5, float(not both(6)), float(bool(co(x) & co(y))), share(8),
    ]
    return f, [v for v, c in (("RELATIVE_NAME_DIFFERS", r1 and r2 and rel < 0.75), ("AGE_GAP", gap is not None and gap >= 10)) if c]


def test_pair_features_by_brute_force(spark):
    ready = matching.prepared(spark.createDataFrame(PEOPLE, RECORD))
    pairs = spark.createDataFrame([(x[0], y[0]) for x in PEOPLE for y in PEOPLE if x[0] < y[0]], "a string, b string")
    got = {(r.a, r.b): (list(r.f), r.vetoes) for r in matching.pair_features(pairs, ready).collect()}
    by_id = {x[0]: x for x in PEOPLE}
    for (a, b), (f, vetoes) in got.items():
        want, against = plain_pair(by_id[a], by_id[b])
        assert f == pytest.approx(want) and vetoes == against, (a, b)
    assert len(got) == 21


def test_resolve(spark):
    clusters, pairs = matching.resolve(spark.createDataFrame(PEOPLE, RECORD))
    p = {(r.a, r.b): r for r in pairs.collect()}
    assert p["a", "b"].decision == "link" and p["a", "c"].vetoes == ["AGE_GAP"] and p["a", "c"].p <= 0.2
    assert p["a", "d"].p == 0.93 and p["b", "d"].p == 0.97 and ("a", "e") not in p  # a stated alias; a shared case number
    c = {r.id: r.cluster for r in clusters.collect()}
    assert c["a"] == c["b"] == c["d"] == "a" and c["c"] == "c" and c["g"] == "g"
    assert [(r.key, r.n) for r in matching.oversized_keys(spark.createDataFrame(PEOPLE, RECORD), "id", F.array("district"), 2).orderBy("key").collect()] == [("x", 3)]


def test_names_in_latin_letters(spark):
    names = [("ರಮೇಶ್",), ("मोहन",), ("José",), (None,)]
    assert [r.l for r in spark.createDataFrame(names, "n string").select(text.to_latin("n").alias("l")).collect()] == ["ramesh", "mohan", "jose", None]


def test_default_bail_boundaries(spark):
    t = day(100)
    rows = [(0, day(10), None, None, 96, "URGENT_DEFAULT_BAIL"), (1, day(45), None, None, 96, "DEFAULT_BAIL_WINDOW_SOON"), (2, day(10), day(60), None, 96, None), (3, day(10), day(80), None, 96, "DEFAULT_BAIL_RIGHT_LOST"), (4, day(10), day(80), day(75), 96, "DEFAULT_BAIL_RIGHT_ASSERTED"), (5, day(10), day(80), day(80), 96, "DEFAULT_BAIL_REVIEW"), (6, day(30), None, None, 120, "DEFAULT_BAIL_REVIEW"), (7, day(10), day(5), None, 96, "DEFAULT_BAIL_REVIEW"), (8, day(90), None, None, 240, None), (9, None, None, None, 96, "DEFAULT_BAIL_REVIEW")]
    df = spark.createDataFrame([(i, r, c, a, m) for i, r, c, a, m, _ in rows], "i int, first_remand_date date, charge_sheet_date date, default_bail_application_date date, term_months int")
    df = df.select("*", F.lit("investigation").alias("status"), F.lit("term").alias("term_kind"), F.lit(None).cast("int").alias("min_months"), F.lit(None).cast("int").alias("special_period"))
    assert {r.i: r.default_bail for r in rules.default_bail(df, F.lit(t).cast("date")).collect()} == {i: o for i, *_, o in rows}


def test_most_serious_keeps_the_first(spark):
    c = spark.createDataFrame([(1, 1, "x", "term", 36), (1, 2, "y", "term", 36), (1, 3, "z", "life", None), (2, 1, "x", "none", None)], "case int, ordinal int, offence string, term_kind string, term_months int")
    out = {r.case: (r.term_kind, r.n_charges, r.n_offences) for r in rules.most_serious(c, "case").collect()}
    assert out == {1: ("life", 3, 3), 2: ("none", 1, 1)}


def test_lifecycle_is_idempotent(spark):
    today = F.lit(day(10)).cast("date")
    stored = spark.createDataFrame([("a", "open", day(1), False), ("b", "auto_resolved", day(1), False)], "dedupe_key string, state string, opened_on date, escalated boolean")
    now = spark.createDataFrame([("a",), ("b",), ("c",)], "dedupe_key string")
    once = monitor.lifecycle(stored, now, today)
    rows = {r.dedupe_key: (r.state, r.escalated) for r in once.collect()}
    assert rows == {"a": ("open", True), "b": ("reopened", False), "c": ("open", False)}
    assert sorted(monitor.lifecycle(once, now, today).collect()) == sorted(once.collect())


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "text": "x"}\n\n{"id": 2}\n')
    assert sorted(tuple(r) for r in readers.jsonl(spark, f"file://{tmp_path}/a.jsonl", "id long, text string", {"text": ""}).where("id is not null").collect()) == [(1, "x"), (2, "")]
    (tmp_path / "c.csv").write_text("Filed,n\n2020-01-02,3\nbad,4\n")
    assert [r.filed for r in readers.csv(spark, f"file://{tmp_path}/c.csv", "Filed string, n int", {"Filed": "filed"}, ("filed",)).orderBy("n").collect()] == [dt.date(2020, 1, 2), None]
    (tmp_path / "t.txt").write_bytes("one\ftwo".encode())
    (tmp_path / "l.txt").write_bytes("caf\xe9".encode("latin-1"))
    pages = {(r.path[-5:], r.page): r.text for r in readers.text_documents(spark, f"file://{tmp_path}/*.txt").collect()}
    assert pages["t.txt", 2] == "two"
    readers.append(spark.range(2), f"file://{tmp_path}/log")
    readers.append(spark.range(2), f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 4


def test_stream_recomputes_touched_keys(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y"), (1, "z")], "k int, v string").write.parquet(f"file://{tmp_path}/in")
    seen = []
    q = monitoring.recompute_touched(spark.readStream.schema("k int, v string").parquet(f"file://{tmp_path}/in"), "k", lambda ks: seen.extend(r.k for r in ks.collect()), f"file://{tmp_path}/ck")
    q.awaitTermination(60)
    assert sorted(seen) == [1, 2]


def test_entry_has_stable_schema(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["status", "n", "counted_days", "most_overdue"]
    assert set(e.oracle_sql()) <= set(e.queries())
    json.dumps(sorted(e.queries()))
