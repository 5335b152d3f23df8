"""Queries on timelines, extracted facts, consistency, hybrid retrieval, training and streams, with their SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import documents, extract, text
from tidewright.operators import consistency, detectors, matching, metrics, relational, retrieval, rules, timeline
from tidewright.plans import training
from tidewright.plans.catalog import TODAY, query
from tidewright.sources.readers import table
from tidewright.sources.scratch import checkpointed, shared_folder, spread
from tidewright.streaming import monitoring



def _today():
    return F.lit(TODAY).cast("date")


def _values(rows: list[tuple], names: str) -> str:
    """Expected rows as SQL."""
    cell = lambda v: "null" if v is None else f"date '{v}'" if isinstance(v, dt.date) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


# ---- timelines over events: a user is a person with one case


def _custody_events(spark, sf):
    e, day = table(spark, sf, "events"), F.to_date("ts")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("person_id"),
        F.when(F.col("event_id") % 3 == 0, F.col("user_id")).cast("long").alias("case_id"),
        F.when(kind == "signup", "judicial_custody").when(kind == "view", "re_arrest").when(kind == "click", "arrest").when(kind == "purchase", "released").otherwise("on_bail").alias("type"),
        day.alias("start"),
        F.when(kind == "signup", F.date_add(day, 2)).when(kind == "error", F.date_add(day, 1)).alias("end"),
        (F.col("event_id") % 2 == 0).alias("is_primary"),
        F.lit(0.9).alias("confidence"),
    )


_TL = f"""ev as (select user_id as p, event_type as k, event_id, cast(ts as date) as s from events),
ch as (select p, coalesce(min(s) filter (where event_id % 2 = 0), min(s)) as c from ev where k = 'click' group by p),
cl as (select p, k, s, case when k = 'signup' then s + 2 when k = 'error' then s + 1 else coalesce((select min(r.s) from ev r where r.p = ev.p and r.k = 'purchase' and r.s >= ev.s), date '{TODAY}') end as e
  from ev where k in ('signup', 'view', 'error') or (k = 'click' and s = (select c from ch where ch.p = ev.p))),
ok as (select p, k, s, case when k in ('signup', 'error') then least(e, date '{TODAY}') else e end as e from cl where s <= date '{TODAY}'),
dd as (select distinct p, k = 'error' as x, cast(unnest(generate_series(cast(s as timestamp), cast(e as timestamp), interval 1 day)) as date) as d from (select distinct p, k, s, e from ok where e >= s)),
ct as (select p, d from dd where not x except select p, d from dd where x)"""


@query(f"""with {_TL} select ppl.p as person_id, coalesce(n, 0) as custody_days, coalesce(inside, false) as in_custody, c as arrest_date
from (select distinct p from ev) ppl left join (select p, count(*) as n, bool_or(d = date '{TODAY}') as inside from ct group by p) x on x.p = ppl.p left join ch on ch.p = ppl.p""", dates="arrest_date")  # fmt: skip
def timeline_cases(spark, sf):
    """Custody of every user: arrests resolved, open records closed, bail cut out, days counted once."""
    e = _custody_events(spark, sf)
    cases = e.select("person_id", F.col("person_id").alias("case_id"), F.lit(None).cast("date").alias("anchor_date"), F.lit(None).cast("date").alias("stop_date")).distinct()
    return timeline.timelines(cases, e, _today()).select("person_id", "custody_days", "in_custody", "arrest_date")


_WHO = ["accused", "court", "unknown", "both"]


@query(f"""with c as (select user_id as p, cast(ts as date) as s from events where event_type = 'signup'),
cd as (select distinct p, cast(unnest(generate_series(cast(s as timestamp), cast(s + 10 as timestamp), interval 1 day)) as date) as d from (select distinct * from c)),
h as (select user_id as p, cast(ts as date) as s, case when event_id % 7 > 0 then cast(ts as date) + cast(event_id % 5 as int) end as n, event_id % 4 as w from events where event_type = 'click'),
hd as (select distinct p, w = 0 as a, cast(unnest(generate_series(cast(s as timestamp), cast(n - 1 as timestamp), interval 1 day)) as date) as d from (select distinct p, s, n, w from h where n > s and w in (0, 2, 3))),
a as (select p, d from hd where a intersect select * from cd), u as (select p, d from hd where not a intersect select * from cd except select p, d from hd where a)
select x.p as user_id, (select count(*) from a where a.p = x.p) as accused_days, (select count(*) from u where u.p = x.p) as uncertain_days from (select distinct p from h) x""")  # fmt: skip
def delay_days(spark, sf):
    """Custody days inside adjournments that the accused caused, and those that may be theirs."""
    e, day = table(spark, sf, "events"), F.to_date("ts")
    custody = e.where("event_type = 'signup'").select("user_id", day.alias("start"), F.date_add(day, 10).alias("end"))
    h = e.where("event_type = 'click'").select(
        "user_id", day.alias("date"), F.when(F.col("event_id") % 7 > 0, F.date_add(day, (F.col("event_id") % 5).cast("int"))).alias("next_date"),
        F.get(F.array(*map(F.lit, _WHO)), (F.col("event_id") % 4).cast("int")).alias("attribution"), F.lit(0.9).alias("confidence"), F.lit(False).alias("verified"),
    )
    return timeline.delay_days(h, custody, ["user_id"]).select("user_id", "accused_days", "uncertain_days")


# ---- extraction, over a file for each customer: its shape and numbers follow from the key


def _filed(spark, sf, texts):
    """(id, t): customers' files, the shape chosen by the key and the key in front."""
    k = F.col("c_custkey")
    chosen = F.get(F.array(*[F.lit(t).cast("string") for _, t in texts]), (k % len(texts)).cast("int"))
    return spread(table(spark, sf, "customer").select("c_custkey")).select(k.alias("id"), F.concat(F.lit("("), k.cast("string"), F.lit(") "), chosen).alias("t"))


def _expected(values: str, n: int, columns: str) -> str:
    """SQL of what each customer's file must give, by the number of its shape."""
    return f"with v as ({values}) select c_custkey as id, {columns} from customer join v on c_custkey % {n} + 1 = v.i"


_DATED = [
    (1, "Arrested on 05/03/2024 at 10:00"), (2, "filed 25-12-2023; next 12th January 2024"), (3, "March 5, 2024 and June 2023"), (4, "born 01/02/98"), (5, "on 31/02/2024"), (6, "hearing 03/25/2023"), (7, "until 9 Aug 2031"), (8, "೦೫/೦೩/೨೦೨೪"), (9, None),
]


@query(_expected(_values([(1, 12, dt.date(2024, 3, 5), 0.3), (2, 6, dt.date(2023, 12, 25), 0.95), (2, 23, dt.date(2024, 1, 12), 0.97), (3, 0, dt.date(2024, 3, 5), 0.3), (3, 18, dt.date(2023, 6, 1), 0.5), (4, 5, dt.date(1998, 2, 1), 0.65), (5, 3, None, 0.0), (6, 8, dt.date(2023, 3, 25), 0.7), (7, 6, dt.date(2031, 8, 9), 0.3), (8, 0, dt.date(2024, 3, 5), 0.3)], "i, pos, value, confidence"), len(_DATED), "pos + length(c_custkey::varchar) + 3 as pos, value, confidence"), dates="value confidence")
def date_parse(spark, sf):
    x = _filed(spark, sf, _DATED).select("id", F.explode(extract.dates_in("t", _today())).alias("d"))
    return x.select("id", F.col("d.start").alias("pos"), "d.value", F.col("d.confidence").cast("decimal(4,2)").alias("confidence"))


_LAW = [(1, "u/s 379 r/w 34 IPC"), (2, "Sec. 20(b)(ii) of the NDPS Act"), (3, "sections 302, 307 & 511 IPC"), (4, "u/s 5O6 IPC"), (5, "room 12 of 14"), (6, "Section 303(2)")]


@query(_expected(_values([(1, "IPC", "379", "common_intention", 0.9), (2, "NDPS", "20(b)(ii)", None, 0.9), (3, "IPC", "302", "attempt", 0.9), (3, "IPC", "307", "attempt", 0.9), (4, "IPC", "506", None, 0.75), (6, "UNKNOWN", "303(2)", None, 0.7)], "i, act, section, modifier, confidence"), len(_LAW), "act, section, modifier, confidence"), dates="confidence")
def section_parse(spark, sf):
    x = _filed(spark, sf, _LAW).select("id", F.explode(extract.charges_in("t")).alias("c"))
    return x.select("id", "c.act", "c.section", "c.modifier", F.col("c.confidence").cast("decimal(3,2)").alias("confidence"))


_MEMO_SQL = """m as (select c_custkey as k, c_custkey || '/2024' as fir, c_name || ' s/o Shankar, aged about ' || (20 + c_custkey % 50) || ' years' as who, printf('25/%02d/2023', (c_custkey % 12 + 1)::int) as stated, (['Not done', 'Yes', 'perhaps'])[c_custkey % 3 + 1] as med from customer)"""


def _memos(spark, sf):
    """A memo for each customer: labels on shared lines, its name, number and dates, and a hearing."""
    k = F.col("c_custkey")
    month = F.format_string("%02d", (k % 12 + 1).cast("int"))
    who = F.concat("c_name", F.lit(" s/o Shankar, aged about "), (20 + k % 50).cast("string"), F.lit(" years"))
    med = F.get(F.array(F.lit("Not done"), F.lit("Yes"), F.lit("perhaps")), (k % 3).cast("int"))
    t = F.concat(F.lit("Police Station: Hebbal   FIR No.: "), k.cast("string"), F.lit("/2024\nAccused: "), who, F.lit("\nDate of arrest (as stated): 25/"), month, F.lit("/2023\nMedical examination: "), med, F.lit("\nNote: none\n26/"), month, F.lit("/2023: Counsel absent. Call on 13/02/2024.\n"))
    return spread(table(spark, sf, "customer").select("c_custkey", "c_name")).select(k.alias("id"), t.alias("t"))


@query(f"""with {_MEMO_SQL}, f as (select k as id, unnest([struct_pack(field := 'police_station', value := 'Hebbal', pos := 16, c := 0.9), struct_pack(field := 'fir_number', value := fir, pos := 34, c := 0.9), struct_pack(field := 'accused', value := who, pos := 34 + length(fir) + 10, c := 0.9),
    struct_pack(field := 'stated_arrest_date', value := stated, pos := 34 + length(fir) + 10 + length(who) + 29, c := 0.95), struct_pack(field := 'medical_examination', value := med, pos := 34 + length(fir) + 10 + length(who) + 29 + 10 + 22, c := case when med = 'perhaps' then 0.4 else 0.9 end)]) as x from m)
    select id, x.field as field, x.value as value, x.pos::int as pos, x.c::decimal(3, 2) as confidence from f""", dates="confidence")
def label_fields(spark, sf):
    f = extract.labelled_fields(_memos(spark, sf), "id", "t", _today())
    return f.select("id", "field", "value", F.col("start").alias("pos"), F.col("confidence").cast("decimal(3,2)").alias("confidence"))


@query("select c_custkey as id, make_date(2023, (c_custkey % 12 + 1)::int, 26) as date, 'Counsel absent.' as reason, date '2024-02-13' as next_date from customer", dates="date next_date")
def hearing_lines(spark, sf):
    return extract.hearings(_memos(spark, sf), "id", "t", _today()).select("id", "date", "reason", "next_date")


@query("""with n as (select conv_id, turn, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as l from conversations) select conv_id, turn, case when l > 0 then 'en' else 'unknown' end as mix from n""")
def language_mix(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.language_mix(F.col("text")).alias("mix"))


@query("""with o as (select conv_id, turn, coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as o from conversations),
h as (select conv_id, cast(unnest([0, 60, 150, 400]) as bigint) as at from (select distinct conv_id from conversations)) select h.conv_id, h.at, max(turn) as page from h join o on o.conv_id = h.conv_id and o.o <= h.at group by all""")  # fmt: skip
def page_assign(spark, sf):
    """The page (turn) that holds each offset: a backward as-of over cumulative lengths."""
    c = table(spark, sf, "conversations")
    hits = c.select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 60, 150, 400)])).alias("at"))
    return relational.page_of(c.select("conv_id", "turn", "text"), hits, "conv_id", "turn", "text", "at", "page")


@query("""with s as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[a-z]+'))) as c from documents), k as (select distinct regexp_replace(lower(c), '[^a-z0-9]', '', 'g') as k from s where doc_id % 2 = 0)
select d.doc_id, (select count(*) from s where s.doc_id = d.doc_id and regexp_replace(lower(c), '[^a-z0-9]', '', 'g') not in (select k from k)) as n_removed from documents d""")  # fmt: skip
def citation_guard(spark, sf):
    """Addresses that no even-numbered document holds are cut out."""
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]+"
    d = table(spark, sf, "documents").select("doc_id", "text")
    known = d.where("doc_id % 2 = 0").select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("c"))
    return extract.guard_citations(d, "doc_id", "text", known, "c", pattern).select("doc_id", F.size("removed").cast("long").alias("n_removed"))


# ---- records against documents


@query("""with f as (select o_orderkey as k, cast(o_orderdate as date) + cast(o_orderkey % 3 - 1 as int) as d, case when o_orderkey % 4 = 0 then cast(o_orderdate as date) end as alt, case when o_orderkey % 5 > 0 then cast(o_orderdate as date) end as r, o_orderkey % 2 as kind from orders)
select k, case when r is null then 'MISSING' when kind = 0 and d <> r and not coalesce(alt = r, false) then 'DIFFERS' when kind = 1 and d < r and not coalesce(alt = r, false) then 'EARLIER' end as conflict from f where r is null or (kind = 0 and d <> r and not coalesce(alt = r, false)) or (kind = 1 and d < r and not coalesce(alt = r, false))""")  # fmt: skip
def record_conflicts(spark, sf):
    """Dates read from documents against the record: an ambiguous reading clears a conflict only if it fits exactly."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    o = table(spark, sf, "orders")
    facts = o.select(k.alias("k"), F.when(k % 2 == 0, "charge_sheet_date").otherwise("remand_date").alias("field"), F.date_add(day, (k % 3 - 1).cast("int")).alias("value"), F.when(k % 4 == 0, F.array(day)).otherwise(F.array().cast("array<date>")).alias("alternatives"))
    recorded = o.where(k % 5 > 0).select(k.alias("k"), F.when(k % 2 == 0, "charge_sheet_date").otherwise("remand_date").alias("field"), day.alias("recorded"))
    return consistency.conflicts(facts, recorded, ["k"]).select("k", "conflict")


@query("select o_custkey, o_orderkey from orders o where o_orderstatus = 'F' and not exists (select 1 from lineitem where l_orderkey = o_orderkey and cast(l_shipdate as date) = cast(o_orderdate as date) + 30)")
def unsupported_entries(spark, sf):
    """Typed values that no document supports."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("k"), F.date_add(F.to_date("o_orderdate"), 30).alias("value"))
    facts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("value"))
    return consistency.unsupported(o, facts, ["k", "value"]).select("o_custkey", F.col("k").alias("o_orderkey"))


@query("select l_orderkey, l_returnflag as field, arg_min(l_linenumber, case when l_linestatus = 'F' then 0 else 1 end * 1000000 - l_quantity * 1000 + l_linenumber) as best from lineitem group by all")
def best_fact(spark, sf):
    """For each field of a case the reviewed fact of the highest confidence."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    return consistency.best(l.withColumnRenamed("l_returnflag", "field"), ["l_orderkey", "field"], F.col("l_linestatus") == "F", F.col("l_quantity"), F.col("l_linenumber")).select("l_orderkey", "field", F.col("l_linenumber").alias("best"))


@query("""with m as (select c_custkey as old, c_custkey - c_custkey % 3 as keep from customer where c_custkey % 3 > 0 and c_custkey >= 3), x as (select o_orderkey, coalesce(keep, o_custkey) as person from orders left join m on old = o_custkey)
select person, count(*) as n from x group by person""")  # fmt: skip
def merged_persons(spark, sf):
    """Orders under the person that is kept after merges."""
    kept = table(spark, sf, "customer").where("c_custkey % 3 > 0 and c_custkey >= 3").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") - F.col("c_custkey") % 3).alias("kept"))
    o = relational.remap(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("person")), "person", kept)
    return o.groupBy("person").agg(F.count(F.lit(1)).alias("n"))


@query("""select 'shipped in time' as rule, count(*) filter (where not coalesce(l_shipdate < timestamp '2001-06-01', false)) as broken, count(*) as n from lineitem union all select 'quantity positive', count(*) filter (where not coalesce(l_quantity > 0, false)), count(*) from lineitem""")
def expectations(spark, sf):
    return consistency.expectations(table(spark, sf, "lineitem"), {"shipped in time": F.col("l_shipdate") < F.lit("2001-06-01").cast("timestamp_ntz"), "quantity positive": F.col("l_quantity") > 0})


# ---- entity resolution, hybrid retrieval, training, streams


#: Syllables of made-up names: no two fall together in the phonetic key, whatever they are joined to.
_FIRST = "ba do ki lu ma ne pi ro su ti ga je vi".split()
_GIVEN = ["ramesh", "suresh", "mahesh", "prakash", "lakshmi", "rafiq", "shankar", "manju", "kiran", "deepak", "ganesh"]


def _spelled(n, start: str):
    """A number as a name: a syllable for each of its four last digits in base 13, the number spread so that neighbours
    have few in common."""
    digit = lambda k: F.get(F.array(*map(F.lit, _FIRST)), F.pmod(F.floor(F.pmod(n * 10_007, F.lit(13**4)) / 13**k), F.lit(13)).cast("int"))
    return F.concat(F.lit(start), digit(0), digit(1), digit(2), digit(3), F.lit("r"))


def _people(spark, sf):
    """Customers as records of persons: three in a row are one, spelled in three ways; two neighbours share a surname, and
    thirteen persons in a hundred share one given name; some fathers, ages and case numbers are unknown."""
    k, person = F.col("c_custkey"), F.floor(F.col("c_custkey") / 3)
    of = lambda words, n: F.get(F.array(*map(F.lit, words)), (n % len(words)).cast("int"))
    given = F.when(person % 100 < 13, F.lit("ramesh")).otherwise(F.concat(of(_GIVEN, person), F.lit(" "), of(_FIRST, person), of(_FIRST, F.floor(person / 13)), F.lit("n")))
    surname, father = _spelled(F.floor(person / 2), "k"), _spelled(person * 3 + 4721, "t")
    name = F.when(k % 3 == 0, F.concat_ws(" ", given, surname)).when(k % 3 == 1, F.concat_ws(" ", F.lit("Sri"), given, F.concat(surname, F.lit("u")))).otherwise(F.concat_ws(" ", given, surname, F.lit("@"), _spelled(person + 77, "j")))
    return table(spark, sf, "customer").select(
        k.alias("id"), name.alias("name"), F.when(k % 7 > 0, father).alias("relative_name"), F.when(k % 11 > 0, 20 + person % 37 + k % 2).cast("int").alias("age"), F.concat(F.lit("d"), person % 5).alias("district"), F.when(k % 3 > 0, F.concat(F.lit("ps"), person % 7)).alias("police_station"),
        F.concat_ws(" ", (person % 90).cast("string"), _spelled(person * 5 + 11, "s"), _spelled(person * 11 + 5, "")).alias("address"), F.array(_spelled(person + 5, "n")).alias("co_accused"), F.when(k % 9 < 3, F.array(F.concat(F.lit("CNR"), person))).alias("cnrs"),
    )


@query()
def er_cluster(spark, sf):
    """Customers as persons, blocked by name tokens, aliases and case numbers, scored by fifteen features, clustered under
    vetoes. No key is skipped: a key of very many records is cut by age, as ages ten years apart are a veto."""
    return matching.clusters_of(matching.blocked(_people(spark, sf)))


@query()
def er_pairs(spark, sf):
    return matching.blocked(_people(spark, sf)).pairs()


@query()
def er_sweep(spark, sf):
    """Pairwise precision and recall at five thresholds, each with clusters of its own, from one pass over the links."""
    people, thresholds = _people(spark, sf), [0.6, 0.75, 0.85, 0.92, 0.97]
    under = matching.blocked(people)
    links = checkpointed(under.pairs(min(thresholds)).where(F.col("p") >= min(thresholds)))
    return matching.cluster_sweep(links, people.withColumn("person", F.floor(F.col("id") / 3)), "person", thresholds, under.clusters(links, ages=False, sweep=thresholds))


@query()
def duplicate_queue(spark, sf):
    """Every tenth customer is new and probed against the kept index of the others; every third pair is queued already."""
    people = _people(spark, sf)
    index = matching.BlockIndex(spark, f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}")
    index.add(matching.prepared(people.where("id % 10 > 0")), "old")
    scored = checkpointed(index.probe(matching.prepared(people.where("id % 10 = 0")), least=matching.REVIEW).where("decision <> 'no_link'"))
    return matching.duplicate_queue(scored, scored.where("(a + b) % 3 = 0").select(F.concat_ws(":", "a", "b").alias("ref")))


_OKAPI = """d as (select doc_id as id, regexp_extract_all(lower(text), '[a-z0-9]+') as ts from documents), t as (select id, unnest(ts) as term from d), tf as (select id, term, count(*) as tf from t group by all), l as (select id, len(ts) as dl from d), s as (select count(*) as n, avg(dl) as a from l),
df as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf cross join s group by term, n), fl as (select avg(raw) * 0.25 as f from df), idf as (select term, case when raw < 0 then f else raw end as idf from df cross join fl),
q as (select query, term, count(*) as times from (select item_id as query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark) group by all),
sc as (select query, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a)) * times), 6) as score from q join tf using (term) join idf using (term) join l using (id) cross join s group by query, id)"""


@query(f"with {_OKAPI} select query, id, score, place from (select *, row_number() over (partition by query order by score desc, id) as place from sc) where place <= 5")
def bm25_okapi(spark, sf):
    return retrieval.bm25_okapi(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 5)


@query()
def latent_topk(spark, sf):
    return retrieval.latent_hybrid(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 5)


_COSINE = """tk as (select doc_id as id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents), ctf as (select id, term, count(*) as tf from tk group by all), cn as (select count(*) as n from documents),
cidf as (select term, ln((1 + n) / (1 + count(*))) + 1 as idf from ctf cross join cn group by term, n), cqt as (select item_id as id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark), cqf as (select id, term, count(*) as tf from cqt group by all),
dw as (select id, term, (1 + ln(tf)) * idf as w from ctf join cidf using (term)), qw as (select id, term, (1 + ln(tf)) * idf as w from cqf join cidf using (term)), dn as (select id, sqrt(sum(w * w)) as m from dw group by id), qn as (select id, sqrt(sum(w * w)) as m from qw group by id),
cs as (select q.id as query, d.id as id, round(sum(q.w * d.w) / any_value(dn.m) / any_value(qn.m), 6) as score from qw q join dw d on q.term = d.term join dn on dn.id = d.id join qn on qn.id = q.id group by q.id, d.id)"""
_PLAIN_BM25 = """d as (select doc_id as id, regexp_extract_all(lower(text), '[a-z0-9]+') as ts from documents), t as (select id, unnest(ts) as term from d), tf as (select id, term, count(*) as tf from t group by all), l as (select id, len(ts) as dl from d), s as (select count(*) as n, avg(dl) as a from l), df as (select term, count(*) as df from tf group by term),
q as (select distinct item_id as query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark),
bs as (select query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) as score from q join tf using (term) join df using (term) join l using (id) cross join s group by query, id)"""


@query(f"""with {_COSINE}, {_PLAIN_BM25}, b as (select query, id, score / max(score) over (partition by query) as b from bs), h as (select query, id, round(0.5 * coalesce(b, 0) + 0.5 * greatest(coalesce(score, 0), 0), 6) as score from b full outer join cs using (query, id))
select query, id, score, place from (select *, row_number() over (partition by query order by score desc, id) as place from h) where place <= 5 and score > 0.15""")  # fmt: skip
def hybrid_topk(spark, sf):
    return retrieval.hybrid(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 5)


@query()
def ml_delay(spark, sf):
    """Boosted trees on early orders, scored on later ones: AUC, Brier score and calibration come from `metrics`."""
    o, ship = table(spark, sf, "orders"), table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.max(F.col("l_returnflag") == "R").cast("int").alias("label"))
    rows = o.join(ship, "o_orderkey").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("double").alias("price"), F.col("n_lines").cast("double").alias("n_lines"), F.col("quantity").cast("double").alias("quantity"), "label")
    return training.holdout_scores(rows, ["price", "n_lines", "quantity"], "label", F.col("year") <= 1996, "o_orderkey")


@query()
def pair_training(spark, sf):
    """Logistic weights of a pair model, classes balanced by weight."""
    e = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_discount").cast("double").alias("discount"), F.col("l_quantity").cast("double").alias("quantity"))
    return training.logistic_weights(e, ["discount", "quantity"], "label")


@query("select user_id, count(*) as n, max(event_id) as last_event from events group by user_id")
def nightly_stream(spark, sf):
    """All events as a stream that ends with its input: each batch's users are computed anew from the whole table."""
    return monitoring.recompute_to_table(spark, f"{sf}/event[s].parquet", "user_id", lambda touched: table(spark, sf, "events").join(touched, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event")))


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as k, count(*) over (partition by user_id) as n from events) select user_id, event_id from r where k <= 3""")
def first_per_list(spark, sf):
    """At most three pieces of evidence a person, earliest first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("_k", F.row_number().over(w)).where("_k <= 3").select("user_id", "event_id")


# ---- detectors, derived maxima, names, evaluation

_FACTS = [
    (1, "grounds_of_arrest", "not_recorded", 0.9), (1, "arrest_datetime", "2024-01-05T19:30", 0.95), (1, "production_datetime", "2024-01-07T10:00", 0.75), (1, "gender", "Female", 0.9), (1, "woman_officer_present", "no", 0.9),
    (2, "remand_reasons", "as prayed", 0.9), (2, "recovery", "Recovered in presence of no independent panch", 0.9), (2, "offence_datetime", "2024-01-01", 0.95), (2, "fir_datetime", "2024-01-09", 0.95), (2, "charge_sheet_offence_date", "2024-01-02", 0.95),
    (3, "grounds_of_arrest", "yes", 0.9), (3, "fir_delay_reason", "illness", 0.9), (3, "offence_datetime", "2024-01-01", 0.95), (3, "fir_datetime", "2024-01-09", 0.95),
]


@query(_expected(_values([(1, "GROUNDS_NOT_COMMUNICATED", 0.8883), (1, "PRODUCTION_BEYOND_24H", 0.8875), (1, "WOMAN_ARRESTED_AT_NIGHT", 0.7942), (2, "DATE_CONTRADICTION_FIR_CHARGESHEET", 0.6108), (2, "FIR_DELAY_UNEXPLAINED", 0.6108), (2, "MECHANICAL_REMAND", 0.705), (2, "SEIZURE_WITHOUT_INDEPENDENT_WITNESS", 0.5883)], "i, code, rank"), 3, "code, rank"), dates="rank")
def lapse_detectors(spark, sf):
    """One of three sets of facts for each customer, and what it lacks."""
    told = spark.createDataFrame([(*r, k) for k, r in enumerate(_FACTS)], "i int, field string, value string, confidence double, n int")
    f = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(F.broadcast(told), F.col("id") % 3 + 1 == F.col("i"))  # fourteen rows
    f = f.select("id", "field", "value", "confidence", F.lit(False).alias("reviewed"), (F.col("id") * 100 + F.col("n")).alias("fact_id"))
    return detectors.detect(detectors.wide_facts(f, "id"), "id").select("id", "code", F.col("rank").cast("decimal(5,4)").alias("rank"))


@query("""with p as (select p_partkey, p_size as m, case p_partkey % 5 when 0 then 'life' when 1 then 'none' else 'term' end as k, case p_partkey % 7 when 0 then 'attempt' when 1 then 'abetment' when 2 then 'abetment_not_committed' when 3 then 'conspiracy' when 4 then 'common_intention' end as f from part)
select p_partkey, case when k = 'none' or f is null or f in ('abetment', 'common_intention') then k when f = 'conspiracy' and (k = 'life' or m >= 24) then k else 'term' end as kind,
cast(case when k = 'none' or f is null or f in ('abetment', 'common_intention') then m when f = 'conspiracy' then case when k = 'life' or m >= 24 then m else 6 end when k = 'life' then case f when 'attempt' then 120 else 84 end when f = 'attempt' then ceil(m / 2) else ceil(m / 4) end as int) as months from p""")  # fmt: skip
def derived_maximum(spark, sf):
    k = F.col("p_partkey")
    kind = F.when(k % 5 == 0, "life").when(k % 5 == 1, "none").otherwise("term")
    modifier = F.when(k % 7 == 0, "attempt").when(k % 7 == 1, "abetment").when(k % 7 == 2, "abetment_not_committed").when(k % 7 == 3, "conspiracy").when(k % 7 == 4, "common_intention")
    return table(spark, sf, "part").select("p_partkey", rules.derived_term(kind, F.col("p_size"), modifier).alias("t")).select("p_partkey", "t.*")


@query("""with c as (select c_custkey as id, 'k' || translate(c_custkey::varchar, '0123456789', 'abdefghilm') as s from customer)
    select id, (['ravi ' || s || ' k', 'mohammed rafiq ' || s, 'ar', ''])[id % 4 + 1] as primary_name, case id % 4 when 0 then 'raju' else '' end as aliases, case id % 4 when 0 then s else '' end as relative from c""")
def name_parts(spark, sf):
    """Customers' names in four ways of writing them, spelled from their keys."""
    k = F.col("c_custkey")
    s = F.concat(F.lit("k"), F.translate(k.cast("string"), "0123456789", "abdefghilm"))
    name = F.when(k % 4 == 0, F.concat(F.lit("Sri Ravi "), s, F.lit(" Ke @ Raju s/o Late "), s)).when(k % 4 == 1, F.concat(F.lit("Md. Rafiq "), s)).when(k % 4 == 2, F.lit("Ar"))
    x = spread(table(spark, sf, "customer").select("c_custkey")).select(k.alias("id"), F.explode(F.array(text.normalised_name(name))).alias("n"))
    return x.select("id", F.array_join("n.primary", " ").alias("primary_name"), F.coalesce(F.array_join(F.flatten("n.aliases"), ","), F.lit("")).alias("aliases"), F.array_join("n.relative", " ").alias("relative"))


@query("""with f as (select distinct l_orderkey as k, l_returnflag as g from lineitem where l_quantity > 10), t as (select distinct l_orderkey as k, l_returnflag as g from lineitem where l_discount > 0.03),
j as (select coalesce(f.g, t.g) as g, f.k is not null as f, t.k is not null as t from f full outer join t on f.k = t.k and f.g = t.g), c as (select g, count(*) filter (where f and t) as tp, count(*) filter (where not t) as fp, count(*) filter (where not f) as fn from j group by g)
select g, tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall from c""")  # fmt: skip
def extraction_prf(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("g"), "l_quantity", "l_discount")  # noqa: E741
    return metrics.set_prf(l.where("l_quantity > 10"), l.where("l_discount > 0.03"), ["k", "g"], "g")


@query("""with t as (select unnest([0.2, 0.5, 0.8]) as t), s as (select l_discount * 8 + 0.1 as p, l_returnflag = 'R' as y from lineitem) select cast(t as double) as threshold, round(count(*) filter (where p >= t and y) / nullif(count(*) filter (where p >= t), 0), 6) as precision, round(count(*) filter (where p >= t and y) / count(*) filter (where y), 6) as recall from s, t group by t""")
def threshold_sweep(spark, sf):
    s = table(spark, sf, "lineitem").select((F.col("l_discount") * 8 + 0.1).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return metrics.threshold_sweep(s, "p", "y", [0.2, 0.5, 0.8])


# ---- classes of documents and causes of adjournments, over texts that keys put together

_TITLES = ["First Information Report, F.I.R.", "Arrest memo with the grounds of arrest", "order on remand: judicial custody", "final report u/s 173", "Order sheet. Call on", "in the result he is convicted", "enlarged on bail with surety", "UTP No of the prisoner", "nothing of note", "order sheet and judgment", "MLC"]


def _pieces(spark, sf):
    k = F.col("o_orderkey")
    title = lambda n: F.get(F.array(*map(F.lit, _TITLES)), (n % len(_TITLES)).cast("int"))
    return table(spark, sf, "orders").select(k.alias("k"), F.concat(title(k), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("; "), title(F.floor(k / 7))))).alias("t"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_PIECES = f"pc as (select o_orderkey as k, list_extract({_sql_list(_TITLES)}, cast(o_orderkey % 11 as int) + 1) || case when o_orderkey % 3 = 0 then '' else '; ' || list_extract({_sql_list(_TITLES)}, cast((o_orderkey // 7) % 11 as int) + 1) end as t from orders)"
_HIT = "cast(regexp_matches(t, '(?i){}') as int)"
_HITS = ", ".join("struct_pack(n := -(" + " + ".join(_HIT.format(p) for p in ps) + f"), i := {i}, l := '{k}')" for i, (k, ps) in enumerate(documents.CLASSES.items()))


@query(f"with {_PIECES}, r as (select k, list_sort([{_HITS}]) as h from pc), v as (select k, h[1].l as l, -h[1].n as a, -h[2].n as b from r) select k, case when a > 0 then l else 'unknown' end as label, case when a >= 2 and a > b then round(least(0.95, 0.6 + 0.15 * a), 2) when a = 1 and b = 0 then 0.7 when a > 0 then 0.5 else 0.0 end as confidence from v", dates="confidence")
def document_class(spark, sf):
    d = _pieces(spark, sf).select("k", documents.document_class(F.col("t")).alias("c"))
    return d.select("k", "c.label", F.col("c.confidence").cast("decimal(3,2)").alias("confidence"))


_REASONS = ["Accused not produced from jail", "Joint request of both sides", "Advocates boycott work", "lockdown", "Presiding officer on leave", "accused is ill", "new counsel filed vakalat", "PP sought time", "at the request of the accused", "defence counsel requested time", "PW-2 examined", "", "adjourned.", "rain", None]


@query(f"with r as (select o_orderkey as k, list_extract([{', '.join('null' if x is None else repr(x) for x in _REASONS)}], cast(o_orderkey % 15 as int) + 1) || case when o_orderkey % 15 < 11 and o_orderkey % 4 = 1 then '; witness absent' else '' end as t from orders) select k, case " + " ".join(f"when regexp_matches(coalesce(t, ''), '(?i){p.replace(chr(39), chr(39) * 2)}') then '{label}'" for p, label, _ in documents.CAUSES) + " end as label from r")
def delay_cause(spark, sf):
    """Who caused each adjournment, by the first of twelve ordered patterns."""
    k = F.col("o_orderkey")
    said = F.get(F.array(*map(F.lit, _REASONS)), (k % 15).cast("int"))
    more = F.when((k % 15 < 11) & (k % 4 == 1), "; witness absent").otherwise("")
    return table(spark, sf, "orders").select(k.alias("k"), documents.delay_cause(F.concat(said, more)).alias("c")).select("k", "c.label")


@query("""with f as (select o_orderkey as k, case o_orderkey % 3 when 0 then 'fir' when 1 then 'remand_order' else 'other' end as c, list_filter([case when o_orderkey % 2 = 0 then 'fir_number' end, case when o_orderkey % 5 = 0 then 'fir_datetime' end, case when o_orderkey % 7 > 0 then 'charge' end, case when o_orderkey % 4 = 0 then 'remand_date' end], lambda x: x is not null) as fs from orders)
select k, array_to_string(case c when 'fir' then list_filter([case when not list_contains(fs, 'fir_number') then 'fir_number' end, case when not list_contains(fs, 'fir_datetime') then 'fir_datetime / offence_datetime' end, case when not list_contains(fs, 'charge') then 'charge' end], lambda x: x is not null)
  when 'remand_order' then list_filter([case when not list_contains(fs, 'remand_date') then 'production_datetime / remand_date' end], lambda x: x is not null) else [] end, ', ') as missing from f""")
def required_fields(spark, sf):
    k = F.col("o_orderkey")
    fields = F.array_compact(F.array(F.when(k % 2 == 0, "fir_number"), F.when(k % 5 == 0, "fir_datetime"), F.when(k % 7 > 0, "charge"), F.when(k % 4 == 0, "remand_date")))
    label = F.when(k % 3 == 0, "fir").when(k % 3 == 1, "remand_order").otherwise("other")
    return table(spark, sf, "orders").select(k.alias("k"), F.array_join(documents.missing_fields(label, fields), ", ").alias("missing"))


@query(f"with {_COSINE} select query, id, score, place from (select *, row_number() over (partition by query order by score desc, id) as place from cs) where place <= 5 and score > 0")
def tfidf_topk(spark, sf):
    return retrieval.tfidf_cosine(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 5)
