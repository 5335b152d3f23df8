"""Queries on whole cases: governing law, priors, the decision from events to status, registers and queues, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import dates, text
from tidewright.operators import decision, detectors, law, metrics, registers, rules
from tidewright.plans.catalog import TODAY, query
from tidewright.sources.readers import table

CUTOFF = "2024-01-01"


def _today():
    return F.lit(TODAY).cast("date")


def _day(text: str):
    return F.lit(text).cast("date")


# ---- fixtures: a user is a person with one case, every sixth with a second one; parts are law records, line items charges

_K = """kase as (select u as p, c, case c % 10 when 0 then 'convicted' when 1 then 'acquitted' when 2 then 'discharged' when 3 then 'investigation' when 4 then 'charge_sheet_filed' else 'trial' end as status,
  case when c % 31 = 0 then 0.7 else 0.9 end as status_confidence, case when c % 10 = 0 then date '2024-01-20' end as conviction_date, case when c % 10 in (1, 2) then date '2024-01-25' end as acquittal_date,
  case when c % 13 > 0 then date '2023-12-01' + cast(c % 40 as int) end as remand, case when c % 3 = 0 then date '2023-12-01' + cast(c % 40 + 30 + c % 60 as int) end as sheet,
  case when c % 4 = 0 then date '2023-12-01' + cast(c % 40 + 55 + c % 20 as int) end as app, case when c % 5 = 0 then date '2024-02-01' + cast(c % 10 as int) end as bail
  from (select distinct user_id as u, user_id as c from events union all select distinct user_id, user_id + 1000000 from events where user_id % 6 = 0)),
conv as (select distinct user_id as p, null::bigint as c, 'final' as status from events where user_id % 4 = 0 union all select distinct user_id, user_id, 'set_aside' from events where user_id % 20 = 10
  union all select distinct user_id, null::bigint, 'juvenile' from events where user_id % 9 = 0 union all select distinct user_id, null::bigint, 'under_appeal' from events where user_id % 7 = 3)"""
_RECORDS = """rec as (select act, section, case when section % 13 = 0 then 'liability_rule' else 'offence' end as kind, case when section % 17 = 5 then 'life' when section % 7 = 2 then 'none' else 'term' end as max_kind,
  cast(1 + m % 2 as int) as max_months, case when section % 12 = 0 then 'term' end as aggravated_kind, case when section % 12 = 0 then cast(3 + m % 4 as int) end as aggravated_months, case when section % 3 = 0 then 1 end as min_months,
  act = 'NDPS' and section % 2 = 0 as special_law, case when act = 'NDPS' and section % 4 = 0 then 75 end as period_days, section % 11 <> 0 as verified
  from (select case p_partkey % 3 when 0 then 'IPC' when 1 then 'BNS' else 'NDPS' end as act, (p_partkey // 3) % 60 as section, min(p_size) as m from part group by all) where not (act = 'IPC' and section >= 55)),
mapping as (select i.section as o, i.section + k as n, i.section % 5 > 0 as verified from (select section from rec where act = 'IPC') i, (select unnest([1, 2]) as k) where k = 1 or i.section % 6 = 0)"""
_CHARGES = f"""ch as (select p, c, case when l_partkey % 5 < 2 then 'IPC' when l_partkey % 5 < 4 then 'BNS' else 'NDPS' end as act, l_partkey % 60 as section, case l_suppkey % 8 when 0 then 'attempt' when 1 then 'conspiracy' end as modifier,
  case when l_linenumber % 4 > 0 then date '2023-12-26' + cast(l_partkey % 12 as int) end as offence_date, l_returnflag = 'R' as aggravated, case when l_discount < 0.005 then 0.7 else 0.9 end as confidence,
  case when l_tax > 0.03 then date '2024-02-01' end as dropped_on, l_linenumber * 100000000 + l_partkey as ordinal from kase join lineitem on l_orderkey = case when c < 1000000 then c else c - 1000000 + 5000 end)"""
_LAW = f"""sides as (select 'IPC' as a, o as s, n as t, verified as v from mapping union all select 'BNS', n, o, verified from mapping),
gov as (select ch.*, case when act not in ('IPC', 'BNS') or offence_date is null then act when offence_date < date '{CUTOFF}' then 'IPC' else 'BNS' end as act_of from ch),
tgt as (select gov.*, (select count(distinct t) from sides where a = act and s = section) as m_n, (select min(t) from sides where a = act and s = section) as m_t, (select min(cast(v as int)) from sides where a = act and s = section) as m_v from gov),
sec as (select *, case when act_of = act then section when m_n = 1 then m_t end as section_of from tgt),
lw as (select sec.*, rec.kind, rec.verified, rec.special_law, rec.period_days, rec.min_months, rec.kind is not null as found, rec.kind = 'offence' as known,
  case when aggravated and aggravated_kind is not null then aggravated_kind else max_kind end as bk, case when aggravated and aggravated_kind is not null then aggravated_months else max_months end as bm
  from sec left join rec on rec.act = act_of and rec.section = section_of),
term as (select *, case when not coalesce(known, false) then null when bk = 'none' or modifier is null then bk when modifier = 'conspiracy' then case when bk = 'life' or bm >= 24 then bk else 'term' end else 'term' end as tk,
  case when bk = 'none' or modifier is null then bm when modifier = 'conspiracy' then case when bk = 'life' or bm >= 24 then bm else 6 end when bk = 'life' then 120 else cast(ceil(bm / 2) as int) end as tm from lw)"""


def _cases(spark, sf):
    u = table(spark, sf, "events").select(F.col("user_id").alias("person_id")).distinct()
    c = u.withColumn("case_id", F.explode(F.array_compact(F.array("person_id", F.when(F.col("person_id") % 6 == 0, F.col("person_id") + 1_000_000)))))
    k = F.col("case_id")
    since = lambda n: F.date_add(_day("2023-12-01"), n.cast("int"))
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in (0, "convicted", 1, "acquitted", 2, "discharged", 3, "investigation", 4, "charge_sheet_filed")]), (k % 10).cast("int")), F.lit("trial"))
    return c.select(
        "person_id", "case_id", status.alias("status"), F.when(k % 31 == 0, 0.7).otherwise(0.9).alias("status_confidence"), F.when(k % 10 == 0, _day("2024-01-20")).alias("conviction_date"), F.when((k % 10).isin(1, 2), _day("2024-01-25")).alias("acquittal_date"),
        F.when(k % 13 > 0, since(k % 40)).alias("first_remand_date"), F.when(k % 3 == 0, since(k % 40 + 30 + k % 60)).alias("charge_sheet_date"), F.when(k % 4 == 0, since(k % 40 + 55 + k % 20)).alias("default_bail_application_date"),
        F.when(k % 5 == 0, F.date_add(_day("2024-02-01"), (k % 10).cast("int"))).alias("bail_granted_date"), F.lit(None).cast("date").alias("anchor_date"),
    )


def _convictions(spark, sf):
    u = F.col("user_id")
    none = F.lit(None).cast("long")
    kinds = F.array_compact(F.array(*[F.when(c, F.struct(of.alias("case_id"), F.lit(s).alias("status"))) for c, of, s in ((u % 4 == 0, none, "final"), (u % 20 == 10, u, "set_aside"), (u % 9 == 0, none, "juvenile"), (u % 7 == 3, none, "under_appeal"))]))
    return table(spark, sf, "events").select("user_id").distinct().select(u.alias("person_id"), F.explode(kinds).alias("x")).select("person_id", "x.*")


def _records(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(F.when(k % 3 == 0, "IPC").when(k % 3 == 1, "BNS").otherwise("NDPS").alias("act"), (F.floor(k / 3) % 60).alias("section"), "p_size")
    r = p.groupBy("act", "section").agg(F.min("p_size").alias("m")).where("not (act = 'IPC' and section >= 55)")
    s, special = F.col("section"), F.col("act") == "NDPS"
    return r.select(
        "act", "section", F.when(s % 13 == 0, "liability_rule").otherwise("offence").alias("kind"), F.when(s % 17 == 5, "life").when(s % 7 == 2, "none").otherwise("term").alias("max_kind"), (1 + F.col("m") % 2).cast("int").alias("max_months"),
        F.when(s % 12 == 0, "term").alias("aggravated_kind"), F.when(s % 12 == 0, 3 + F.col("m") % 4).cast("int").alias("aggravated_months"), F.when(s % 3 == 0, 1).alias("min_months"),
        (special & (s % 2 == 0)).alias("special_law"), F.when(special & (s % 4 == 0), 75).alias("period_days"), (s % 11 != 0).alias("verified"),
    )


def _mapping(spark, sf):
    i = _records(spark, sf).where("act = 'IPC'").select(F.col("section").alias("old"))
    return i.select("old", F.explode(F.array_compact(F.array(F.col("old") + 1, F.when(F.col("old") % 6 == 0, F.col("old") + 2)))).alias("new"), (F.col("old") % 5 > 0).alias("verified"))


def _charges(spark, sf):
    c = _cases(spark, sf).select("person_id", "case_id", F.when(F.col("case_id") < 1_000_000, F.col("case_id")).otherwise(F.col("case_id") - 995_000).alias("_order"))
    p = F.col("l_partkey")
    return c.join(table(spark, sf, "lineitem"), F.col("_order") == F.col("l_orderkey")).select(
        "person_id", "case_id", F.when(p % 5 < 2, "IPC").when(p % 5 < 4, "BNS").otherwise("NDPS").alias("act"), (p % 60).alias("section"), F.when(F.col("l_suppkey") % 8 == 0, "attempt").when(F.col("l_suppkey") % 8 == 1, "conspiracy").alias("modifier"),
        F.when(F.col("l_linenumber") % 4 > 0, F.date_add(_day("2023-12-26"), (p % 12).cast("int"))).alias("offence_date"), (F.col("l_returnflag") == "R").alias("aggravated"), F.when(F.col("l_discount") < 0.005, 0.7).otherwise(0.9).alias("confidence"),
        F.when(F.col("l_tax") > 0.03, _day("2024-02-01")).alias("dropped_on"), (F.col("l_linenumber") * 100_000_000 + p).alias("ordinal"),
    )


def _events(spark, sf):
    e, day, kind = table(spark, sf, "events"), F.to_date("ts"), F.col("event_type")
    return e.select(
        F.col("user_id").alias("person_id"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).cast("long").alias("case_id"),
        F.when(kind == "signup", "judicial_custody").when(kind == "view", "re_arrest").when((kind == "click") & (F.col("event_id") % 41 == 0), "arrest").when((kind == "purchase") & (F.col("event_id") % 4 == 0), "released").when((kind == "error") & (F.col("event_id") % 3 == 0), "on_bail").otherwise("bail_granted").alias("type"),
        day.alias("start"), F.when(kind == "signup", F.date_add(day, 2)).when(kind == "error", F.date_add(day, 1)).alias("end"), (F.col("event_id") % 2 == 0).alias("is_primary"), F.lit(0.9).alias("confidence"),
    )


_WHO = ["accused", "court", "unknown", "both", "accused"]


def _hearings(spark, sf):
    e, day = table(spark, sf, "events").where("event_type = 'click'"), F.to_date("ts")
    k = F.col("event_id")
    return e.select(
        F.col("user_id").alias("person_id"), F.col("user_id").alias("case_id"), day.alias("date"), F.when(k % 7 > 0, F.date_add(day, (1 + k % 5).cast("int"))).alias("next_date"), F.get(F.array(*map(F.lit, _WHO)), F.floor(k / 7).cast("int") % 5).alias("attribution"), F.lit(0.9).alias("confidence"), F.lit(False).alias("verified"),
    )


# ---- law and priors


@query(f"with {_K}, {_RECORDS}, {_CHARGES}, {_LAW} select p as person_id, c as case_id, ordinal, act_of, coalesce(section_of, -1) as section_of, tk as term_kind, case when tk = 'term' then tm end as term_months, act_of <> act as transition, not found as no_record, act_of <> act and m_n <> 1 as ambiguous, coalesce(act_of <> act and found and m_v = 0, false) as unverified_mapping from (select *, coalesce(found, false) from term)")
def governing_law(spark, sf):
    """Every charge with the law that governs its punishment and the maximum that follows."""
    g = law.governed(_charges(spark, sf), _records(spark, sf), _mapping(spark, sf), _day(CUTOFF))
    has = lambda code: F.array_contains("law_flags", code)
    return g.select(
        "person_id", "case_id", "ordinal", "act_of", F.coalesce("section_of", F.lit(-1)).alias("section_of"), F.col("term.kind").alias("term_kind"), F.when(F.col("term.kind") == "term", F.col("term.months")).alias("term_months"),
        has("IPC_BNS_TRANSITION_MISMATCH").alias("transition"), has("NO_RECORD").alias("no_record"), has("MAPPING_AMBIGUOUS_OR_MISSING").alias("ambiguous"), has("UNVERIFIED_MAPPING").alias("unverified_mapping"),
    )


@query(f"with {_K} select p as person_id, c as case_id, not exists (select 1 from conv v where v.p = kase.p and (v.c is null or v.c <> kase.c) and v.status in ('final', 'under_appeal')) as first_offender, exists (select 1 from conv v where v.p = kase.p and v.status = 'juvenile') as juvenile from kase")
def prior_convictions(spark, sf):
    f = decision.first_offenders(_cases(spark, sf), _convictions(spark, sf))
    return f.select("person_id", "case_id", "first_offender", F.array_contains("prior_flags", "JUVENILE_ADJUDICATION").alias("juvenile"))


@query("with o as (select p_partkey as k, p_partkey % 2 = 0 as v, 'reviewer ' || (p_partkey % 3) as w from part where p_partkey % 3 = 0) select p_partkey, coalesce(o.v, p_size > 25) as verified, o.w as verified_by from part left join o on o.k = p_partkey")
def verification_overlay(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") > 25).alias("verified"))
    o = p.where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("verified"), F.concat(F.lit("reviewer "), (F.col("p_partkey") % 3).cast("string")).alias("verified_by"))
    return law.overlaid(p, o, "p_partkey")


# ---- the decision


def _timeline_sql(x: str, events: str) -> str:
    """Counted days (p, c, d) of each case under the prefix x, a day a row, and its arrests."""
    return f"""{x}ev as ({events}),
{x}ch as (select p, c, coalesce(min(s) filter (where event_id % 2 = 0), min(s)) as a, count(*) filter (where event_id % 2 = 0) = 0 as weak, count(distinct s) filter (where event_id % 2 = 0) > 1 as torn from {x}ev where k = 'click' and event_id % 41 = 0 group by p, c),
{x}cl as (select p, c, k, s, case when k = 'signup' then s + 2 when k = 'error' then s + 1 else coalesce((select min(r.s) from {x}ev r where r.p = v.p and r.c = v.c and r.k = 'purchase' and r.event_id % 4 = 0 and r.s >= v.s), date '{TODAY}') end as e
  from {x}ev v where k in ('signup', 'view') or (k = 'error' and event_id % 3 = 0) or (k = 'click' and event_id % 41 = 0 and s = (select a from {x}ch h where h.p = v.p and h.c = v.c))),
{x}dd as (select distinct p, c, k = 'error' as x, cast(unnest(generate_series(cast(s as timestamp), cast(least(e, date '{TODAY}') as timestamp), interval 1 day)) as date) as d from (select distinct p, c, k, s, e from {x}cl where e >= s)),
{x}ct as (select p, c, d from {x}dd where not x except select p, c, d from {x}dd where x)"""


_DECISION = f"""with {_K}, {_RECORDS}, {_CHARGES}, {_LAW},
st as (select *, status = 'convicted' and exists (select 1 from conv v where v.p = kase.p and v.c = kase.c and v.status = 'set_aside') as aside from kase),
now as (select *, case when aside then 'trial' else status end as sn, case when status = 'convicted' and not aside then conviction_date end as stop from st),
oth as (select *, sum(cast(sn in ('investigation', 'charge_sheet_filed', 'trial') as int)) over (partition by p) - cast(sn in ('investigation', 'charge_sheet_filed', 'trial') as int) as others from now),
{_timeline_sql("a_", "select user_id as p, kase.c, event_type as k, event_id, cast(ts as date) as s from events join kase on kase.p = user_id and (event_id % 3 > 0 or kase.c = user_id)")},
{_timeline_sql("b_", "select user_id as p, kase.c, event_type as k, event_id, cast(ts as date) as s from events join kase on kase.p = user_id where kase.c <> user_id and user_id in (select user_id from events where event_id % 3 = 0)")},
cu as (select t.p, t.c, d from a_ct t join oth on oth.p = t.p and oth.c = t.c where stop is null or d <= stop),
anc as (select p, c, min(s) as a from a_ev group by p, c),
le as (select ev.p, ev.c, count(t.d) as n from (select distinct p, c from b_ev) ev join oth on oth.p = ev.p and oth.c = ev.c left join anc on anc.p = ev.p and anc.c = ev.c left join b_ct t on t.p = ev.p and t.c = ev.c and (stop is null or t.d <= stop) and t.d >= anc.a group by ev.p, ev.c),
h as (select user_id as p, user_id as c, cast(ts as date) as s, case when event_id % 7 > 0 then cast(ts as date) + cast(1 + event_id % 5 as int) end as n, (event_id // 7) % 5 as w from events where event_type = 'click'),
hd as (select distinct p, c, w in (0, 4) as acc, cast(unnest(generate_series(cast(s as timestamp), cast(n - 1 as timestamp), interval 1 day)) as date) as d from (select distinct * from h where n > s and w in (0, 2, 3, 4))),
ad as (select p, c, d from hd where acc intersect select * from cu), ud as (select p, c, d from hd where not acc intersect select * from cu except select p, c, d from hd where acc),
tn as (select p, c, count(*) as n from (select p, c, s from (select *, case w when 0 then 'accused' when 4 then 'accused' when 1 then 'court' when 3 then 'both' end as who from h where w <> 2) group by p, c, s having count(distinct who) > 1 and bool_or(who = 'accused')) group by p, c),
lo as (select *, row_number() over (partition by p, c order by case tk when 'life' then 2 when 'term' then 1 else 0 end desc, case when tk = 'term' then tm else 0 end desc, ordinal) as r from term where dropped_on is null or dropped_on > date '{TODAY}'),
lk as (select p, c, count(*) filter (where known) as n_charges, count(distinct case when known then act_of || ':' || section_of end) as n_offences, bool_and(tk = 'none') filter (where known) as fine, bool_or(special_law) filter (where known) as special,
  count(*) filter (where coalesce(kind, '') <> 'liability_rule' and confidence < 0.8) + count(*) filter (where not found) + count(*) filter (where known and not verified) as n_law from (select * replace (coalesce(found, false) as found, coalesce(known, false) as known) from lo) group by p, c),
top as (select p, c, tk, case when tk = 'term' then tm end as tm, min_months, period_days from (select *, row_number() over (partition by p, c order by case tk when 'life' then 2 when 'term' then 1 else 0 end desc, case when tk = 'term' then tm else 0 end desc, ordinal) as q from lo where coalesce(known, false)) where q = 1),
w as (select o.*, (select count(*) from cu where cu.p = o.p and cu.c = o.c) as days, exists (select 1 from cu where cu.p = o.p and cu.c = o.c and d = date '{TODAY}') as inside, (select count(*) from cu where cu.p = o.p and cu.c = o.c and d > acquittal_date) as after_end,
  (select count(*) from ad where ad.p = o.p and ad.c = o.c) as acc, (select count(*) from ud where ud.p = o.p and ud.c = o.c) as unc, le.n as len, coalesce(cast(a.weak as int), 0) + coalesce(cast(a.torn as int), 0) as n_low,
  coalesce(tn.n, 0) + coalesce(lk.n_law, 0) + cast(status_confidence < 0.8 as int) as n_more, coalesce(lk.n_charges, 0) as n_charges, coalesce(lk.n_offences, 0) as n_offences, coalesce(fine, false) as fine, coalesce(special, false) as special, tk, tm, min_months, period_days,
  not exists (select 1 from conv v where v.p = o.p and (v.c is null or v.c <> o.c) and v.status in ('final', 'under_appeal')) as first, exists (select 1 from cu where cu.p = o.p and cu.c = o.c and d = bail + 7 and bail + 7 <= date '{TODAY}') as held
  from oth o left join le on le.p = o.p and le.c = o.c left join a_ch a on a.p = o.p and a.c = o.c left join tn on tn.p = o.p and tn.c = o.c left join lk on lk.p = o.p and lk.c = o.c left join top on top.p = o.p and top.c = o.c),
y as (select *, greatest(days - acc, 0) as counted, n_low + n_more as needs, case when tk = 'term' then cast(ceil(tm * 36525 / 1200.0) as bigint) end as mx, case when tk = 'term' then cast(ceil(tm * 36525 / case when first then 3600.0 else 2400.0 end) as bigint) end as thr,
  sn in ('investigation', 'charge_sheet_filed', 'trial') and inside as live, greatest(case when tk = 'life' then 90 else 60 end, coalesce(period_days, 0)) as period, len - acc as lenient from w),
z as (select *, case when sn = 'convicted' then 'NOT_APPLICABLE' when sn in ('acquitted', 'discharged') then case when after_end > 0 and others = 0 then 'CRITICAL_ACQUITTED_DETAINED' else 'NOT_APPLICABLE' end
   when not inside then case when n_low > 0 then 'REVIEW' else 'NOT_APPLICABLE' end when n_charges = 0 then 'REVIEW' when tk = 'life' then case when needs > 0 then 'REVIEW' else 'EXCLUDED_479' end when fine then 'REVIEW' when counted >= mx then 'CRITICAL_MUST_RELEASE'
   when special then 'REVIEW' when others > 0 then 'REVIEW_MULTIPLE_CASES' when n_offences > 1 then 'REVIEW' when lenient is not null and (lenient >= thr) <> (counted >= thr) then 'REVIEW' when needs > 0 then 'REVIEW' when counted >= thr then 'ELIGIBLE' else 'NOT_YET' end as status_out,
  case when not live then null when remand is null then case when sheet is null and status = 'investigation' then 'DEFAULT_BAIL_REVIEW' end when tk is null then null when sheet < remand then 'DEFAULT_BAIL_REVIEW'
   when sheet is null and date '{TODAY}' >= remand + period then case when app >= remand + period then 'DEFAULT_BAIL_RIGHT_ASSERTED' else 'URGENT_DEFAULT_BAIL' end when sheet is null then case when remand + period - date '{TODAY}' <= 7 then 'DEFAULT_BAIL_WINDOW_SOON' end
   when sheet < remand + period then null when app >= remand + period and app < sheet then 'DEFAULT_BAIL_RIGHT_ASSERTED' when app = sheet or app < remand + period then 'DEFAULT_BAIL_REVIEW' else 'DEFAULT_BAIL_RIGHT_LOST' end as dflt,
  case when live and held then 'CRITICAL_BAIL_NOT_FURNISHED' end as surety,
  case when not live then null when min_months is not null and counted >= ceil(min_months * 36525 / 1200.0) then 'TIME_SERVED_EXCEEDS_MINIMUM' when tk = 'term' and counted * 2 >= mx then 'TIME_SERVED_SUBSTANTIAL' end as served from y),
f as (select *, case when status_out = 'CRITICAL_MUST_RELEASE' then counted - mx when status_out in ('ELIGIBLE', 'REVIEW', 'REVIEW_MULTIPLE_CASES') and counted >= thr then counted - thr end as overdue from z),
nd as (select p, c, d, row_number() over (partition by p, c order by d) as i from (select p, c, d from cu except select p, c, d from ad))"""


@query(f"""{_DECISION}
select p as person_id, c as case_id, sn as status_now, days as custody_days, counted as counted_days, mx as max_days, thr as threshold_days, first as first_offender, status_out, concat_ws(',', dflt, surety, served) as findings, overdue as days_overdue,
  case when overdue is not null then (select min(d) from nd where nd.p = f.p and nd.c = f.c and i = case when status_out = 'CRITICAL_MUST_RELEASE' then mx else thr end) end as eligible_from,
  case when live and tk = 'term' and not fine and not special and counted < thr then date '{TODAY}' + cast(thr - counted as int) end as projected,
  (select x from (select unnest([status_out, dflt, surety, served]) as x) where x is not null order by coalesce(list_position({rules.URGENCY!r}, x), 99) limit 1) as urgency,
  concat_ws(',', case when aside then 'CONVICTION_SET_ASIDE_REASSESS' end, case when sn in ('acquitted', 'discharged') and after_end > 0 then case when others = 0 then 'ACQUITTED_BUT_DETAINED' else 'DETAINED_IN_OTHER_CASE' end end,
    case when live and tk = 'term' and unc > 0 and ((counted >= mx and counted - unc < mx) or (counted >= thr and counted - unc < thr)) then 'DELAY_ATTRIBUTION_AFFECTS_RESULT' end, case when status_out in ('CRITICAL_MUST_RELEASE', 'CRITICAL_ACQUITTED_DETAINED') and needs > 0 then 'CRITICAL_NEEDS_VERIFICATION' end) as decision_flags
from f""", dates="eligible_from projected")  # fmt: skip
def case_decision(spark, sf):
    """From custody events, hearings, charges, law records and convictions to the status of every case."""
    d = decision.decide(_cases(spark, sf), _events(spark, sf), _hearings(spark, sf), _charges(spark, sf), _records(spark, sf), _mapping(spark, sf), _convictions(spark, sf), _today(), _day(CUTOFF))
    return d.select(
        "person_id", "case_id", "status_now", "custody_days", "counted_days", "max_days", "threshold_days", "first_offender", "status_out", F.array_join("findings", ",").alias("findings"), "days_overdue",
        "eligible_from", "projected", "urgency", F.array_join("decision_flags", ",").alias("decision_flags"),
    )


# ---- registers and queues


@query("""with c as (select o_custkey as k, count(*) as n, max(o_orderkey % 400) as most, sum(o_orderkey % 3) as needs, string_agg(cast(o_orderkey as varchar) || o_orderstatus, ',' order by o_orderkey) as ids from orders group by 1)
select c_custkey, coalesce(n, 0) as n_cases, coalesce(most, 0) as most_days, coalesce(needs, 0)::bigint as all_needs, coalesce(ids, '') as ids from customer left join c on k = c_custkey""")
def person_summary(spark, sf):
    """A person's cases in one row: ordered list, number, most days in custody, sum of open needs."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 400).alias("days"), (F.col("o_orderkey") % 3).alias("needs"))
    s = registers.summary(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"], ["id"], "days", "needs")
    ids = F.array_join(F.transform("cases", lambda x: F.concat(x["id"].cast("string"), x["status"])), ",")
    return s.select("c_custkey", F.col("n_cases").cast("long").alias("n_cases"), "most_days", "all_needs", ids.alias("ids"))


@query("select o_orderkey, case when o_orderkey % 4 = 0 and o_orderkey % 3 > 0 then o_orderstatus || '!' else o_orderstatus end as value from orders where coalesce(o_custkey % 7 = 0, false) or o_orderpriority = '1-URGENT' or o_totalprice > 300000")
def visible_facts(spark, sf):
    """Facts that one of three ways lets through, under the value that counts."""
    k = F.col("o_orderkey")
    o = registers.visible(table(spark, sf, "orders"), F.col("o_custkey") % 7 == 0, F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 300000)
    return o.select("o_orderkey", registers.effective(F.col("o_orderstatus"), F.when(k % 3 > 0, F.concat("o_orderstatus", F.lit("!"))), F.when(k % 4 == 0, "corrected").otherwise("confirmed")).alias("value"))


@query("select c_custkey, c_mktsegment, case when c_name is not null then '[hidden]' end as c_name, case when c_acctbal is not null then '[hidden]' end as c_acctbal from customer")
def redacted_register(spark, sf):
    return registers.redacted(table(spark, sf, "customer"), ["c_custkey", "c_mktsegment"], ["c_name", "c_acctbal"])


@query("select event_id, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.ref'), 'verified') as intake from events")
def json_default(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.page"), registers.json_or(F.col("props"), "ref", "verified")).alias("intake"))


@query("select o_orderkey, not (cast(o_orderdate as date) = date '1998-06-01' and o_orderpriority = '1-URGENT' and o_orderstatus = 'F') as stale from orders")
def result_freshness(spark, sf):
    r = table(spark, sf, "orders").withColumn("as_of", F.to_date("o_orderdate"))
    return registers.fresh(r, F.lit("1998-06-01").cast("date"), {"o_orderpriority": "1-URGENT", "o_orderstatus": "F"}).select("o_orderkey", "stale")


@query("with v as (select o_custkey, list_sort(list(distinct o_orderpriority)) as p, min(o_orderpriority) as m from orders group by 1) select o_custkey, array_to_string(list_filter(p, lambda x: x <> m), ',') as others from v")
def name_variants(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"), F.min("o_orderpriority").alias("m"))
    return g.select("o_custkey", F.array_join(registers.variants(F.col("m"), F.col("p"), F.array("m")), ",").alias("others"))


@query("""with v as (select l_orderkey as k, l_returnflag as v, 1 - exp(sum(ln(greatest(1 - l_discount * 8, 1e-9)))) as c, count(*) as n from lineitem group by all)
select k, arg_min(v, (-round(c, 9), v)) as value, round(arg_min(c, (-round(c, 9), v)), 6) as confidence, arg_min(n, (-round(c, 9), v)) as n_sources, count(*) > 1 as disputed from v group by k""")
def fused_readings(spark, sf):
    """Readings of one field from several sources: agreement raises the confidence, other readings dispute it."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("value"), (F.col("l_discount") * 8).alias("c"))  # noqa: E741
    return registers.fused_confidence(l, ["k"], "value", "c")


@query("""with s as (select o_orderkey, cast(o_orderdate as date) as d from orders) select o_orderkey, cast(floor((date '2024-02-15' - d) / 365.25) as int) as age from s""")
def ages(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.age_in_years(F.to_date("o_orderdate"), _today()).alias("age"))


@query("select c_custkey, upper(regexp_replace(c_name || '/' || c_custkey, '[^A-Za-z0-9]', '', 'g')) as reference from customer")
def reference_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.reference_key(F.concat("c_name", F.lit("/"), F.col("c_custkey").cast("string"))).alias("reference"))


@query("""with o as (select l_orderkey as k, l_linenumber * 100000000 + l_partkey as ordinal, case l_partkey % 6 when 0 then 'life' when 1 then 'none' else 'term' end as kind, l_quantity::int as months, l_partkey % 9 as offence from lineitem),
r as (select *, row_number() over (partition by k order by case kind when 'life' then 2 when 'term' then 1 else 0 end desc, months desc, ordinal) as q from o)
select k, max(case when q = 1 then kind end) as term_kind, max(case when q = 1 then months end) as term_months, count(*) as n_charges, count(distinct offence) as n_offences from r group by k""")
def most_serious(spark, sf):
    p = F.col("l_partkey")
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 100_000_000 + p).alias("ordinal"), F.when(p % 6 == 0, "life").when(p % 6 == 1, "none").otherwise("term").alias("term_kind"), F.col("l_quantity").cast("int").alias("term_months"), (p % 9).alias("offence"))
    return rules.most_serious(c, "k")


@query("""with s as (select l_discount * 8 + 0.1 as p, cast(l_returnflag = 'R' as int) as y from lineitem), q as (select quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from s)
select cast(len(list_filter(list_distinct(e), lambda x: x < p)) as int) as bin, count(*) as n, round(avg(p), 6) as predicted, round(avg(y), 6) as observed from s cross join q group by 1""")
def decile_calibration(spark, sf):
    """Mean prediction and rate in groups between the deciles of the predictions."""
    s = table(spark, sf, "lineitem").select((F.col("l_discount") * 8 + 0.1).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return metrics.decile_calibration(s, "p", "y")


@query("""with s as (select o_custkey as g, o_orderkey as id, cast(o_orderdate as date) - date '1995-01-01' as t, o_orderkey % 3 > 0 as e, o_totalprice as r from orders),
p as (select a.r as x, b.r as y from s a join s b on a.g = b.g and a.e and a.t < b.t) select round(sum(case when x > y then 1 when x = y then 0.5 else 0 end) / count(*), 6) as c_index, count(*) as pairs from p""")
def concordance(spark, sf):
    """Of comparable pairs of a stratum (one ends, and before the other) how many have the higher risk first."""
    o = table(spark, sf, "orders").select("o_custkey", F.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("t"), (F.col("o_orderkey") % 3 > 0).alias("ended"), F.col("o_totalprice").alias("risk"))
    return metrics.concordance(o, ["o_custkey"], "t", "ended", "risk")


@query("""with s as (select cast(o_orderdate as date) - date '1995-01-01' as t, o_orderkey % 3 > 0 as e, o_totalprice as r from orders),
p as (select a.r as x, b.r as y from s a join s b on a.e and (a.t < b.t or (a.t = b.t and not b.e))) select round(sum(case when x > y then 1 when x = y then 0.5 else 0 end) / count(*), 6) as c_index, count(*) as pairs from p""")
def concordance_all(spark, sf):
    """The same over all comparable pairs of orders, counted and not formed."""
    o = table(spark, sf, "orders").select(F.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("t"), (F.col("o_orderkey") % 3 > 0).alias("ended"), F.col("o_totalprice").alias("risk"))
    return metrics.concordance_all(o, "t", "ended", "risk")


# ---- what follows from a case, over facts that keys put together

_FACT = {
    "witnesses": ["PC 12; Inspector Rao", "Ravi, PSI Nair", "the complainant", None], "fsl_status": ["awaited", "received", "NIL"], "tip_status": ["held on 2024", "not held"], "confession": ["before the IO", "to a priest", None],
    "recovery": ["no panch present", "two panchas", None], "remand_reasons": ["as prayed", "he may flee and tamper with the evidence", None],
}


def _fact_sql(name: str, values: list) -> str:
    return f"list_extract([{', '.join('null' if v is None else repr(v) for v in values)}], cast((o_orderkey // {len(name)}) % {len(values)} as int) + 1)"


_FACTS_SQL = "fa as (select o_orderkey as k, " + ", ".join(f"{_fact_sql(n, v)} as {n}" for n, v in _FACT.items()) + " from orders)"


@query(rf"""with {_FACTS_SQL}, x as (select k, unnest(list_filter([
  case when len(list_filter(string_split(trim(remand_reasons), ' '), lambda w: w <> '')) <= 3 then 'MECHANICAL_REMAND' end, case when regexp_matches(recovery, '(?i)no independent|without (independent|panch)|no panch') then 'SEIZURE_WITHOUT_INDEPENDENT_WITNESS' end,
  case when len(list_filter(list_transform(string_split(replace(witnesses, ';', ','), ','), lambda w: trim(w)), lambda w: not regexp_matches(w, '(?i)\b(HC|PC|ASI|SI|PSI|CPC|WPC|Inspector|Constable|Head Constable|IO|police)\b') and not regexp_matches(w, '(?i)complainant|victim|informant|CW-1\b'))) = 0 then 'NO_INDEPENDENT_WITNESSES' end,
  case when regexp_matches(fsl_status, '(?i)pending|awaited|not (received|sent|obtained)|nil') then 'FSL_PENDING' end, case when regexp_matches(tip_status, '(?i)not held|no|nil') then 'TIP_NOT_HELD' end,
  case when regexp_matches(confession, '(?i)police|investigating officer|\bIO\b|inspector|sub.?inspector') then 'CONFESSION_TO_POLICE' end], lambda c: c is not null)) as code from fa) select k, code from x""")
def fact_detectors(spark, sf):
    """Lapses that the facts of a case show, over every order as a case."""
    k = F.col("o_orderkey")
    value = lambda n, vs: F.get(F.array(*map(F.lit, vs)), (F.floor(k / len(n)) % len(vs)).cast("int"))
    facts = F.filter(F.array(*[F.struct(F.lit(n).alias("field"), value(n, vs).alias("value"), F.lit(0.9).alias("confidence"), F.lit(False).alias("reviewed"), F.lit(i).alias("fact_id")) for i, (n, vs) in enumerate(_FACT.items())]), lambda x: x["value"].isNotNull())
    f = table(spark, sf, "orders").select(k.alias("k"), F.explode(facts).alias("x")).select("k", "x.*")
    return detectors.detect(detectors.wide_facts(f, "k"), "k").select("k", "code")


@query("""with h as (select o_custkey as k, case o_orderkey % 4 when 0 then 'witness absent' when 1 then 'PW-1 turned hostile' when 2 then 'NBW issued' else 'call on' end as r from orders), g as (select k, count(*) filter (where r in ('witness absent', 'NBW issued')) as a, count(*) filter (where r like '%hostile%') as h from h group by k)
select k, unnest(list_filter([case when a >= 3 then 'PROSECUTION_WITNESSES_ABSENT' end, case when h > 0 then 'WITNESS_HOSTILE' end], lambda c: c is not null)) as code from g""")
def hearing_lapses(spark, sf):
    k = F.col("o_orderkey") % 4
    h = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.when(k == 0, "witness absent").when(k == 1, "PW-1 turned hostile").when(k == 2, "NBW issued").otherwise("call on").alias("reason"))
    return detectors.hearing_lapses(h, "k", "reason").select("k", "code")


@query("""with d as (select o_orderkey as k, case o_orderkey % 4 when 0 then 'CRITICAL_MUST_RELEASE' when 1 then 'ELIGIBLE' else 'REVIEW' end as s, o_orderkey % 3 = 0 as b, o_orderkey % 5 = 0 as u, o_orderkey % 7 = 0 as t, o_orderkey % 2 = 0 as f, case when o_orderkey % 11 = 0 then 'life' when o_orderkey % 13 > 0 then 'term' end as tk from orders)
select k, unnest(list_filter([case when s = 'CRITICAL_MUST_RELEASE' then 'DETAINED_BEYOND_MAXIMUM' end, case when s = 'ELIGIBLE' then 'SECTION_479_RELEASE' end, case when b then 'DEFAULT_BAIL' end, case when u then 'SURETY_RELIEF' end, case when t then 'TIME_SERVED' end, case when f and tk = 'term' then 'PROBATION_CONSIDERATION' end], lambda c: c is not null)) as code from d""")
def release_routes(spark, sf):
    k = F.col("o_orderkey")
    found = F.array_compact(F.array(F.when(k % 3 == 0, "URGENT_DEFAULT_BAIL"), F.when(k % 5 == 0, "CRITICAL_BAIL_NOT_FURNISHED"), F.when(k % 7 == 0, "TIME_SERVED_SUBSTANTIAL")))
    d = table(spark, sf, "orders").select(k.alias("k"), F.when(k % 4 == 0, "CRITICAL_MUST_RELEASE").when(k % 4 == 1, "ELIGIBLE").otherwise("REVIEW").alias("status_out"), found.alias("findings"), (k % 2 == 0).alias("first_offender"), F.when(k % 11 == 0, "life").when(k % 13 > 0, "term").alias("term_kind"))
    return detectors.release_routes(d, ["k"]).select("k", "code")


@query("""with i as (select r_regionkey as charge, r_name as ingredient, [lower(substr(r_name, 1, 3)), 'license'] as any_of, r_regionkey + 1 as lesser from region)
select doc_id, charge, ingredient, lesser from documents join i on charge = doc_id % 5 where trim(text) <> '' and not contains(lower(text), lower(any_of[1])) and not contains(lower(text), 'license')""")
def missing_ingredients(spark, sf):
    """Charges (a region each) whose ingredient no word of the document mentions."""
    d = table(spark, sf, "documents")
    i = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("charge"), F.col("r_name").alias("ingredient"), F.array(F.substring("r_name", 1, 3), F.lit("license")).alias("any_of"), (F.col("r_regionkey") + 1).alias("lesser"))
    return detectors.missing_ingredients(d.select("doc_id", (F.col("doc_id") % 5).alias("charge")), d.select("doc_id", "text"), i, "doc_id", "text")
