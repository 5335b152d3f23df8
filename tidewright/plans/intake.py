"""Queries over whole uploads: the ingest chain, its review queues, consistency of seven fields, duplicate queues."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewright.functions import documents, extract
from tidewright.operators import consistency, ingest, registers
from tidewright.plans import records, training
from tidewright.plans.catalog import query
from tidewright.sources.knowledge import knowledge
from tidewright.sources.readers import table
from tidewright.sources.scratch import checkpointed, shared_folder, spread
from tidewright.sources.versioned import VersionedTable

_NAMES = ["Ravi Kumar", "Sita Devi", "Mohan Das", "Asha Rani", "Imran Khan", "Gopal Shetty", "Meera Nair"]
#: What stands at the head of each uploaded text: eleven shapes, one for every way through the chain.
_HEADS = [
    "FIRST INFORMATION REPORT\nF.I.R.\nFIR No.: {fir}\nDate and time of occurrence: 25/03/2023\nSections: u/s 379 IPC\nAccused: {name}",  # complete
    "Release order\nTo be released from the prison\nset at liberty\nDate of release: 20/01/2024\nName: {name}",  # complete, no case given
    "Release order\nTo be released from the jail\nName: {name}\nFIR No.: {fir}",  # lacks the date
    "A letter without a class\nName: {name}",  # unknown class
    "Release order\nset at liberty\nDate of release: 21/01/2024\nName: Zubair Quadri",  # another person
    "Release order\nset at liberty\nDate of release: 22/01/2024\nFIR No.: 9999/1999\nName: {name}",  # another case
    "Release order\nset at liberty\nDate of release: 04/05/2023\nName: {name}",  # a date of two readings
    "",  # no head, the text alone
    "Release order\nset at liberty\nDate of release: 23/01/2024\nName: {name}\nFIR No.: {fir}",  # no case given, the number tells
    "Release order\nset at liberty\nDate of release: 24/01/2024\nName: {name}",  # badly read page
    "\x00",  # not a text
]


def _uploads(spark, sf):
    """Documents under heads that their ids choose; every seventh again under another id; pages as .html and as .pdf."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("t"))
    k, person = F.col("k"), F.col("k") % 40
    name = F.get(F.array(*map(F.lit, _NAMES)), (person % 7).cast("int"))
    case = person * 10 + F.floor(k / 40) % 2
    fir = F.concat(case.cast("string"), F.lit("/2023"))
    shape = k % 11
    chosen = F.get(F.array(*map(F.lit, _HEADS)), shape.cast("int"))
    head = F.replace(F.replace(chosen, F.lit("{fir}"), fir), F.lit("{name}"), name)
    # prose follows on a page of its own; what it says about dates and sections isn't read where a head stands
    body = F.when(shape == 7, F.lit("")).otherwise(F.concat(head, F.lit("\n\f"), F.regexp_replace(F.coalesce("t", F.lit("")), "[0-9:]", " ")))
    own = d.select(
        k.alias("upload_id"), person.alias("person_id"), F.when(~shape.isin(1, 8), case).alias("case_id"), F.concat(F.when(shape == 4, F.lit("C:\\scans\\")).otherwise(F.lit("scans/")), F.lit("doc_"), k.cast("string"), F.when(shape == 6, F.lit(".PDF")).otherwise(F.lit(".txt"))).alias("filename"),
        F.when(shape == 10, F.concat(F.lit("\x00"), body)).otherwise(body).cast("binary").alias("content"), F.when(shape == 9, F.array(F.lit(0.55), F.lit(0.95))).alias("confidences"),
    )
    again = own.where("upload_id % 7 = 0").withColumn("upload_id", F.col("upload_id") + 10_000_000)
    pages = table(spark, sf, "pages").select((F.col("page_id") + 20_000_000).alias("upload_id"), F.lit(None).cast("bigint").alias("person_id"), F.lit(None).cast("bigint").alias("case_id"), F.concat(F.lit("page"), F.when(F.col("page_id") % 2 == 0, F.lit(".html")).otherwise(F.lit(".pdf"))).alias("filename"), F.when(F.col("page_id") % 4 == 1, F.lit("%PDF-1.7 image only")).otherwise(F.lit("<p>a page</p>")).cast("binary").alias("content"), F.lit(None).cast("array<double>").alias("confidences"))
    return own.unionByName(again).unionByName(pages)


def _ingested(spark, sf):
    people = spark.range(40).select(F.col("id").alias("person_id"), F.get(F.array(*map(F.lit, _NAMES)), (F.col("id") % 7).cast("int")).alias("name"))
    cases = spark.range(80).select((F.floor(F.col("id") / 2) * 10 + F.col("id") % 2).alias("case_id"), F.floor(F.col("id") / 2).alias("person_id"))
    cases = cases.withColumn("fir_number", F.concat(F.col("case_id").cast("string"), F.lit("/2023"))).withColumn("cnr", F.lit(None).cast("string"))
    return ingest.ingest(_uploads(spark, sf), people, cases, records._today())


# ---- what the shapes say must come out, by key
_SHAPES = """d as (select doc_id as k, doc_id % 11 as shape, doc_id % 40 as person, (doc_id % 40) * 10 + (doc_id // 40) % 2 as c, regexp_replace(coalesce(text, ''), '[0-9:]', ' ', 'g') as t from documents),
b as (select k, k as upload_id, * exclude (k) from d union all select k, k + 10000000, * exclude (k) from d where k % 7 = 0),
q as (select *, case when shape in (0, 2, 8) then shape || '/' || c || '/' || person % 7 || t when shape in (4, 5, 10) then shape || '/' || case when shape = 10 then '' else '' end || case when shape = 5 then person % 7 else 0 end || t when shape = 7 then '' else shape || '/' || person % 7 || t end as content from b),
w as (select *, min(upload_id) over (partition by person, content) as first from q),
v as (select *, case when shape = 10 then 'rejected' when shape = 7 then 'rejected' when first < upload_id then 'duplicate' when shape in (2, 3, 4, 5) then 'needs_review' else 'extracted' end as status from w)"""


@query(f"""with {_SHAPES}, p as (select page_id + 20000000 as upload_id, page_id from pages), o as (
    select upload_id, status, case when status = 'duplicate' then first end as duplicate_of, case when status in ('needs_review', 'extracted') then case shape when 0 then 'fir' when 3 then 'unknown' else 'release_order' end end as doc_type,
      case when shape = 1 then null when shape = 8 then case when status = 'extracted' then c end else c end as case_id, case when status <> 'rejected' and shape = 6 then 'EXTENSION_MISMATCH' else '' end as warnings,
      case when shape = 10 then 'UNREADABLE' when shape = 7 then 'EMPTY' when status = 'duplicate' then '' when shape = 2 then 'CONTENT_INCOMPLETE' when shape = 3 then 'TYPE_NOT_ESTABLISHED' when shape = 4 then 'NAME_MISMATCH' when shape = 5 then 'CASE_MISMATCH' else '' end as problems from v)
    select * from o union all select upload_id, case when page_id % 2 = 0 then 'rejected' when first < upload_id then 'duplicate' else 'needs_review' end, case when page_id % 2 = 1 and first < upload_id then first end,
      case when page_id % 4 = 3 and first = upload_id then 'unknown' end, null, case when page_id % 4 = 3 then 'EXTENSION_MISMATCH' else '' end,
      case when page_id % 2 = 0 then 'UNSUPPORTED' when first < upload_id then '' when page_id % 4 = 1 then 'NO_TEXT' else 'TYPE_NOT_ESTABLISHED' end from (select *, min(upload_id) over (partition by page_id % 4) as first from p)""")
def ingest_chain(spark, sf):
    """Documents and pages as uploads: every way in which one is rejected, held or taken."""
    return _ingested(spark, sf).documents.select("upload_id", "status", "duplicate_of", "doc_type", "case_id", F.array_join("warnings", ",").alias("warnings"), F.array_join("problems", ",").alias("problems"))


@query(f"""with {_SHAPES}, f as (select upload_id, status, unnest(case shape
      when 0 then [struct_pack(field := 'fir_number', c := 0.9), struct_pack(field := 'offence_datetime', c := 0.95), struct_pack(field := 'sections', c := 0.9), struct_pack(field := 'accused', c := 0.9), struct_pack(field := 'charge', c := 0.9)]
      when 2 then [struct_pack(field := 'accused', c := 0.5), struct_pack(field := 'fir_number', c := 0.5)] when 3 then [struct_pack(field := 'accused', c := 0.5)] when 4 then [struct_pack(field := 'accused', c := 0.5), struct_pack(field := 'release_date', c := 0.5)]
      when 5 then [struct_pack(field := 'accused', c := 0.5), struct_pack(field := 'release_date', c := 0.5), struct_pack(field := 'fir_number', c := 0.5)] when 6 then [struct_pack(field := 'accused', c := 0.9), struct_pack(field := 'release_date', c := 0.75)]
      when 8 then [struct_pack(field := 'accused', c := 0.9), struct_pack(field := 'release_date', c := 0.95), struct_pack(field := 'fir_number', c := 0.9)] when 9 then [struct_pack(field := 'accused', c := 0.65), struct_pack(field := 'release_date', c := 0.65)]
      else [struct_pack(field := 'accused', c := 0.9), struct_pack(field := 'release_date', c := 0.95)] end) as x from v where status in ('needs_review', 'extracted'))
    select upload_id, x.field as field, x.c as confidence, 1 as page, status = 'needs_review' as held from f""", dates="confidence")
def ingest_facts(spark, sf):
    """Facts of the uploads that were read, as sure as their document and their page allow."""
    f = _ingested(spark, sf).facts
    return f.select("upload_id", "field", F.col("confidence").cast("decimal(3,2)").alias("confidence"), "page", (F.size("notes") > 0).alias("held"))


@query(f"""with {_SHAPES}, p as (select page_id + 20000000 as upload_id, page_id, min(page_id) over (partition by page_id % 4) as first from pages),
    r as (select upload_id, shape, status from v) select 'document_type' as kind, upload_id, 0.0 as confidence, 'TYPE_NOT_ESTABLISHED: unknown' as titles from r where status = 'needs_review' and shape = 3
    union all select 'document_type', upload_id, 0.4, 'CONTENT_INCOMPLETE: release_date' from r where status = 'needs_review' and shape = 2
    union all select 'document_mismatch', upload_id, 0.3, 'NAME_MISMATCH' from r where status = 'needs_review' and shape = 4 union all select 'document_mismatch', upload_id, 0.3, 'CASE_MISMATCH: fir_number' from r where status = 'needs_review' and shape = 5
    union all select 'extraction', upload_id, 0.75, 'release_date' from r where status = 'extracted' and shape = 6 union all select 'extraction', upload_id, 0.65, unnest(['release_date', 'accused']) from r where status = 'extracted' and shape = 9
    union all select 'document', upload_id, 0.0, 'NO_TEXT' from p where page_id % 4 = 1 and page_id = first union all select 'document_type', upload_id, 0.0, 'TYPE_NOT_ESTABLISHED: unknown' from p where page_id % 4 = 3 and page_id = first""", dates="confidence")
def ingest_reviews(spark, sf):
    """What a reviewer has to look at, one item for each kind and reference."""
    r = _ingested(spark, sf).reviews
    return r.select("kind", "upload_id", F.col("confidence").cast("decimal(3,2)").alias("confidence"), F.array_join("titles", " | ").alias("titles"))


# ---- seven fields of documents against the record

_FIELDS = ["charge_sheet_date", "remand_date", "arrest_datetime", "release_date", "offence_datetime", "transfer_date", "hearing"]
_TYPES = ["judicial_custody", "released", "police_custody", "transfer", "on_bail", "judicial_custody", "escaped"]


def _record(spark, sf):
    """Orders as cases, their lines as custody and hearings, and a fact read from a document for each line: its field and
    how far it is off follow from keys."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("person_id"), F.to_date("o_orderdate").alias("d"))
    k = F.col("case_id")
    cases = o.select("case_id", "person_id", F.when(k % 5 > 0, F.date_add("d", 60)).alias("charge_sheet_date"), F.when(k % 7 > 0, F.col("d")).alias("first_remand_date"), F.when(k % 6 > 0, F.date_sub("d", 10)).alias("offence_date"))
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("n"), F.to_date("l_shipdate").alias("ship")).groupBy("case_id", "n").agg(F.min("ship").alias("ship")).join(o, "case_id")
    line = checkpointed(line)  # facts, custody and hearings are made of it
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    n = F.col("n")
    custody = line.select("person_id", F.when(n != 3, k).alias("case_id"), pick(_TYPES, n - 1).alias("type"), F.col("ship").alias("start"), F.when((k + n) % 9 > 0, F.date_add("ship", (F.lit(5) + (k + n) % 60).cast("int"))).alias("end"))
    hearings = line.where("case_id % 3 > 0").select("case_id", F.date_add("ship", 15).alias("date"))
    field, off = pick(_FIELDS, (k + n) % 7), (F.pmod(k * 31 + n * 17, F.lit(3)) - 1).cast("int")
    base = F.when(field == "charge_sheet_date", F.date_add("d", 60)).when(field == "remand_date", F.col("d")).when(field == "offence_datetime", F.date_sub("d", 10)).when(field == "hearing", F.date_add("ship", 15)).otherwise(F.col("ship"))
    facts = line.select((k * 10 + n).alias("fact_id"), "person_id", F.when((k + n) % 4 > 0, k).alias("case_id"), field.alias("field"), F.when((k + n) % 13 > 0, F.date_add(base, off)).alias("value"), F.when((k + n) % 8 == 0, base).alias("alternative"))
    return facts, cases, custody, hearings


_RECORD = f"""o as (select o_orderkey as k, o_custkey as p, cast(o_orderdate as date) as d from orders),
ca as (select k, p, case when k % 5 > 0 then d + 60 end as cs, case when k % 7 > 0 then d end as fr, case when k % 6 > 0 then d - 10 end as od from o),
li as (select l_orderkey as k, l_linenumber as n, min(cast(l_shipdate as date)) as ship, any_value(p) as p, any_value(d) as d from lineitem join o on k = l_orderkey group by 1, 2),
cu as (select p, case when n <> 3 then k end as k, list_extract({_TYPES!r}, n::int) as type, ship as s, case when (k + n) % 9 > 0 then ship + (5 + (k + n) % 60)::int end as e from li),
he as (select k, ship + 15 as h from li where k % 3 > 0),
fa0 as (select *, list_extract({_FIELDS!r}, ((k + n) % 7)::int + 1) as field, ((k * 31 + n * 17) % 3)::int - 1 as off from li),
fa1 as (select *, case field when 'charge_sheet_date' then d + 60 when 'remand_date' then d when 'offence_datetime' then d - 10 when 'hearing' then ship + 15 else ship end as base from fa0),
fa as (select k * 10 + n as fact_id, f.p, coalesce(case when (k + n) % 4 > 0 then k end, one) as k, field, case when (k + n) % 13 > 0 then base + off end as v, case when (k + n) % 8 = 0 then base end as a
       from fa1 f left join (select p, min(k) as one from ca group by p having count(*) = 1) u on u.p = f.p),
j as (select fa.*, ca.cs, ca.fr, ca.od from fa join ca on ca.k = fa.k where v is not null)"""


@query(f"""with {_RECORD}, c as (select fact_id, k, field, case field
    when 'charge_sheet_date' then case when cs is null then 'MISSING' when v <> cs and a is distinct from cs then 'DIFFERS' end
    when 'remand_date' then case when fr is null then 'MISSING' when v < fr and a is distinct from fr then 'EARLIER' end
    when 'offence_datetime' then case when v <> od and a is distinct from od then 'DIFFERS' end
    when 'arrest_datetime' then case when v < (select min(s) from cu where cu.p = j.p and (cu.k = j.k or cu.k is null)) and not exists (select 1 from cu where cu.p = j.p and (cu.k = j.k or cu.k is null) and cu.s = j.a) then 'EARLIER' end
    when 'release_date' then case when not exists (select 1 from cu where cu.p = j.p and cu.type in ('released', 'escaped') and cu.s in (j.v, coalesce(j.a, j.v)))
        and exists (select 1 from cu where cu.p = j.p and (cu.k = j.k or cu.k is null) and cu.type not in ('released', 'escaped', 'on_bail', 'absconding') and cu.s <= j.v and (cu.e is null or cu.e > j.v)) then 'CONTINUES' end
    when 'transfer_date' then case when not exists (select 1 from cu where cu.p = j.p and cu.type = 'transfer' and cu.s = j.v) then 'UNRECORDED' end
    when 'hearing' then case when exists (select 1 from he where he.k = j.k) and not exists (select 1 from he where he.k = j.k and he.h in (j.v, coalesce(j.a, j.v))) then 'UNRECORDED' end end as conflict from j)
    select fact_id, k as case_id, field, conflict, field in ('charge_sheet_date', 'remand_date', 'arrest_datetime', 'release_date') as blocking from c where conflict is not null""")
def field_conflicts(spark, sf):
    """All seven rules of documents against records, over every line."""
    return consistency.field_conflicts(*_record(spark, sf))


# ---- causes of adjournments: rules first, what no rule knows by a model learned from a quarter of the orders

_SAID = {
    "accused": ["advocate for the applicant prayed for time", "the applicant side wants a later date", "applicant's advocate out of station, prayed for time"],
    "both": ["parties are exploring settlement, they ask together", "talks of settlement go on between the parties", "parties together filed a settlement memo"],
    "court": ["bench did not assemble today", "roster changed, file not placed before the bench", "file not listed, bench rose early today"],
    "other": ["public holiday declared owing to heavy rain", "heavy rain and flooding near the complex", "holiday declared for the local festival"],
    "prosecution": ["state asked for more days to trace the seized items", "investigating agency needs days for its report", "agency of the state is yet to trace the report"],
}


_SAID_RULED = "[" + ", ".join(repr(x) for x in records._REASONS[:11]) + "]"
_SAID_CASES = "case " + " ".join(f"when regexp_matches(t, '(?i){p.replace(chr(39), chr(39) * 2)}') then '{label}'" for p, label, _ in documents.CAUSES) + " end"


def _reasons(spark, sf):
    """(k, said, label): a reason for each order; every fourth is one that a rule knows."""
    k = F.col("o_orderkey")
    label = F.get(F.array(*map(F.lit, _SAID)), (k % 5).cast("int"))
    unruled = F.get(F.flatten(F.array(*[F.array(*map(F.lit, v)) for v in _SAID.values()])), ((k % 5) * 3 + F.floor(k / 5) % 3).cast("int"))
    said = F.when(k % 4 == 0, F.get(F.array(*map(F.lit, records._REASONS[:11])), (F.floor(k / 4) % 11).cast("int"))).otherwise(F.concat(unruled, F.when(k % 2 == 0, F.concat(F.lit(", item "), (k % 17).cast("string"))).otherwise("")))
    return table(spark, sf, "orders").select(k.alias("k"), said.alias("said"), F.when(k % 4 > 0, label).alias("label"))


@query(f"""with r as (select o_orderkey as k, list_extract({_SAID_RULED}, ((o_orderkey // 4) % 11)::int + 1) as t from orders)
    select k, case when k % 4 > 0 then list_extract({list(_SAID)!r}, (k % 5)::int + 1) else {_SAID_CASES} end as label, case when k % 4 > 0 then 'classifier' else 'rules' end as method from r""")
def delay_attribution(spark, sf):
    """Who caused each adjournment: rules first, then the class learned from the labelled quarter where it is sure enough."""
    r = _reasons(spark, sf)
    model = training.learn_causes(r.where("label is not null and k % 4 = 1"), "said", "label")
    return training.attribute_causes(r, "said", model).select("k", "cause.label", "cause.method")


# ---- dates in full, quotes and two readers, over texts that orders put together

_DATED = f"""o as (select o_orderkey as k, cast(o_orderdate as date) as d, cast(o_orderdate as date) + (o_orderkey % 400)::int as n from orders),
x as (select *, case when day(n) <= 12 and day(n) <> month(n) then make_date(year(n), day(n), month(n)) end as alt from o)"""


def _dated(spark, sf):
    """A record for each order: a certain date in words of one of three languages, a numeric one (every fifth badly read),
    three times of four with a time of day."""
    k = F.col("o_orderkey")
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_orderdate")).select(k.alias("k"), F.to_date("o_orderdate").alias("d")).withColumn("n", F.date_add("d", (F.col("k") % 400).cast("int")))
    word = F.get(F.array(*[F.array(*[F.lit(names[w]) for names in extract.MONTHS]) for w in (0, -2, -1)])[(F.col("k") % 3).cast("int")], F.month("d") - 1)
    said = F.concat_ws(" ", F.lit("Arrested on"), F.dayofmonth("d").cast("string"), word, F.year("d").cast("string"))
    figures = F.date_format("n", "dd/MM/yyyy")
    figures = F.when(F.col("k") % 5 == 0, F.translate(figures, "01", "Ol")).otherwise(figures)
    time = F.when(F.col("k") % 4 > 0, F.format_string(" at %d:%02d hrs", (F.col("k") % 23).cast("int"), (F.col("k") % 60).cast("int"))).otherwise("")
    return o.select("k", F.concat(said, F.lit("; produced on "), figures, time).alias("t"))


@query(f"""with {_DATED}, r as (select *, alt is not null and abs(n - d) > 180 and abs(alt - d) * 2 < abs(n - d) as turned from x)
    select k, d as certain, case when turned then alt else n end as value, case when alt is not null then 0.85 when k % 5 = 0 then 0.80 else 0.95 end::decimal(3, 2) as confidence, alt is not null as settled,
      case when k % 4 > 0 then printf('%02d:%02d', (k % 23)::int, (k % 60)::int) end as time from r""", dates="certain value confidence")
def dates_in_context(spark, sf):
    """Dates of a text, ambiguous ones settled by the record's certain date, with the time of day that follows."""
    d = _dated(spark, sf).select("k", "t", F.posexplode(extract.dates_in("t", records._today())).alias("pos", "x"))
    after = F.when(F.col("pos") == 1, F.substring("t", F.col("x.end") + 1, F.length("t")))
    d = checkpointed(d.select("k", after.alias("after"), F.concat_ws(":", "k", "pos").alias("id"), "pos", "x.*"))  # texts are read once
    out = extract.by_context(d, "k", "id")
    # the two dates of a record, of which each has one
    at = lambda n, *c: F.max(F.when(F.col("pos") == n, F.struct("value", *c)))
    both = out.groupBy("k").agg(at(0).alias("a"), at(1, "confidence", "flags", "after").alias("b")).where("a is not null and b is not null")
    return both.select("k", F.col("a.value").alias("certain"), "b.value", F.col("b.confidence").cast("decimal(3,2)").alias("confidence"), F.array_contains("b.flags", "AMBIGUITY_RESOLVED_BY_CONTEXT").alias("settled"), extract.time_of_day(F.col("b.after")).alias("time"))


@query("""with w as (select conv_id, turn, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as ws from conversations where text is not null),
    q as (select *, ws[2 + turn % 3 : 4 + turn % 3] as quote from w where len(ws) > 6)
    select conv_id, turn, case when turn % 4 = 3 then null else length(regexp_extract(text, '^((?:\\s*\\S+){' || (1 + turn % 3) || '}\\s+)')) end as start,
      case when turn % 4 = 3 then null else length(regexp_extract(text, '^((?:\\s*\\S+){' || (4 + turn % 3) || '})')) end as "end" from q
      where regexp_extract_all(text, '\\S+') = ws and len(list_filter(range(1, len(ws) - 1), lambda i: ws[i] = quote[1] and ws[i + 1] = quote[2] and ws[i + 2] = quote[3])) = 1 and position(array_to_string(quote, ' ') in array_to_string(ws, ' ')) = length(array_to_string(ws[: 1 + turn % 3], ' ')) + 2""")
def quoted_evidence(spark, sf):
    """Three words of a turn as a quote with other blanks between them, and where it stands; every fourth was made up."""
    c = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text").where("text is not null"))
    n = F.col("turn") % 3
    first = (n + 2).cast("int")
    # exploded, so that no filter splits the text anew for each of its words
    c = c.select("*", F.explode(F.array(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("ws")).where("size(ws) > 6")
    c = c.select("*", F.explode(F.array(F.slice("ws", first, 3))).alias("quote"))
    quote = F.col("quote")
    # only quotes that stand once, and first as such, have one answer
    once = F.size(F.filter(F.sequence(F.lit(0), F.size("ws") - 3), lambda i: (F.get("ws", i) == quote[0]) & (F.get("ws", i + 1) == quote[1]) & (F.get("ws", i + 2) == quote[2]))) == 1
    plain = F.position(F.array_join(quote, " "), F.array_join("ws", " ")) == F.length(F.array_join(F.slice("ws", 1, first - 1), " ")) + 2
    said = F.when(F.col("turn") % 4 == 3, F.concat(F.array_join(quote, " "), F.lit(" zzz-made-up"))).otherwise(F.array_join(quote, "  \t "))
    return c.where(once & plain).select("conv_id", "turn", extract.find_quote(F.col("text"), said).alias("s")).select("conv_id", "turn", "s.start", "s.end")


@query("""with a as (select l_orderkey as k, l_linenumber as n, min(l_returnflag) as v, round(min(l_discount) * 8 + 0.1, 2) as c from lineitem where (l_orderkey + l_linenumber) % 3 < 2 group by all),
    b as (select l_orderkey as k, l_linenumber as n, case when min(l_quantity) > 25 then lower(min(l_returnflag)) || ' ' else min(l_linestatus) end as v, round(min(l_tax) * 8 + 0.2, 2) as c from lineitem where (l_orderkey + l_linenumber) % 3 > 0 group by all)
    select coalesce(a.k, b.k) as k, coalesce(a.n, b.n) as n, coalesce(a.v, b.v) as value, round(case when b.k is null then a.c when a.k is null then least(b.c, 0.75) when lower(trim(a.v)) = lower(trim(b.v)) then least(0.99, greatest(a.c, b.c) + 0.05) else least(a.c, 0.5) end, 2) as confidence,
      case when b.k is null then 'first' when a.k is null then 'second' when lower(trim(a.v)) = lower(trim(b.v)) then 'both' else 'disputed' end as method from a full outer join b on a.k = b.k and a.n = b.n""")
def fused_readers(spark, sf):
    """Two readers of each line: what both, one or neither of them bears out."""
    l, key = table(spark, sf, "lineitem"), [F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")]  # noqa: E741
    shift = (F.col("l_orderkey") + F.col("l_linenumber")) % 3
    a = l.where(shift < 2).groupBy(*key).agg(F.min("l_returnflag").alias("value"), F.round(F.min("l_discount") * 8 + 0.1, 2).alias("confidence"))
    b = l.where(shift > 0).groupBy(*key).agg(F.when(F.min("l_quantity") > 25, F.concat(F.lower(F.min("l_returnflag")), F.lit(" "))).otherwise(F.min("l_linestatus")).alias("value"), F.round(F.min("l_tax") * 8 + 0.2, 2).alias("confidence"))
    return registers.fused(a, b, ["k", "n"]).drop("disputed_by")


@query("""with v as (select o_custkey as c, list_sort(list(distinct o_orderpriority)) as p, min(o_orderpriority) as m from orders group by 1)
    select a.c as kept, array_to_string(list_sort(list_distinct(a.p || b.p || case when b.m <> a.m then [b.m] else [] end)), ',') as variants from v a join v b on a.c % 2 = 0 and b.c = a.c + 1""")
def merged_name_variants(spark, sf):
    """Every odd person merged into the even one before."""
    v = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.collect_set("o_orderpriority").alias("p"), F.min("o_orderpriority").alias("m"))
    a, b = v.where("c % 2 = 0"), v.select((F.col("c") - 1).alias("c"), F.col("p").alias("q"), F.col("m").alias("o"))
    return a.join(b, "c").select(F.col("c").alias("kept"), F.array_join(registers.merged_variants(F.col("m"), F.col("p"), F.col("o"), F.col("q")), ",").alias("variants"))


# ---- a table that is merged into, and knowledge files

#: Keys that share a knowledge file of each act.
SECTIONS = 2_000


@query("""with a as (select c_custkey, c_acctbal, c_nationkey from customer where c_custkey % 3 > 0), n as (select c_custkey, c_acctbal + 1 as c_acctbal, c_nationkey from customer where c_custkey % 4 = 0)
    select * from a where c_custkey % 4 > 0 and c_custkey % 5 > 0 union all select * from n""")
def table_upsert(spark, sf):
    """Customers merged into a versioned table: every fourth anew, every fifth deleted."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    t = VersionedTable(spark, f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}")
    t.write(c.where("c_custkey % 3 > 0"))
    t.upsert(c.where("c_custkey % 4 = 0").withColumn("c_acctbal", (F.col("c_acctbal") + 1).cast(c.schema["c_acctbal"].dataType)), ["c_custkey"], c.where("c_custkey % 5 = 0"))
    return t.read()


@query("""select case when p_partkey % 2 = 0 then 'IPC' else 'BNS' end as act, p_partkey::varchar as section, case when p_partkey % 6 = 5 then 'life' when p_partkey % 6 = 4 then 'none' else 'term' end as max_kind,
    case when p_partkey % 6 < 4 then p_size * 12 + p_partkey % 12 end as max_months, case when p_partkey % 7 = 0 then true else p_partkey % 5 = 0 end as verified, case when p_partkey % 7 = 0 then 'r' || p_partkey % 3 end as verified_by from part""")
def knowledge_records(spark, sf):
    """Parts as sections of two acts: written as knowledge files, a draft of each section first, and read with an overlay."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    k = F.col("k")
    term = F.when(k % 6 == 5, F.lit('"life"')).when(k % 6 == 4, F.lit("null")).otherwise(F.format_string('{"years": %d, "months": %d}', "size", k % 12))
    record = lambda t, fine, ok: F.concat(F.lit('{"section": "'), k.cast("string"), F.lit('", "max_imprisonment": '), t, F.lit(', "fine_only": '), fine, F.lit(', "verified": '), ok, F.lit("}"))
    flag = lambda c: F.when(c, "true").otherwise("false")
    act = F.when(k % 2 == 0, "I.P.C").otherwise("bns")
    rows = p.withColumn("act", act).withColumn("shard", F.floor(k / SECTIONS))  # a file is read whole, so files grow in number and not in length
    file = lambda text: rows.groupBy("act", "shard").agg(F.concat(F.lit('{"act": "'), F.first("act"), F.lit('", "records": ['), F.array_join(F.sort_array(F.collect_list(text)), ", "), F.lit("]}")).alias("value")).select("value")
    root = f"{shared_folder(spark)}/knowledge-{uuid.uuid4().hex}"
    for name, text in (("a-draft", record(F.lit('"death"'), F.lit("false"), F.lit("true"))), ("b-final", record(term, flag(k % 6 == 4), flag(k % 5 == 0)))):
        file(text).write.option("maxRecordsPerFile", 1).text(f"{root}/{name}")
    both = f"{root}/{{a-draft,b-final}}/part-*"
    overlay = p.where("k % 7 = 0").select(F.concat_ws(":", F.when(k % 2 == 0, "IPC").otherwise("BNS"), k.cast("string")).alias("key"), F.lit(True).alias("verified"), F.concat(F.lit("r"), (k % 3).cast("string")).alias("verified_by"))
    return knowledge(spark, both, overlay).records.select("act", "section", "max_kind", "max_months", "verified", "verified_by")
