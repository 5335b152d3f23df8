"""Named queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import dates, scores, text
from tidewright.operators import intervals, matching, metrics, monitor, relational, retrieval, rules
from tidewright.sources.readers import table
from tidewright.streaming import ordered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TODAY = "2024-02-15"


def query(sql: str | None = None, dates: str = ""):
    """Register a query and its SQL; the columns in `dates` are given as text by both."""

    def add(f):
        names = dates.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c in names}) if names else df

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = f"select * replace ({', '.join(f'cast(\"{c}\" as varchar) as \"{c}\"' for c in names)}) from ({sql})" if names else sql
        return f

    return add


# ---- intervals over events: a signup opens three days, an error excludes its day


def _days_of(spark, sf, kind, length=0):
    e = table(spark, sf, "events").where(F.col("event_type") == kind).select("user_id", F.to_date("ts").alias("start"))
    return e.withColumn("end", F.date_add("start", length))


_IV = """iv as (select distinct user_id, cast(ts as date) as s, cast(ts as date) + 2 as e from events where event_type = 'signup'),
dy as (select distinct user_id, cast(unnest(generate_series(cast(s as timestamp), cast(e as timestamp), interval 1 day)) as date) as d from iv),
isl as (select user_id, d, d - cast(row_number() over (partition by user_id order by d) as int) as g from dy),
m as (select user_id, min(d) as s, max(d) as e from isl group by user_id, g)"""
_CT = """x as (select distinct user_id, cast(ts as date) as d from events where event_type = 'error'),
ct as (select dy.user_id, dy.d from dy where not exists (select 1 from x where x.user_id = dy.user_id and x.d = dy.d))"""


@query(f'with {_IV} select user_id, s as "start", e as "end" from m',
    dates="start end",
)
def interval_merge(spark, sf):
    return intervals.merge(_days_of(spark, sf, "signup", 2), ["user_id"])


@query(f'with {_IV}, {_CT}, i2 as (select user_id, d, d - cast(row_number() over (partition by user_id order by d) as int) as g from ct) select user_id, min(d) as "start", max(d) as "end" from i2 group by user_id, g',
    dates="start end",
)
def interval_subtract(spark, sf):
    return intervals.subtract(_days_of(spark, sf, "signup", 2), _days_of(spark, sf, "error"), ["user_id"])


@query(f'with {_IV}, n as (select user_id, e, lead(s) over (partition by user_id order by s) as nx from m) select user_id, e + 1 as "start", nx - 1 as "end" from n where nx is not null',
    dates="start end",
)
def interval_gaps(spark, sf):
    return intervals.gaps(interval_merge(spark, sf), ["user_id"])


@query(f"with {_IV} select user_id, s as \"start\", least(e, date '2024-01-20') as \"end\" from m where s <= date '2024-01-20'",
    dates="start end",
)
def interval_clip(spark, sf):
    return intervals.clip(interval_merge(spark, sf), F.lit("2024-01-20").cast("date"))


@query(f"with {_IV}, {_CT}, r as (select user_id, d, row_number() over (partition by user_id order by d) as n from ct) select user_id, count(*) as counted_days, max(case when n = 10 then d end) as reached from r group by user_id",
    dates="reached",
)
def nth_counted_day(spark, sf):
    return intervals.counted_days(_days_of(spark, sf, "signup", 2), _days_of(spark, sf, "error"), ["user_id"], 10)


@query(
    f"""with {_IV}, {_CT}, r as (select user_id, count(*) as counted from ct group by user_id),
    u as (select user_id, counted, user_id % 2 = 0 as first_offender, cast(ceil((1 + user_id % 3) * 36525 / 3600.0) as bigint) as thr, cast(ceil((1 + user_id % 3) * 36525 / 1200.0) as bigint) as mx from r)
    select case when counted >= mx then 'MUST_RELEASE' when counted >= thr then 'ELIGIBLE' else 'NOT_YET' end as status, count(*) as n, cast(sum(counted) as bigint) as counted_days, max(counted - thr) as most_overdue from u group by 1"""
)
def eligibility_summary(spark, sf):
    """Merged custody minus excluded days, against a third of one to three months; counted by status."""
    counted = intervals.counted_days(_days_of(spark, sf, "signup", 2), _days_of(spark, sf, "error"), ["user_id"], 10)
    months = 1 + F.col("user_id") % 3
    c = counted.withColumn("thr", dates.ceil_threshold(months, 1, 3)).withColumn("mx", dates.ceil_threshold(months))
    status = F.when(F.col("counted_days") >= F.col("mx"), "MUST_RELEASE").when(F.col("counted_days") >= F.col("thr"), "ELIGIBLE").otherwise("NOT_YET")
    return c.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("counted_days").alias("counted_days"), F.max(F.col("counted_days") - F.col("thr")).alias("most_overdue"))


@query(
    f"""with v as (select user_id, cast(ts as date) as s, event_id from events where event_type = 'view'), p as (select user_id, cast(ts as date) as d from events where event_type = 'purchase')
    select user_id, s as "start", coalesce((select min(d) from p where p.user_id = v.user_id and p.d >= v.s), date '{TODAY}') as "end" from v""",
    dates="start end",
)
def open_interval_close(spark, sf):
    at = lambda kind: _days_of(spark, sf, kind).select("user_id", F.col("start").alias("at"))
    return intervals.close_open(at("view"), at("purchase"), ["user_id"], F.lit(TODAY).cast("date"))


@query(
    f"""with {_IV}, c as (select distinct user_id, cast(ts as date) as s, cast(ts as date) + 1 as e from events where event_type = 'click'),
    cd as (select distinct user_id, cast(unnest(generate_series(cast(s as timestamp), cast(e as timestamp), interval 1 day)) as date) as d from c)
    select dy.user_id, count(*) as overlap from dy join cd using (user_id, d) group by dy.user_id"""
)
def overlap_days(spark, sf):
    return intervals.overlap_days(_days_of(spark, sf, "signup", 2), _days_of(spark, sf, "click", 1), ["user_id"]).select("user_id", F.col("overlap").cast("long").alias("overlap"))


@query(
    f"""with {_IV}, n as (select user_id, e, lead(s) over (partition by user_id order by s) as nx from m), g as (select user_id, e + 1 as s, nx - 1 as t from n where nx is not null)
    select user_id, s as "start", t as "end" from g where not exists (select 1 from events v where v.user_id = g.user_id and v.event_type = 'click' and cast(v.ts as date) between g.s - 1 and g.t)""",
    dates="start end",
)
def gap_explained_anti(spark, sf):
    """Gaps without a click from the day before to their end: the last click on or before the end decides."""
    g = interval_gaps(spark, sf)
    both = g.select("user_id", F.col("end").alias("at"), "start", F.lit(None).cast("date").alias("click")).unionByName(
        _days_of(spark, sf, "click").select("user_id", F.col("start").alias("at"), F.lit(None).cast("date").alias("start"), F.col("start").alias("click"))
    )
    last = F.max("click").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumn("last", last).where("start is not null").where("last is null or last < date_sub(start, 1)")
    return out.select("user_id", "start", F.col("at").alias("end"))


# ---- relational


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, cast(ts as date), event_type order by ts, event_id) as rn from events) where rn = 1")
def first_wins_dedupe(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return relational.keep_first(e, ["user_id", "day", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("select o_custkey, arg_min(o_orderstatus, case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end) as status from orders group by o_custkey")
def argmin_status(spark, sf):
    return relational.argmin(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderstatus"), scores.rank_of(F.col("o_orderstatus"), ["P", "O"]), "status")


@query("select o_custkey, coalesce(min(case when o_orderpriority = '1-URGENT' then cast(o_orderdate as date) end), min(cast(o_orderdate as date))) as chosen from orders group by o_custkey",
    dates="chosen",
)
def priority_argmin(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by(day, F.struct((F.col("o_orderpriority") != "1-URGENT").alias("x"), day.alias("d"))).alias("chosen"))


@query(
    """select coalesce(n.n_name, 'Unknown') as district, count(*) as n, count(*) filter (where c_acctbal < 0) as negative, count(*) filter (where c_mktsegment = 'BUILDING') as building,
    count(*) filter (where c_acctbal > 5000) as rich, round_even(avg(c_acctbal), 1) as avg_balance from customer c left join nation n on c.c_nationkey = n.n_nationkey group by 1"""
)
def conditional_dashboard(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy(F.coalesce("n_name", F.lit("Unknown")).alias("district")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), F.count_if(F.col("c_acctbal") > 5000).alias("rich"), F.bround(F.avg("c_acctbal"), 1).alias("avg_balance")
    )


@query("select l_suppkey, count(*) as n, rank() over (order by count(*) desc, l_suppkey) as place from lineitem group by l_suppkey")
def workload_rank(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "l_suppkey")).cast("long"))  # one row a supplier


@query("select quality, count(*) filter (where toxic = 0) as toxic_0, count(*) filter (where toxic = 1) as toxic_1 from labels group by quality")
def confusion_pivot(spark, sf):
    p = table(spark, sf, "labels").groupBy("quality").pivot("toxic", [0, 1]).agg(F.count(F.lit(1)))
    return p.select("quality", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"toxic_{k}") for k in (0, 1)])


@query("select c_mktsegment, count(*) as n, round(avg(c_acctbal), 2) as avg_balance from customer group by 1 having count(*) >= 50 and min(c_acctbal) < 0 and max(c_acctbal) > 0")
def having_group(spark, sf):
    g = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 2).alias("avg_balance"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return g.where("n >= 50 and lo < 0 and hi > 0").drop("lo", "hi")


@query(
    """with e as (select user_id, ts, event_id, event_type from events where event_type in ('error', 'signup'))
    select a.event_id, a.user_id, (select count(*) from e b where b.user_id = a.user_id and b.event_type = 'error' and b.ts <= a.ts and b.ts >= a.ts - interval 6 hour
      and b.ts > coalesce((select max(c.ts) from e c where c.user_id = a.user_id and c.event_type = 'signup' and c.ts <= a.ts), timestamp '1900-01-01')) as failures
    from e a where a.event_type = 'error'"""
)
def sliding_failures(spark, sf):
    """Errors of the last six hours, since the last success (signup), at each error."""
    e = table(spark, sf, "events").where("event_type in ('error', 'signup')").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    by = Window.partitionBy("user_id").orderBy("us")
    # a success starts a new group; inside it the frame goes back six hours
    grouped = e.withColumn("run", F.count_if(F.col("event_type") == "signup").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    recent = Window.partitionBy("user_id", "run").orderBy("us").rangeBetween(-6 * 3_600_000_000, 0)
    return grouped.withColumn("failures", F.count_if(F.col("event_type") == "error").over(recent)).where("event_type = 'error'").select("event_id", "user_id", "failures")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def current_version(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"))
    return e.select("user_id", "x.event_id", "x.event_type")


@query("select c_custkey, c_name, c_acctbal, (select count(*) from customer where c_nationkey = 7) as total from customer where c_nationkey = 7 order by c_acctbal desc, c_custkey limit 10 offset 5")
def scoped_page(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    return relational.scoped_page(c, F.col("c_nationkey") == 7, [F.desc("c_acctbal"), F.col("c_custkey")], 5, 10).drop("c_nationkey")


@query("select doc_id from documents where contains(lower(text), 'license') or list_contains(string_split(lower(text), ' '), 'the')")
def search_or_array(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(F.contains(F.lower("text"), F.lit("license")) | F.array_contains(F.split(F.lower("text"), " "), "the")).select("doc_id")


@query("select event_id, user_id from events where event_id > 5000 and event_type = 'click' order by event_id limit 50")
def keyset_page(spark, sf):
    return table(spark, sf, "events").where("event_id > 5000 and event_type = 'click'").orderBy("event_id").limit(50).select("event_id", "user_id")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_in(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '1998-01-01')")
def anti_stale(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return table(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query(
    """with o as (select o_custkey as k, count(*) as v from orders where o_orderdate < timestamp '1996-01-01' group by 1), n as (select o_custkey as k, count(*) as v from orders where o_orderdate >= timestamp '2000-06-01' group by 1)
    select coalesce(o.k, n.k) as k, coalesce(n.v, o.v) as v, case when o.k is null then 'inserted' when n.k is null then 'stale' when o.v = n.v then 'unchanged' else 'updated' end as change from o full outer join n on o.k = n.k"""
)
def full_outer_upsert(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    count = lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("v"))
    return relational.upsert(count(o.where(F.col("o_orderdate") < at("1996-01-01"))), count(o.where(F.col("o_orderdate") >= at("2000-06-01"))), ["k"], ["v"])


@query("select c_custkey, coalesce(n_name, 'Unknown') as nation, coalesce(r_name, 'Unknown') as region from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def dim_left_default(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("c_custkey", F.coalesce("n_name", F.lit("Unknown")).alias("nation"), F.coalesce("r_name", F.lit("Unknown")).alias("region"))


@query("select l_partkey, case when count(distinct s_nationkey) = 1 then cast(min(s_nationkey) as varchar) else 'AMBIGUOUS' end as mapped from lineitem join supplier on l_suppkey = s_suppkey group by l_partkey")
def ambiguous_map(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    one = F.min("s_nationkey") == F.max("s_nationkey")
    return j.groupBy("l_partkey").agg(F.when(one, F.min("s_nationkey").cast("string")).otherwise("AMBIGUOUS").alias("mapped"))


@query("select a.doc_id from documents a where exists (select 1 from documents b where b.doc_id < a.doc_id and b.text = a.text) or exists (select 1 from documents b where b.doc_id < a.doc_id and b.source = a.source and b.n_chars = a.n_chars)")
def or_dup_union(spark, sf):
    """Documents that an earlier one equals by text, or by source and length: two aggregates instead of an OR join."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "source", "n_chars")
    one = d.join(d.groupBy("h").agg(F.min("doc_id").alias("m")).where("h is not null"), "h").where("doc_id > m").select("doc_id")
    two = d.join(d.where("source is not null and n_chars is not null").groupBy("source", "n_chars").agg(F.min("doc_id").alias("m")), ["source", "n_chars"]).where("doc_id > m").select("doc_id")
    return one.unionByName(two).distinct()


@query(
    """with a as (select distinct o_custkey, cast(o_orderdate as date) as d from orders where o_orderpriority = '1-URGENT')
    select o_orderkey, coalesce((select min(abs(cast(o.o_orderdate as date) - a.d)) from a where a.o_custkey = o.o_custkey), -1) as days_to_anchor from orders o"""
)
def nearest_anchor(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderpriority")
    a = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("d").alias("anchor")).distinct()
    return relational.nearest(o.select("o_orderkey", "o_custkey", "d"), a, "o_custkey", "d", "anchor").select("o_orderkey", F.coalesce(F.col("days_to_anchor"), F.lit(-1)).cast("long").alias("days_to_anchor"))


@query(
    """with k as (select c_custkey, unnest([cast(c_nationkey as varchar) || c_mktsegment, 'b' || cast(cast(floor(c_acctbal) as bigint) as varchar)]) as key from customer),
    g as (select key from k group by key having count(*) between 2 and 200)
    select distinct x.c_custkey as a, y.c_custkey as b from k x join g using (key) join k y using (key) where x.c_custkey < y.c_custkey"""
)
def block_self_join(spark, sf):
    c = table(spark, sf, "customer")
    return matching.candidate_pairs(c, "c_custkey", F.array(F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment"), F.concat(F.lit("b"), F.floor("c_acctbal").cast("string"))))


_SETS = """a as (select distinct user_id, cast(ts as date) as day from events where event_type = 'click'), b as (select distinct user_id, cast(ts as date) as day from events where event_type = 'view')"""


@query(f"with {_SETS}, u as (select 'union' as op, * from (select * from a union select * from b) union all select 'intersect', * from (select * from a intersect select * from b) union all select 'except', * from (select * from a except select * from b)) select op, user_id, count(*) as n from u group by 1, 2")
def set_ops(spark, sf):
    """All three set results from one pass: which side a day came from."""
    e = table(spark, sf, "events").where("event_type in ('click', 'view')").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(F.col("event_type") == "click").alias("a"), F.max(F.col("event_type") == "view").alias("b"))
    ops = F.array_compact(F.array(F.lit("union"), F.when(F.col("a") & F.col("b"), "intersect"), F.when(F.col("a") & ~F.col("b"), "except")))
    return e.select("user_id", F.explode(ops).alias("op")).groupBy("op", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("select min(doc_id) as doc_id, count(*) as n, arg_min(lang, doc_id) as lang, array_to_string(list_sort(list(distinct source)), ',') as sources from documents group by text")
def fold_duplicates(spark, sf):
    f = relational.fold(table(spark, sf, "documents"), "text", "doc_id", ["lang"], ["source"])
    return f.select("doc_id", "n", "lang", F.array_join("source", ",").alias("sources"))


@query("select o_custkey, sha256(string_agg(cast(o_orderkey as varchar) || o_orderstatus, '|' order by cast(o_orderkey as varchar) || o_orderstatus)) as fingerprint from orders group by o_custkey")
def fingerprint(spark, sf):
    return relational.fingerprint(table(spark, sf, "orders"), "o_custkey", F.concat(F.col("o_orderkey").cast("string"), "o_orderstatus"))


@query("with t as (select item_id, list_sort(regexp_extract_all(lower(text), '[a-z0-9]+')) as bag from benchmark) select a.item_id as a, b.item_id as b from t a join t b on a.bag = b.bag and a.item_id < b.item_id")
def token_bag_equal(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(text.tokens(F.col("text"))), " ").alias("bag"))
    return t.select(F.col("item_id").alias("a"), "bag").join(t.select(F.col("item_id").alias("b"), "bag"), "bag").where("a < b").select("a", "b")


# ---- scalars, scores and rules


@query("select p_partkey, cast(ceil(p_size * 36525 / 1200.0) as bigint) as max_days, cast(ceil(p_size * 36525 / 2400.0) as bigint) as half, cast(ceil(p_size * 36525 / 3600.0) as bigint) as third from part")
def ceil_threshold(spark, sf):
    m = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", dates.ceil_threshold(m).alias("max_days"), dates.ceil_threshold(m, 1, 2).alias("half"), dates.ceil_threshold(m, 1, 3).alias("third"))


def _phonetic_sql(column: str) -> str:
    out = f"lower({column})"
    for a, b in text.PHONETIC:
        out = f"replace({out}, '{a}', '{b}')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        out = f"regexp_replace({out}, '{c}{c}+', '{c}', 'g')"
    return out


@query(f"with t as (select n_nationkey, regexp_replace(lower(n_name), '[^a-z]', '', 'g') as t from nation), p as (select n_nationkey, {_phonetic_sql('t')} as p from t) select n_nationkey, case when length(p) > 3 then regexp_replace(p, '[aue]+$', '') else p end as phonetic from p")
def phonetic_names(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", text.phonetic_token(F.col("n_name")).alias("phonetic"))


@query("select a.n_nationkey as a, b.n_nationkey as b, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) as similarity from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey")
def jaro_winkler_pairs(spark, sf):
    n = table(spark, sf, "nation")
    side = lambda p: n.select(F.col("n_nationkey").alias(p), F.col("n_name").alias(f"{p}n"), "n_regionkey")
    return side("a").join(side("b"), "n_regionkey").where("a < b").select("a", "b", F.round(text.jaro_winkler("an", "bn"), 6).alias("similarity"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / (1 + exp(-(-2.0 + 3.0 * l_discount * 10 + 0.02 * l_quantity))), 6) as p, case when l_returnflag = 'R' then round(least(1 / (1 + exp(-(-2.0 + 3.0 * l_discount * 10 + 0.02 * l_quantity))), 0.35), 6) else round(1 / (1 + exp(-(-2.0 + 3.0 * l_discount * 10 + 0.02 * l_quantity))), 6) end as clamped from lineitem")
def logistic_score(spark, sf):
    p = scores.logistic({"d": F.col("l_discount") * 10, "q": F.col("l_quantity")}, {"bias": -2.0, "d": 3.0, "q": 0.02})
    held = scores.clamped(p, F.lit(False), (F.col("l_returnflag") == "R").cast("int"), F.lit(False))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(p, 6).alias("p"), F.round(held, 6).alias("clamped"))


_RULES = [("license|licensed", "legal"), ("[0-9]{4}", "number"), ("\\|", "menu"), ("the ", "english"), ("(der|die) ", "german")]


@query("select doc_id, case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{v}'" for p, v in _RULES) + " else 'unknown' end as label from documents")
def first_match_rules(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_match(F.lower("text"), _RULES, "unknown").alias("label"))


_CLASSES = {"english": [" the ", " and ", " of "], "french": [" le ", " les ", " et "], "german": [" der ", " und ", " die "]}


@query(
    "with c as (select doc_id, " + ", ".join("(" + " + ".join(f"cast(regexp_matches(lower(text), '{p}') as int)" for p in ps) + f") as {k}" for k, ps in _CLASSES.items()) + " from documents), u as (select doc_id, unnest([struct_pack(h := english, l := 'english'), struct_pack(h := french, l := 'french'), struct_pack(h := german, l := 'german')]) as x from c), r as (select doc_id, x.h as h, x.l as l, row_number() over (partition by doc_id order by x.h desc, x.l) as k, count(*) over (partition by doc_id, x.h) as same from u) select doc_id, case when h = 0 or same > 1 then 'unknown' else l end as label, h as hits from r where k = 1"
)
def doc_classify(spark, sf):
    v = text.vote(F.lower("text"), _CLASSES)
    return table(spark, sf, "documents").select("doc_id", v.alias("v")).select("doc_id", "v.label", "v.hits")


@query("select page_id, case when regexp_matches(lower(html), '^\\s*<(!doctype html|html)') then 'html' else 'text' end as kind from pages")
def magic_sniff(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.sniff(F.col("html").cast("binary")).alias("kind"))


@query(
    f"""with o as (select o_orderkey, cast(o_orderdate as date) as remand, case when o_orderkey % 3 = 0 then cast(o_orderdate as date) + cast(o_orderkey % 120 as int) end as cs, case when o_orderkey % 5 = 0 then cast(o_orderdate as date) + cast(o_orderkey % 100 as int) end as app, cast(12 * (1 + o_orderkey % 15) as int) as months from orders),
    p as (select *, case when months >= 120 then 90 else 60 end as period, date '1998-06-01' as today from o), q as (select *, remand + period as accrual, remand + 60 as other from p)
    select o_orderkey, accrual, case when cs < remand then 'DEFAULT_BAIL_REVIEW' when months = 120 and ((cs is null and other <= today and today < accrual) or (cs is not null and other <= cs and cs < accrual)) then 'DEFAULT_BAIL_REVIEW'
      when cs is null and today >= accrual then case when app >= accrual then 'DEFAULT_BAIL_RIGHT_ASSERTED' else 'URGENT_DEFAULT_BAIL' end when cs is null then case when accrual - today <= 7 then 'DEFAULT_BAIL_WINDOW_SOON' end
      when cs < accrual then null when app >= accrual and app < cs then 'DEFAULT_BAIL_RIGHT_ASSERTED' when app = cs or app < accrual then 'DEFAULT_BAIL_REVIEW' else 'DEFAULT_BAIL_RIGHT_LOST' end as default_bail from q""",
    dates="accrual",
)
def default_bail(spark, sf):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    o = table(spark, sf, "orders").select(
        "o_orderkey", d.alias("first_remand_date"), F.when(k % 3 == 0, F.date_add(d, (k % 120).cast("int"))).alias("charge_sheet_date"), F.when(k % 5 == 0, F.date_add(d, (k % 100).cast("int"))).alias("default_bail_application_date"),
        F.lit("investigation").alias("status"), F.lit("term").alias("term_kind"), (12 * (1 + k % 15)).cast("int").alias("term_months"), F.lit(None).cast("int").alias("min_months"), F.lit(None).cast("int").alias("special_period"),
    )
    return rules.default_bail(o, F.lit("1998-06-01").cast("date")).select("o_orderkey", "accrual", "default_bail")


_STATUS = """with c as (select o_orderkey as k, o_custkey, case o_orderkey % 7 when 0 then 'convicted' when 1 then 'acquitted' else 'trial' end as status, o_orderkey % 11 <> 0 as cust, o_orderkey % 2 = 0 as after, o_orderkey % 5 as others, 1 + o_orderkey % 3 as offences,
      o_orderkey % 13 = 0 as fine, o_orderkey % 17 = 0 as special, case when o_orderkey % 19 = 0 then 'life' else 'term' end as kind, 12 * (1 + o_orderkey % 9) as months, o_orderkey % 4 = 0 as first, cast(floor(o_totalprice / 300) as bigint) % 1500 as counted, o_orderkey % 23 = 0 as needs from orders),
    t as (select *, case when kind = 'term' then cast(ceil(months * 36525 / 1200.0) as bigint) end as mx, case when kind = 'term' then case when first then cast(ceil(months * 36525 / 3600.0) as bigint) else cast(ceil(months * 36525 / 2400.0) as bigint) end end as thr from c),
    d as (select *, case when status = 'convicted' then 'NOT_APPLICABLE' when status = 'acquitted' then case when after and others = 0 then 'CRITICAL_ACQUITTED_DETAINED' else 'NOT_APPLICABLE' end when not cust then 'NOT_APPLICABLE'
      when kind = 'life' then case when needs then 'REVIEW' else 'EXCLUDED_479' end when fine then 'REVIEW' when counted >= mx then 'CRITICAL_MUST_RELEASE' when special then 'REVIEW' when others > 0 then 'REVIEW_MULTIPLE_CASES' when offences > 1 then 'REVIEW'
      when counted >= thr then case when needs then 'REVIEW' else 'ELIGIBLE' end else case when needs then 'REVIEW' else 'NOT_YET' end end as status_out from t)"""


@query(f"{_STATUS} select k, coalesce(mx, -1) as max_days, coalesce(thr, -1) as threshold_days, status_out from d")
def eligibility_case(spark, sf):
    c = rules.case_status(_cases(spark, sf))
    return c.select("k", F.coalesce("max_days", F.lit(-1)).alias("max_days"), F.coalesce("threshold_days", F.lit(-1)).alias("threshold_days"), "status_out")


def _cases(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("k"), "o_custkey", F.when(k % 7 == 0, "convicted").when(k % 7 == 1, "acquitted").otherwise("trial").alias("status"), (k % 11 != 0).alias("in_custody"), (k % 2 == 0).alias("detained_after_end"), (k % 5).alias("n_other_pending"), F.lit(1).alias("n_charges"), (1 + k % 3).alias("n_offences"),
        (k % 13 == 0).alias("all_fine_only"), (k % 17 == 0).alias("special_law"), F.when(k % 19 == 0, "life").otherwise("term").alias("term_kind"), (12 * (1 + k % 9)).alias("term_months"), (k % 4 == 0).alias("first_offender"), (F.floor(F.col("o_totalprice") / 300) % 1500).alias("counted_days"),
        F.lit(None).cast("long").alias("lenient_days"), (k % 23 == 0).cast("int").alias("n_needs"),
    )


@query(f"""{_STATUS}, o as (select *, case when status_out = 'CRITICAL_MUST_RELEASE' then counted - mx when counted >= thr and status_out in ('ELIGIBLE', 'REVIEW', 'REVIEW_MULTIPLE_CASES') then counted - thr end as late from d)
    select o_custkey, arg_min(status_out, list_position({rules.URGENCY!r}, status_out)) as status, max(late) as days_overdue, count(*) as n_cases from o group by 1""")
def person_roll_up(spark, sf):
    return rules.roll_up(rules.case_status(_cases(spark, sf)), "o_custkey")


# ---- monitoring


_ALERTS = """a as (select o_orderkey, cast(o_orderdate as date) - date '1998-06-01' as n from orders), k as (select o_orderkey, case when n < 0 then 'OVERDUE' when n = 0 then 'DUE_0' when n <= 7 then 'DUE_7' when n <= 30 then 'DUE_30' end as kind from a)"""


@query(f"with {_ALERTS} select o_orderkey, kind, case when kind in ('OVERDUE', 'DUE_0') then 'critical' when kind = 'DUE_7' then 'warning' else 'info' end as severity, kind || ':' || o_orderkey as dedupe_key from k where kind is not null")
def due_alerts(spark, sf):
    return monitor.due_alerts(table(spark, sf, "orders"), F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date"), F.col("o_orderkey")).select("o_orderkey", "kind", "severity", "dedupe_key")


@query(
    """with s as (select 'k' || o_orderkey as dedupe_key, case when o_orderkey % 4 = 0 then 'auto_resolved' else 'open' end as s, cast(o_orderdate as date) as o, false as e from orders where o_orderkey % 2 = 0),
    n as (select 'k' || o_orderkey as dedupe_key from orders where o_orderkey % 3 = 0),
    j as (select coalesce(s.dedupe_key, n.dedupe_key) as dedupe_key, s, o, n.dedupe_key is not null as now from s full outer join n on s.dedupe_key = n.dedupe_key),
    r as (select dedupe_key, case when s is null then 'open' when not now then 'auto_resolved' when s = 'auto_resolved' then 'reopened' else s end as state, case when s is null or (s = 'auto_resolved' and now) then date '1998-06-01' else o end as opened_on from j)
    select dedupe_key, state, opened_on, state <> 'auto_resolved' and date '1998-06-01' - opened_on >= 3 as escalated from r""",
    dates="opened_on",
)
def alerts_lifecycle(spark, sf):
    o = table(spark, sf, "orders").withColumn("dedupe_key", F.concat(F.lit("k"), F.col("o_orderkey").cast("string")))
    stored = o.where("o_orderkey % 2 = 0").select("dedupe_key", F.when(F.col("o_orderkey") % 4 == 0, "auto_resolved").otherwise("open").alias("state"), F.to_date("o_orderdate").alias("opened_on"), F.lit(False).alias("escalated"))
    return monitor.lifecycle(stored, o.where("o_orderkey % 3 = 0"), F.lit("1998-06-01").cast("date"))


def _changes(events):
    """Errors raise a user's alert, signups clear it, every fifth purchase acknowledges it; two alerts a user."""
    action = F.when(F.col("event_type") == "error", "holds").when(F.col("event_type") == "signup", "gone").when((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0), "acknowledged")
    severity = F.get(F.array(F.lit("critical"), F.lit("high"), F.lit("medium")), (F.col("event_id") % 3).cast("int"))
    key = F.concat_ws(":", "user_id", F.col("event_id") % 2)
    return events.select(key.alias("dedupe_key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), action.alias("action"), severity.alias("severity")).where("action is not null")


_TRANSITIONS = """select dedupe_key, epoch_us(moment) as at_us, transition, severity from (
    with recursive c as (select user_id || ':' || event_id % 2 as k, ts as moment, row_number() over (partition by user_id, event_id % 2 order by ts, event_id) as i,
        case event_type when 'error' then 'holds' when 'signup' then 'gone' else 'acknowledged' end as action, (['critical', 'high', 'medium'])[event_id % 3 + 1] as severity
        from events where event_type in ('error', 'signup') or (event_type = 'purchase' and event_id % 5 = 0)),
    s as (select k, 0::bigint as i, 'none' as state, 'none' as was, null::timestamp as moment, null::timestamp as created, null::varchar as severity from (select distinct k from c)
          union all
          select s.k, c.i, case when c.action = 'holds' and s.state in ('none', 'auto_resolved') then 'open' when c.action = 'gone' and s.state = 'open' then 'auto_resolved' when c.action = 'acknowledged' and s.state = 'open' then 'acknowledged' else s.state end,
                 s.state, c.moment, case when s.state = 'none' and c.action = 'holds' then c.moment else s.created end, case when s.state = 'none' and c.action = 'holds' then c.severity else s.severity end
          from s join c on c.k = s.k and c.i = s.i + 1),
    m as (select *, lead(moment) over (partition by k order by i) as until from s where state <> was),
    e as (select k, min(greatest(created + interval 3 day, moment)) as moment, min(severity) as severity from m where state = 'open' and severity in ('critical', 'high') and (until is null or until > greatest(created + interval 3 day, moment))
            and greatest(created + interval 3 day, moment) <= (select date_trunc('millisecond', max(moment)) from c) group by k)
    select k as dedupe_key, moment, case when state = 'open' then case when was = 'none' then 'opened' else 'reopened' end else state end as transition, severity from m union all select k, moment, 'escalated', severity from e)"""


@query(_TRANSITIONS)
def alert_transitions(spark, sf):
    """Every step of every alert over all events, by windows."""
    return monitor.transitions(_changes(table(spark, sf, "events"))).select("dedupe_key", F.unix_micros("at").alias("at_us"), "transition", "severity")


@query(_TRANSITIONS)
def alert_transitions_stream(spark, sf):
    """The same from a stream of the events that keeps a state for each alert, with timers for escalation."""
    out = ordered.to_table(spark, f"{sf}/event[s].parquet", lambda s: ordered.alert_transitions(_changes(s)))
    return out.select("dedupe_key", F.unix_micros("at").alias("at_us"), "transition", "severity")


@query(SQL["sliding_failures"])
def sliding_failures_stream(spark, sf):
    """`sliding_failures` from a stream that remembers failures since the last success."""
    by_type = lambda kind: F.col("event_type") == kind
    out = ordered.to_table(spark, f"{sf}/event[s].parquet", lambda s: ordered.failures_since_success(s, "user_id", "event_id", "ts", by_type("error"), by_type("signup"), 360))
    return out.select("event_id", F.col("key").alias("user_id"), "failures")


# ---- retrieval


@query(
    """with d as (select doc_id as id, regexp_extract_all(lower(text), '[a-z0-9]+') as ts from documents), t as (select id, unnest(ts) as term from d), tf as (select id, term, count(*) as tf from t group by all), l as (select id, len(ts) as dl from d), s as (select count(*) as n, avg(dl) as a from l), df as (select term, count(*) as df from tf group by term),
    q as (select distinct item_id as query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark),
    sc as (select query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) as score from q join tf using (term) join df using (term) join l using (id) cross join s group by query, id)
    select query, id, score, place from (select *, row_number() over (partition by query order by score desc, id) as place from sc) where place <= 5"""
)
def bm25_topk(spark, sf):
    return retrieval.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text", 5)


@query(
    """with v as (select vec_id as id, cast(embedding as double[]) as v from embeddings), s as (select a.id as query, b.id as id, round(list_cosine_similarity(a.v, b.v), 6) as score from v a join v b on a.id <> b.id where a.id % 100 = 0)
    select query, id, score, place from (select *, row_number() over (partition by query order by score desc, id) as place from s) where place <= 5"""
)
def vector_knn(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.vector_top_k(v, v.where("id % 100 = 0"), 5)


@query(
    """with c as (select conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as token from conversations where turn = 1), s as (select distinct conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from conversations where turn = 0)
    select conv_id, count(*) as unsupported from c where not exists (select 1 from s where s.conv_id = c.conv_id and s.token = c.token) group by conv_id"""
)
def grounding_verify(spark, sf):
    c = table(spark, sf, "conversations")
    return retrieval.unsupported_tokens(c.where("turn = 1"), c.where("turn = 0"), ["conv_id"], "[a-z0-9]+", "text", "text").groupBy("conv_id").agg(F.count(F.lit(1)).alias("unsupported"))


# ---- evaluation


@query(
    """with c as (select c_nationkey as t, c_mktsegment as k from customer), f as (select k, t, count(*) as n from c group by all),
    p as (select (select sum(n * (n - 1) / 2) from f) as tp, (select sum(n * (n - 1) / 2) from (select count(*) as n from c group by k)) as found, (select sum(n * (n - 1) / 2) from (select count(*) as n from c group by t)) as real)
    select round(tp / found, 6) as precision, round(tp / real, 6) as recall, round(2 * (tp / found) * (tp / real) / (tp / found + tp / real), 6) as f1 from p"""
)
def pair_prf(spark, sf):
    return metrics.pair_prf(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


@query("with s as (select c_mktsegment, c_nationkey, count(*) as n from customer group by all), g as (select c_mktsegment, max(n) as top, sum(n) as n from s group by 1) select round(sum(top) / sum(n), 6) as purity, count(*) filter (where top < n) as impure from g")
def purity(spark, sf):
    return metrics.purity(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


_SCORED = "s as (select l_discount * 8 + 0.1 as p, cast(l_returnflag = 'R' as int) as y from lineitem)"


def _scored(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_discount") * 8 + 0.1).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


@query(f"with {_SCORED} select cast(least(floor(p * 10), 9) as int) as bin, count(*) as n, round(avg(p), 6) as predicted, round(avg(y), 6) as observed from s group by 1")
def calibration(spark, sf):
    return metrics.calibration(_scored(spark, sf), "p", "y")


@query(
    f"""with {_SCORED}, g as (select p, sum(y) as pos, sum(1 - y) as neg from s group by p), b as (select pos, neg, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as below from g)
    select round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) as auc, (select round(avg(pow(p - y, 2)), 6) from s) as brier from b"""
)
def auc_brier(spark, sf):
    return metrics.auc_brier(_scored(spark, sf), "p", "y")


@query(
    """with d as (select o_orderkey, cast(o_orderdate as date) as s, (select cast(min(l_shipdate) as date) from lineitem where l_orderkey = o_orderkey) as e from orders)
    select o_orderkey, case when e is not null then cast(e - s > 60 as int) when date '2001-08-01' - s > 60 then 1 else -1 end as label from d"""
)
def censored_label(spark, sf):
    ship = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.min("l_shipdate")).alias("e"))
    j = table(spark, sf, "orders").join(ship, "o_orderkey", "left")
    return j.select("o_orderkey", metrics.censored_label(F.to_date("o_orderdate"), F.col("e"), 60, F.lit("2001-08-01").cast("date")).alias("label"))
