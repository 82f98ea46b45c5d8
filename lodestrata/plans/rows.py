"""Queries on sinks, upserts, keys and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import time as D
from lodestrata.operators import rows as R

from .catalog import query, table


def _halves(spark, d):
    """Events before and after the middle of January 2024: a stored state and a new run."""
    e = table(spark, d, "events")
    return e.where("ts < timestamp_ntz'2024-01-16'"), e.where("ts >= timestamp_ntz'2024-01-16'")


@query("""with s as (select event_id, user_id, event_type, ts, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events)
select user_id, event_type, event_id, ts::date as first_day from s where r = 1""")
def snk1_insert_absent(spark, d):
    old, new = (x.select("user_id", "event_type", "event_id", "ts") for x in _halves(spark, d))
    first = R.best_per_key(old, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    out = R.insert_absent(first, new, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return out.select("user_id", "event_type", "event_id", F.col("ts").cast("date").alias("first_day"))


@query("""with o as (select user_id, min(ts) as first_seen, max(ts) as last_seen, max_by(event_type, (ts, event_id)) as kind, count(*) as n from events where ts < timestamp '2024-01-16' group by 1),
n as (select user_id, min(ts) as first_seen, max(ts) as last_seen, max_by(event_type, (ts, event_id)) as kind, count(*) as n from events where ts >= timestamp '2024-01-16' group by 1)
select coalesce(o.user_id, n.user_id) as user_id, epoch_us(least(o.first_seen, n.first_seen)) as first_us, epoch_us(greatest(o.last_seen, n.last_seen)) as last_us, coalesce(n.kind, o.kind) as kind, coalesce(o.n, n.n) as n
from o full join n on o.user_id = n.user_id""")
def snk7_upsert_first_seen(spark, d):
    def state(e):
        return e.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("n"))

    old, new = map(state, _halves(spark, d))
    out = R.upsert(old, new, ["user_id"], {"first_seen": "min", "last_seen": "max", "kind": "replace", "n": "keep"})
    return out.select("user_id", D.micros(F.col("first_seen")).alias("first_us"), D.micros(F.col("last_seen")).alias("last_us"), "kind", "n")


@query("""with o as (select user_id, max(value) as v from events where ts < timestamp '2024-01-16' and user_id % 7 <> 0 group by 1),
n as (select user_id, max(value) as v from events where ts >= timestamp '2024-01-16' and user_id % 5 <> 0 group by 1)
select coalesce(o.user_id, n.user_id) as user_id, case when o.user_id is null then 'create' when n.user_id is null then 'deactivate' else 'update' end as action
from o full join n on o.user_id = n.user_id where o.v is distinct from n.v or o.user_id is null or n.user_id is null""")
def snk15_change_set(spark, d):
    old, new = _halves(spark, d)
    state = lambda e: e.groupBy("user_id").agg(F.max("value").alias("v"))
    return R.change_set(state(old.where("user_id % 7 != 0")), state(new.where("user_id % 5 != 0")), "user_id", ["v"])


@query("""select event_type, user_id, count(*) as n from events where ts >= timestamp '2024-01-16' and user_id % 3 = 0 group by 1, 2
union all
select event_type, user_id, count(*) as n from events where ts < timestamp '2024-01-16' and user_id not in (select user_id from events where ts >= timestamp '2024-01-16' and user_id % 3 = 0) group by 1, 2""")
def snk9_replace_partitions(spark, d):
    old, new = _halves(spark, d)
    count = lambda e: e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return R.replace_partitions(count(old), count(new.where("user_id % 3 = 0")), ["user_id"])


@query("""with o as (select user_id, count(*)::bigint as retries from events where event_type = 'error' and ts < timestamp '2024-01-03' group by 1),
f as (select distinct user_id from events where event_type = 'error' and ts >= timestamp '2024-01-29')
select coalesce(o.user_id, f.user_id) as user_id, case when f.user_id is not null then 'open' else 'resolved' end as state,
case when f.user_id is not null then coalesce(o.retries + 1, 0) else o.retries end as retries from o full join f on o.user_id = f.user_id""")
def snk12_dead_letters(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    open_ = e.where("ts < timestamp_ntz'2024-01-03'").groupBy("user_id").agg(F.count("*").alias("retries"))
    return R.dead_letters(open_, e.where("ts >= timestamp_ntz'2024-01-29'"), "user_id")


@query("""select a.doc_id, (b.h is distinct from a.h) as changed from
(select doc_id, md5(text) as h from documents) a left join (select doc_id, md5(case when doc_id % 10 = 3 then text || '.' else text end) as h from documents where doc_id % 4 <> 1) b using (doc_id)""")
def snk10_changed_index(spark, d):
    docs = table(spark, d, "documents")
    new = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    text = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    old = docs.where("doc_id % 4 != 1").select("doc_id", F.md5(text.cast("binary")).alias("old"))
    return new.join(old, "doc_id", "left").select("doc_id", (~F.col("h").eqNullSafe(F.col("old"))).alias("changed"))


@query("""with r as (select user_id, event_type, event_id, ts, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events)
select user_id, event_type, event_id, epoch_us(ts) as us from r where k = 1""")
def join10_latest_per_key(spark, d):
    out = R.latest_per_key(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", D.micros(F.col("ts")).alias("us"))


@query("""with r as (select *, row_number() over (partition by o_custkey order by o_orderpriority, o_totalprice desc, o_orderkey) as k from orders)
select o_custkey, o_orderkey, o_orderpriority from r where k = 1""")
def win1_best_per_key(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return R.best_per_key(o, ["o_custkey"], [F.col("o_orderpriority"), -F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""with a as (select user_id, event_id, event_type, value, date_diff('day', ts::date, date '2024-01-31') <= 14 as recent from events),
f as (select *, row_number() over (partition by user_id, recent, event_type order by value desc, event_id) > 1 as later from a),
p as (select *, row_number() over (partition by user_id order by later, value desc, event_id) as pick from f)
select user_id, event_id, event_type, recent, pick from p where pick <= 8""")
def win2_stratified_top(spark, d):
    recent = F.datediff(F.lit("2024-01-31").cast("date"), F.col("ts").cast("date")) <= 14
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", recent.alias("recent"))
    out = R.stratified_top(e, ["user_id"], ["recent", "event_type"], [F.desc("value"), F.col("event_id")], 8)
    return out.select("user_id", "event_id", "event_type", "recent", F.col("pick").cast("long").alias("pick"))


@query("""with m as (select user_id, max(case when event_type <> 'error' then event_id end) as last_ok from events group by 1)
select e.user_id, count(*) filter (where m.last_ok is null or e.event_id > m.last_ok) as streak from events e join m using (user_id) group by 1""")
def win4_failure_streak(spark, d):
    return R.trailing_streak(table(spark, d, "events"), ["user_id"], ["event_id"], F.col("event_type") == "error")


@query("""with g as (select user_id, event_type, sum(case when value < 100 then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as i, (value < 100)::int as h from events),
r as (select user_id, i, sum(h) as n from g group by 1, 2) select user_id, max(n)::bigint as longest from r group by 1""")
def win8_longest_streak(spark, d):
    return R.longest_streak(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 100)


@query("""select user_id, epoch_us(max(case when event_type = 'purchase' then ts end)) as last_success, epoch_us(max(case when event_type = 'signup' then ts end)) as last_new,
date_diff('day', max(case when event_type = 'purchase' then ts end)::date, date '2024-02-01')::bigint as days_since from events group by 1""")
def win5_last_success(spark, d):
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    days = F.datediff(F.lit("2024-02-01").cast("date"), last("purchase").cast("date")).cast("long")
    return table(spark, d, "events").groupBy("user_id").agg(D.micros(last("purchase")).alias("last_success"), D.micros(last("signup")).alias("last_new"), days.alias("days_since"))


@query("select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) as attempt from events")
def win6_attempt_number(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).cast("long").alias("attempt"))


@query("""with r as (select l_suppkey, l_partkey, sum(l_quantity) as q, row_number() over (partition by l_suppkey order by sum(l_quantity) desc, l_partkey) as k from lineitem group by 1, 2)
select l_suppkey, l_partkey, q, k as rank, min(case when q < 20 then k end) over (partition by l_suppkey) as first_small from r qualify k <= 5""")
def win7_rank_per_key(spark, d):
    from pyspark.sql import Window

    sums = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("q"), "l_partkey")).cast("long"))
    return ranked.withColumn("first_small", F.min(F.when(F.col("q") < 20, F.col("rank"))).over(Window.partitionBy("l_suppkey"))).where("rank <= 5")


@query("""select event_id, median(value) over (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding) as median_before,
coalesce(value < 0.5 * median(value) over (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding), false) as dropped from events""")
def win9_median_of_previous(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)
    before = F.sort_array(F.collect_list("value").over(w))
    n = F.size(before)
    middle = F.when(n > 0, (F.try_element_at(before, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(before, F.floor(n / 2).cast("int") + 1)) / 2)
    e = table(spark, d, "events").select("event_id", "value", middle.alias("median_before"))
    return e.select("event_id", "median_before", F.coalesce(F.col("value") < 0.5 * F.col("median_before"), F.lit(False)).alias("dropped"))


@query("""select event_id, last_value(case when event_type = 'signup' then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as carried from events""")
def win10_carry_forward(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "signup", F.col("value")))
    return R.carry_forward(e, ["user_id"], ["ts", "event_id"], "v", "carried").select("event_id", "carried")


@query("""with r as (select c_nationkey, c_mktsegment, c_custkey, row_number() over (partition by c_nationkey, c_mktsegment order by c_acctbal desc, c_custkey) as k from customer)
select c_nationkey, c_mktsegment, c_custkey, row_number() over (partition by c_nationkey order by k, c_mktsegment) as place from r qualify place <= 6""")
def win12_round_robin(spark, d):
    from pyspark.sql import Window

    r = table(spark, d, "customer").withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")))
    return r.select("c_nationkey", "c_mktsegment", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("k", "c_mktsegment")).cast("long").alias("place")).where("place <= 6")


@query("""select o_orderkey, count(*) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) > 1 as revised from orders""")
def win13_created_or_revised(spark, d):
    from pyspark.sql import Window

    first = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", (F.row_number().over(first) > 1).alias("revised"))


@query("""select event_id, exists (select 1 from events n where n.user_id = e.user_id and n.event_type = e.event_type and (n.ts, n.event_id) > (e.ts, e.event_id) and n.ts <= e.ts + interval 6 hour) as repeated from events e""")
def win14_lookahead_duplicate(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    follows = F.lead("ts").over(w)
    return table(spark, d, "events").select("event_id", F.coalesce(follows <= F.col("ts") + F.expr("interval 6 hours"), F.lit(False)).alias("repeated"))


@query("select event_id, round(value * pow(2.0, -(date_diff('day', ts::date, date '2024-01-31')::double) / 45.0), 6) as weight from events")
def win15_time_decay(spark, d):
    w = D.decayed(F.col("value"), F.col("ts").cast("date"), F.lit("2024-01-31").cast("date"), F.lit(45.0))
    return table(spark, d, "events").select("event_id", F.round(w, 6).alias("weight"))


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20")
def top1_leads(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)


@query("""with r as (select c_mktsegment, c_custkey, round(c_acctbal, 0) as s, row_number() over (partition by c_mktsegment order by round(c_acctbal, 0) desc, c_nationkey desc, c_custkey) as rank from customer) select * from r where rank <= 20""")
def top2_ranked(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_nationkey", F.round("c_acctbal", 0).alias("s"))
    return R.top_n(c, ["c_mktsegment"], [F.desc("s"), F.desc("c_nationkey"), F.col("c_custkey")], 20).select("c_mktsegment", "c_custkey", "s", F.col("rank").cast("long").alias("rank"))


@query("select event_id from events order by ts desc, event_id limit 50")
def top3_newest(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id")


@query("select o_orderkey, case o_orderstatus when 'F' then 0 when 'P' then 1 else 2 end as grade from orders order by grade, o_orderdate desc, o_orderkey limit 100")
def top4_grade_order(spark, d):
    grade = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return table(spark, d, "orders").withColumn("grade", grade).orderBy("grade", F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "grade")


@query("select c_custkey from customer order by sha256('seed-20260725|' || c_custkey::varchar), c_custkey limit 100")
def top8_seeded_sample(spark, d):
    return R.hash_sample(table(spark, d, "customer"), "c_custkey", "seed-20260725", 100).select("c_custkey")


@query("""with r as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by sha256('split|' || c_custkey::varchar), c_custkey) as k from customer),
p as (select c_custkey, row_number() over (order by k, c_mktsegment) as place from r)
select c_custkey, case when place <= 700 then 'train' when place <= 900 then 'calibration' else 'test' end as split from p""")
def top9_stratified_split(spark, d):
    from pyspark.sql import Window

    h = F.sha2(F.concat(F.lit("split|"), F.col("c_custkey").cast("string")), 256)
    c = table(spark, d, "customer").withColumn("k", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(h, "c_custkey")))
    # A row's place is the rows of smaller ranks (at most one a segment each) and the segments before.
    sizes = c.groupBy("c_mktsegment").agg(F.max("k").alias("size"))
    others = sizes.select(F.col("c_mktsegment").alias("seg"), F.col("size").alias("other"))
    all_ = others.agg(F.array_sort(F.collect_list(F.struct("seg", "other"))).alias("segs"))
    place = F.aggregate("segs", F.lit(0).cast("long"), lambda acc, s: acc + F.least(s["other"], F.when(s["seg"] <= F.col("c_mktsegment"), F.col("k")).otherwise(F.col("k") - 1)))
    ranked = c.crossJoin(F.broadcast(all_)).select("c_custkey", place.alias("place"))
    return ranked.select("c_custkey", F.when(F.col("place") <= 700, "train").when(F.col("place") <= 900, "calibration").otherwise("test").alias("split"))


@query("select p_brand, arg_max(p_partkey, (p_retailprice, p_partkey)) as best from part group by 1")
def top15_argmax(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("best"))


@query("select user_id, list_slice(list(event_id order by value desc, event_id), 1, 3)::varchar as top from events group by 1")
def top17_cap(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    top = table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 3")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "event_id"))), lambda x: x["event_id"].cast("string"))
    return top.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("top"))


@query("""select user_id, 'jan' as part from events where ts < timestamp '2024-01-16' group by 1 union all select user_id, 'late' from events where ts >= timestamp '2024-01-16' group by 1""")
def set1_union(spark, d):
    old, new = _halves(spark, d)
    return old.select("user_id").distinct().withColumn("part", F.lit("jan")).unionByName(new.select("user_id").distinct().withColumn("part", F.lit("late")))


@query("""with r as (select p_partkey, lower(p_name) as name, p_brand, row_number() over (partition by lower(p_name), p_brand order by p_partkey) as k from part) select name, p_brand, p_partkey from r where k = 1""")
def set2_first_wins(spark, d):
    p = table(spark, d, "part").select(F.lower("p_name").alias("name"), "p_brand", "p_partkey")
    return R.best_per_key(p, ["name", "p_brand"], [F.col("p_partkey")])


@query("select distinct user_id, event_type from events where ts >= timestamp '2024-01-16' except select user_id, event_type from events where ts < timestamp '2024-01-10'")
def set4_unseen(spark, d):
    e = table(spark, d, "events")
    new = e.where("ts >= timestamp_ntz'2024-01-16'").select("user_id", "event_type").distinct()
    return new.join(e.where("ts < timestamp_ntz'2024-01-10'").select("user_id", "event_type").distinct(), ["user_id", "event_type"], "left_anti")


@query("select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'")
def set5_intersection(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("""select count(*) as missing from ((select doc_id from documents except all select doc_id from labels) union all (select doc_id from labels except all select doc_id from documents))""")
def set6_key_sets_equal(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("missing"))


@query("select o_custkey, count(distinct o_orderstatus) as splits from orders group by 1 having count(distinct o_orderstatus) > 1")
def set7_split_leaks(spark, d):
    return R.split_leaks(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("""select user_id, (count(*) filter (where event_type not in ('view', 'click', 'purchase', 'signup')) = 0) as known from events where value > 90 group by 1""")
def set8_subset(spark, d):
    known = F.array(*[F.lit(x) for x in ("view", "click", "purchase", "signup")])
    kinds = table(spark, d, "events").where("value > 90").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return kinds.select("user_id", (F.size(F.array_except("kinds", known)) == 0).alias("known"))


@query("""with h as (select user_id, max(ts) as last from events where ts < timestamp '2024-01-24' and event_type = 'purchase' group by 1),
n as (select user_id, count(*) filter (where event_type = 'purchase') as fresh from events where ts >= timestamp '2024-01-24' group by 1)
select n.user_id, case when h.user_id is null then 'new' when n.fresh > 0 then 'ongoing' when h.last >= timestamp '2024-01-17' then 'cooling' else 'ready' end as state from n left join h using (user_id)""")
def set9_new_ongoing_cooling(spark, d):
    e = table(spark, d, "events")
    h = e.where("ts < timestamp_ntz'2024-01-24' and event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"), F.lit(True).alias("old"))
    n = e.where("ts >= timestamp_ntz'2024-01-24'").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("fresh"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("fresh") > 0, "ongoing").when(F.col("last") >= F.lit("2024-01-17").cast("timestamp_ntz"), "cooling").otherwise("ready")
    return n.join(h, "user_id", "left").select("user_id", state.alias("state"))


@query("""select d.doc_id from documents d anti join labels l on d.doc_id = l.doc_id and l.quality = 0 anti join (select min(doc_id) as doc_id, md5(text) as h from documents group by 2 having count(*) > 1) x on md5(d.text) = x.h and d.doc_id <> x.doc_id""")
def set10_exclusions(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    h = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    first = h.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    kept = h.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_anti")
    return kept.join(first, (kept["h"] == first["h"]) & (kept["doc_id"] != first["first"]), "left_anti").select("doc_id")


@query("""select event_id, 'evt_' || substr(sha256(user_id::varchar || chr(31) || event_type || chr(31) || event_id::varchar), 1, 32) as id from events""")
def str1_stable_id(spark, d):
    return table(spark, d, "events").select("event_id", T.stable_id("evt", F.col("user_id"), F.col("event_type"), F.col("event_id")).alias("id"))
