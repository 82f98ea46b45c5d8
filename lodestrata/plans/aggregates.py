"""Queries on aggregates, scores and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import time as D
from lodestrata.operators import learning as L
from lodestrata.operators import ranges as J
from lodestrata.operators import rows as R
from lodestrata.operators import scoring as S

from .catalog import query, table

AS_OF = "2024-01-31"


@query("select o_custkey, count(*) as n, min(o_orderkey) as first_key from orders group by 1")
def agg1_group(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""with w as (select user_id, event_type, value / 10 * pow(2.0, -(date_diff('day', ts::date, date '2024-01-31')::double) / 45.0) as w from events),
t as (select user_id, event_type, max(w) as top, sum(w) as al from w group by 1, 2)
select user_id, round(least(sum(top + (al - top) * 0.25), 32.0), 6) as need, count(*) as types from t group by 1""")
def agg2_decayed_need(spark, d):
    w = D.decayed(F.col("value") / 10, F.col("ts").cast("date"), F.lit(AS_OF).cast("date"), F.lit(45.0))
    out = S.need_score(table(spark, d, "events").select("user_id", "event_type", "value", "ts"), ["user_id"], "event_type", w)
    return out.select("user_id", F.round("need", 6).alias("need"), "types")


@query("""with g as (select o_custkey, count(distinct o_orderpriority) as types, count(*) filter (where o_orderstatus = 'P') > 0 as ad, count(distinct case when o_orderpriority < '3' then o_orderpriority end) as com, count(distinct date_trunc('year', o_orderdate)) as domains,
bool_or(o_orderstatus = 'F') as a, bool_or(o_orderstatus = 'O') as b, least(sum(o_totalprice) / 100000.0, 32.0) as need from orders group by 1)
select o_custkey, least(round(need, 1) + least(17 + types * 3, 25) + case when ad then 5 else 15 end + least(com * 4 + case when b then 4 else 0 end, 10)
 + (case when domains >= 3 and a then 10 when domains >= 2 and b then 8 else 5 end + case when domains >= 2 and types >= 2 then 3 else 0 end) + case when ad then -10 else 0 end, 99.0) as score from g""")
def agg3_capped_components(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("types"), F.bool_or(F.col("o_orderstatus") == "P").alias("ad"), F.countDistinct(F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority"))).alias("com"), F.countDistinct(F.year("o_orderdate")).alias("domains"), F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderstatus") == "O").alias("b"), F.least(F.sum("o_totalprice") / 100000.0, F.lit(32.0)).alias("need"))
    c = F.col
    return o.select("o_custkey", S.total_score(c("need"), S.role_score(c("types")), S.timing_score(c("ad")), S.commercial_score(c("com"), c("b")), S.confidence_score(c("domains"), c("a"), c("b"), c("types")), F.when(c("ad"), -10).otherwise(0)).alias("score"))


@query("select l_suppkey, count(distinct l_partkey) as parts, count(distinct l_returnflag) as flags, string_agg(distinct l_linestatus, ',' order by l_linestatus) as states from lineitem group by 1")
def agg4_distincts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_returnflag").alias("flags"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), ",").alias("states"))


@query("select user_id, date_diff('day', min(case when event_type <> 'signup' then ts::date end), min(case when event_type = 'signup' then ts::date end))::int as lead_days from events group by 1")
def agg5_lead_time(spark, d):
    first = lambda c: F.min(F.when(c, F.col("ts").cast("date")))
    return table(spark, d, "events").groupBy("user_id").agg(F.datediff(first(F.col("event_type") == "signup"), first(F.col("event_type") != "signup")).alias("lead_days"))


@query("""with g as (select l_partkey, count(distinct case when l_returnflag <> 'R' then l_suppkey end) as sources, count(*) filter (where l_returnflag = 'R' and l_quantity > 48) as retracts, count(*) filter (where l_returnflag = 'R' and l_discount > 0.09) as contradicts, date_diff('day', max(l_shipdate)::date, date '2001-12-01') as quiet, count(distinct l_orderkey) as revisions from lineitem group by 1)
select l_partkey, case when l_partkey % 97 = 0 then 'superseded' when retracts > 0 then 'retracted' when contradicts > 0 then 'disputed' when quiet > 180 then 'stale' when sources >= 2 and revisions > 20 then 'developing' when sources >= 2 then 'corroborated' else 'emerging' end as state, sources from g""")
def agg6_lifecycle(spark, d):
    ret = F.col("l_returnflag") == "R"
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct(F.when(~ret, F.col("l_suppkey"))).alias("sources"), F.count_if(ret & (F.col("l_quantity") > 48)).alias("retracts"), F.count_if(ret & (F.col("l_discount") > 0.09)).alias("contradicts"), F.datediff(F.lit("2001-12-01").cast("date"), F.max("l_shipdate").cast("date")).alias("quiet"), F.countDistinct("l_orderkey").alias("revisions"))
    c = F.col
    return g.select("l_partkey", S.lifecycle(c("l_partkey") % 97 == 0, c("retracts"), c("contradicts"), c("quiet"), c("sources"), c("revisions") - 19).alias("state"), "sources")


@query("select o_custkey, arg_min(o_orderkey, (case o_orderstatus when 'F' then 0 when 'P' then 1 else 2 end, o_orderdate, o_orderkey)) as canonical from orders group by 1")
def agg7_canonical_document(spark, d):
    grade = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(grade, "o_orderdate", "o_orderkey")).alias("canonical"))


@query("""with s as (select user_id, event_id, sum(event_id % 7 + 1) over (partition by user_id, ts::date order by event_id rows unbounded preceding) as spent from events)
select user_id, event_id, spent::bigint as spent, spent <= 10 as admitted from s""")
def agg8_guarded_budget(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("date").alias("day"), (F.col("event_id") % 7 + 1).alias("cost"))
    return S.budget_admission(e, ["user_id", "day"], ["event_id"], "cost", 10).select("user_id", "event_id", "spent", "admitted")


@query("""select user_id, event_type, count(*) as n, round(max(1.0 / (1.0 + date_diff('day', ts::date, date '2024-01-31') / 30.0)), 6) as max_recency, round(sum(value), 4) as total, count(distinct ts::date) as days from events group by 1, 2""")
def agg9_feature_map(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.max(D.recency(F.col("day"), F.lit(AS_OF).cast("date"))), 6).alias("max_recency"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("day").alias("days"))


@query("""with g as (select user_id, bool_or(event_type = 'purchase' and value > 100) as pos, bool_or(event_type = 'view' and value > 150) as cov, bool_or(event_type = 'click') as con from events group by 1)
select user_id, case when pos then 'positive' when cov then 'negative' when con then 'contrastive' else 'unknown' end as label, case when pos or cov then 1.0::double when con then 0.35::double else 0.0::double end as weight from g""")
def agg10_label_resolution(spark, d):
    has = lambda c: F.bool_or(c)
    kind, v = F.col("event_type"), F.col("value")
    g = table(spark, d, "events").groupBy("user_id").agg(has((kind == "purchase") & (v > 100)).alias("pos"), has((kind == "view") & (v > 150)).alias("cov"), has(kind == "click").alias("con"))
    return g.select("user_id", S.label(F.col("pos"), F.col("cov"), F.col("con")).alias("l")).select("user_id", "l.label", "l.weight")


@query("select c_mktsegment, count(*) as n, count(*) filter (where c_acctbal > 0) as positive, count(distinct c_nationkey) as nations from customer group by 1")
def agg11_summary(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("positive"), F.countDistinct("c_nationkey").alias("nations"))


@query("select coalesce(o_orderstatus, 'all') as split, count(*) as n, count(*) filter (where o_totalprice > 250000) as positive from orders group by rollup (o_orderstatus)")
def agg12_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 250000).alias("positive")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("split"), "n", "positive")


@query("""with r as (select o_custkey, o_orderkey, o_totalprice / 500000 as s, o_orderpriority = '1-URGENT' as rel, row_number() over (partition by o_custkey order by o_totalprice / 500000 desc, o_orderkey) as r from orders),
b as (select o_custkey, min(case when rel then r end) as best, sum(pow(s - rel::int, 2)) as sq, count(*) as n from r group by 1)
select count(*) as queries, round(avg(coalesce((best = 1)::int, 0)), 8) as top1, round(avg(coalesce((best <= 3)::int, 0)), 8) as topk, round(avg(coalesce(1.0 / best, 0)), 8) as mrr, round(sum(sq) / sum(n), 8) as brier from b""")
def agg13_ranking_metrics(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 500000).alias("s"), (F.col("o_orderpriority") == "1-URGENT").alias("rel"))
    m = S.ranking_metrics(o, "o_custkey", "o_orderkey", "s", "rel", 3)
    return m.select("queries", *[F.round(c, 8).alias(c) for c in ("top1", "topk", "mrr", "brier")])


@query("select coalesce(l_returnflag, 'all') as slice, count(*) as predicted, count(*) filter (where l_linestatus = 'F') as matched, round(count(*) filter (where l_linestatus = 'F') / count(*), 6) as precision_ from lineitem group by grouping sets ((), (l_returnflag))")
def agg14_sliced_counters(spark, d):
    hit = F.count_if(F.col("l_linestatus") == "F")
    g = table(spark, d, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("predicted"), hit.alias("matched"), F.round(hit / F.count("*"), 6).alias("precision_"))
    return g.select(F.coalesce("l_returnflag", F.lit("all")).alias("slice"), "predicted", "matched", "precision_")


@query("select o_orderstatus as gold, case when o_totalprice > 250000 then 'F' else 'O' end as predicted, count(*) as n from orders group by 1, 2")
def agg15_confusion(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("gold"), F.when(F.col("o_totalprice") > 250000, "F").otherwise("O").alias("predicted")).agg(F.count("*").alias("n"))


@query("""with n as (select o_orderstatus as g, case when o_totalprice > 250000 then 'F' else 'O' end as p from orders),
c as (select x, (select count(*) from n where g = x) as gold, (select count(*) from n where p = x) as pred, (select count(*) from n where g = x and p = x) as tp from (select g as x from n union select p from n))
select round(avg(2.0 * tp / (gold + pred)), 8) as macro_f1 from c""")
def agg13b_macro_f1(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("g"), F.when(F.col("o_totalprice") > 250000, "F").otherwise("O").alias("p"))
    return S.macro_f1(o, "g", "p").select(F.round("macro_f1", 8).alias("macro_f1"))


@query("""select (select count(distinct l_orderkey) from lineitem) <= (select count(*) from orders) as orders_known, (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)) = 0 as no_orphans, (select count(distinct o_custkey) from orders) as customers""")
def agg16_acceptance_gates(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    keys = o.select(F.col("o_orderkey").alias("l_orderkey"))
    a = li.agg(F.countDistinct("l_orderkey").alias("k"))
    b = o.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))
    c = li.join(keys, "l_orderkey", "left_anti").agg(F.count("*").alias("orphans"))
    one = a.crossJoin(b).crossJoin(c)  # three rows of totals
    return one.select((F.col("k") <= F.col("n")).alias("orders_known"), (F.col("orphans") == 0).alias("no_orphans"), "customers")


@query("""with l as (select user_id, arg_max(event_type, (ts, event_id)) as status from events group by 1) select status, count(*) as n from l group by 1""")
def agg19_health_by_status(spark, d):
    l = R.latest_per_key(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    return l.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("""with x as (select user_id, (ts + interval 8 hour)::date as day, count(*) as n from events group by 1, 2) select user_id, median(n) as med, count(*) as days, max(n) as most, bool_or(n = 1) as ever_low from x group by 1""")
def agg20_median_by_local_day(spark, d):
    day = F.from_utc_timestamp(F.col("ts"), "Asia/Shanghai").cast("date")
    x = table(spark, d, "events").groupBy("user_id", day.alias("day")).agg(F.count("*").alias("n"))
    return x.groupBy("user_id").agg(F.median("n").alias("med"), F.count("*").alias("days"), F.max("n").alias("most"), F.bool_or(F.col("n") == 1).alias("ever_low"))


@query("""select user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') as kinds, arg_max(event_id, (value, event_id)) as preferred from events group by 1""")
def agg22_array_union(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("event_type"))))), ",").alias("kinds"), F.max_by("event_id", F.struct("value", "event_id")).alias("preferred"))


@query("""with c as (select user_id, event_type, count(*) as n, min(event_id) as first from events group by 1, 2) select user_id, arg_max(event_type, (n, -first)) as mode from c group by 1""")
def agg23_mode_first_seen(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("mode"))


@query("select o_custkey, max(o_orderdate)::date as last_day, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '|') as urls from orders group by 1")
def agg24_history(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("last_day"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("urls"))


@query("""with p as (select user_id, event_type, min((ts, event_id)) as f from events group by 1, 2) select user_id, string_agg(event_type, '>' order by f) as path from p group by 1""")
def agg25_ordered_distinct(spark, d):
    p = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return p.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ">").alias("path"))


@query("""with k as (select l_suppkey, list_distinct(list(l_partkey % 50)) as s from lineitem group by 1)
select a.l_suppkey as a, b.l_suppkey as b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)), 8) as jaccard, round(len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)), 8) as overlap from k a join k b on a.l_suppkey + 1 = b.l_suppkey""")
def agg26_coefficients(spark, d):
    return _coefficients(table(spark, d, "lineitem"))


def _coefficients(li):
    k = li.groupBy("l_suppkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("s"))
    b = k.select((F.col("l_suppkey") - 1).alias("l_suppkey"), F.col("s").alias("t"))
    return k.join(b, "l_suppkey").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 1).alias("b"), F.round(T.jaccard(F.col("s"), F.col("t")), 8).alias("jaccard"), F.round(T.overlap(F.col("s"), F.col("t")), 8).alias("overlap"))


@query("select c_nationkey, sha256(string_agg(c_custkey::varchar || ':' || c_mktsegment, ';' order by c_custkey)) as digest from customer group by 1")
def agg27_ordered_digest(spark, d):
    item = F.struct("c_custkey", F.concat_ws(":", F.col("c_custkey").cast("string"), "c_mktsegment").alias("t"))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ";"), 256).alias("digest"))


@query("""with r as (select value / 500 as x1, (event_type = 'purchase')::int as y from events) select round(sum((0.5 - y) * x1), 6) as g1, round(sum(0.5 - y), 6) as g0 from r""")
def agg28_gradient(spark, d):
    r = table(spark, d, "events").select((F.col("value") / 500).alias("x1"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return r.agg(F.round(F.sum((0.5 - F.col("y")) * F.col("x1")), 6).alias("g1"), F.round(F.sum(0.5 - F.col("y")), 6).alias("g0"))


@query("select date_trunc('month', o_orderdate)::date as month, o_orderstatus, count(*) as tasks from orders group by 1, 2")
def agg29_backfill_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month"), "o_orderstatus").agg(F.count("*").alias("tasks"))


@query("""with g as (select l_orderkey, l_partkey from lineitem where l_returnflag = 'A'), p as (select l_orderkey, l_partkey from lineitem where l_quantity > 20),
x as (select coalesce(g.l_orderkey, p.l_orderkey) as k, g.l_partkey as a, p.l_partkey as b from (select distinct * from g) g full join (select distinct * from p) p on g.l_orderkey = p.l_orderkey and g.l_partkey = p.l_partkey)
select k, count(a) filter (where b is not null) as tp, count(b) as predicted, count(a) as gold from x group by 1""")
def agg30_ledger_audit(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_quantity") > 20).alias("b")).where("a or b")
    return li.groupBy(F.col("l_orderkey").alias("k")).agg(F.count_if(F.col("a") & F.col("b")).alias("tp"), F.count_if("b").alias("predicted"), F.count_if("a").alias("gold"))


@query()
def ml3_logistic_regression(spark, d):
    o = table(spark, d, "orders").select(F.round(F.col("o_totalprice") / 500000, 1).alias("price"), (F.col("o_orderpriority") < "3").cast("double").alias("urgent"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.lit(1.0).alias("w"))
    m = L.fit_logistic(o, ["price", "urgent"], "y", "w", rounds=200)
    return spark.createDataFrame([(k, float(v)) for k, v in m.items()], "feature string, weight double")


@query("""with p as (select * from (values ('purchase', 'sales', 0), ('purchase', 'legal', 1), ('signup', 'it', 0), ('signup', 'sales', 1), ('signup', 'a', 2), ('signup', 'b', 3), ('signup', 'c', 4), ('signup', 'd', 5), ('signup', 'legal', 6), ('click', 'legal', 0)) t(event, role, place)),
e as (select user_id, event_type as event, max(value) / 100 as recency from events group by 1, 2), r as (select user_id, unnest(['sales', 'legal', 'it', 'none']) as role from (select distinct user_id from events))
select r.user_id, r.role, round(1 - exp(-coalesce(sum(recency * greatest(0.25::double, 1 - place * 0.15::double)), 0)), 8) as prior from r left join p using (role) left join e on e.user_id = r.user_id and e.event = p.event group by 1, 2""")
def ml4_rule_prior(spark, d):
    priors = {"purchase": ("sales", "legal"), "signup": ("it", "sales", "a", "b", "c", "d", "legal"), "click": ("legal",)}
    latest = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.max("value") / 100).alias("recency"))
    by_user = latest.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "recency"))).alias("recencies"))
    rows = by_user.select("user_id", "recencies", F.explode(F.array(*[F.lit(x) for x in ("sales", "legal", "it", "none")])).alias("role"))
    return rows.select("user_id", "role", F.round(S.rule_prior(F.col("role"), F.col("recencies"), priors), 8).alias("prior"))


@query("""with g as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as share), s as (select o_orderkey, o_totalprice / 500000 as p, (o_orderkey % 100) / 100.0 as l, o_orderpriority = '1-URGENT' as y from orders),
b as (select share, avg(pow(p * (1 - share) + l * share - y::int, 2)) as brier from g cross join s group by 1) select share, round(brier, 8) as brier, share = (select arg_min(share, (round(brier, 12), share)) from b) as chosen from b""")
def ml6_calibration_grid(spark, d):
    shares = [0.0, 0.25, 0.5, 0.75, 1.0]
    p, l, y = F.col("o_totalprice") / 500000, (F.col("o_orderkey") % 100) / 100.0, (F.col("o_orderpriority") == "1-URGENT").cast("int")
    # The grid is a handful of columns of one pass, not a cross join of rows.
    sums = table(spark, d, "orders").agg(*[F.avg(F.pow(L.blend(p, l, s) - y, 2)).alias(f"b{i}") for i, s in enumerate(shares)])
    grid = sums.select(F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"b{i}").alias("b")) for i, s in enumerate(shares)])).alias("g"), F.array(*[F.struct(F.round(f"b{i}", 12), F.lit(s).alias("s")) for i, s in enumerate(shares)]).alias("all"))
    return grid.select("g.share", F.round("g.b", 8).alias("brier"), (F.col("g.share") == F.array_min("all")["s"]).alias("chosen"))


@query("""with c as (select user_id, cutoff from (select distinct user_id from events) cross join (select unnest([date '2024-01-12', date '2024-01-20']) as cutoff)),
f as (select c.user_id, c.cutoff, count(e.event_id) filter (where e.ts::date <= c.cutoff and date_diff('day', e.ts::date, c.cutoff) <= 10) as usable, count(e.event_id) filter (where e.event_type = 'purchase' and e.ts::date > c.cutoff and date_diff('day', c.cutoff, e.ts::date) <= 7) as future from c left join events e using (user_id) group by 1, 2)
select user_id, cutoff::date as cutoff, usable, future > 0 as positive, case when future > 0 then 'positive' when usable > 2 then 'negative' else 'unknown' end as label from f""")
def ml1_panel_rows(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("date").alias("day"))
    cuts = e.select("user_id").distinct().withColumn("cutoff", F.explode(F.array(F.lit("2024-01-12").cast("date"), F.lit("2024-01-20").cast("date"))))
    near = J.windowed_pairs(cuts, e, ["user_id"], "cutoff", "day", -10, 7, 16)
    after = F.datediff("day", "cutoff")
    f = near.groupBy("user_id", "cutoff").agg(F.count_if(after <= 0).alias("usable"), F.count_if((after > 0) & (F.col("event_type") == "purchase")).alias("future"))
    x = cuts.join(f, ["user_id", "cutoff"], "left").na.fill(0, ["usable", "future"])
    return x.select("user_id", "cutoff", "usable", (F.col("future") > 0).alias("positive"), F.when(F.col("future") > 0, "positive").when(F.col("usable") > 2, "negative").otherwise("unknown").alias("label"))


@query("""select c_custkey, round(0.4 * len(list_intersect(a, b)) / len(list_distinct(a || b)) + 0.6 * least(c_acctbal / 10000, 1), 6) as score from (select *, list_distinct(string_split(lower(c_mktsegment), '')) as a, list_distinct(string_split('household', '')) as b from customer)""")
def ml9_float_score(spark, d):
    grams = T.char_grams(F.lower("c_mktsegment"), 1)
    want = F.array(*[F.lit(c) for c in dict.fromkeys("household")])
    return table(spark, d, "customer").select("c_custkey", F.round(0.4 * T.jaccard(grams, want) + 0.6 * F.least(F.col("c_acctbal") / 10000, F.lit(1.0)), 6).alias("score"))


@query("""select c_custkey, last_day(m)::date as cutoff, substr(sha256(c_custkey::varchar || '|' || strftime(last_day(m), '%Y-%m-%d')), 1, 16) as task from customer cross join (select unnest([date '2024-01-01', date '2024-02-01', date '2024-03-01', date '2024-04-01']) as m) where c_acctbal > 5000""")
def ml12_backfill_tasks(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey", F.explode(D.cutoffs_before(F.lit("2024-05-01").cast("date"), 4)).alias("cutoff"))
    return c.select("c_custkey", "cutoff", F.substring(F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), F.col("cutoff").cast("string")), 256), 1, 16).alias("task"))
