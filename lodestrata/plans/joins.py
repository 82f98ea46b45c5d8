"""Queries on filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import policy as O
from lodestrata.operators import ranges as J
from lodestrata.operators import rows as R
from lodestrata.operators import similar as N

from .catalog import query, table


@query("""select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice >= 400000 and o_orderdate >= timestamp '1998-01-01' order by o_totalprice desc, o_orderkey limit 50""")
def flt1_dynamic_conjunction(spark, d):
    from functools import reduce

    wanted = {"o_orderstatus": ("=", "F"), "o_totalprice": (">=", 400000.0), "o_orderdate": (">=", "1998-01-01")}
    tests = {"=": lambda c, v: c == v, ">=": lambda c, v: c >= F.lit(v)}
    o = table(spark, d, "orders")
    value = lambda c, v: F.lit(v).cast("timestamp_ntz") if c == "o_orderdate" else v
    held = reduce(lambda x, y: x & y, [tests[op](F.col(c), value(c, v)) for c, (op, v) in wanted.items()])
    return o.where(held).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("""select event_id from events where ts < timestamp '2024-01-20' and event_type in ('view', 'purchase', 'signup') and value is not null and props <> '' and not regexp_matches(props, '"k": 9') and (event_type <> 'view' or value > 1)""")
def flt2_evidence_before_cutoff(spark, d):
    e = table(spark, d, "events")
    return e.where(J.when_all(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"), F.col("event_type").isin("view", "purchase", "signup"), F.col("value").isNotNull(), F.col("props") != "", ~F.col("props").rlike('"k": 9'), (F.col("event_type") != "view") | (F.col("value") > 1))).select("event_id")


@query("""with a as (select event_id, event_type, date_diff('day', ts::date, date '2024-01-28') as age from events)
select event_id, case when age <= 7 then 'recent' else 'prior' end as bucket from a where event_type <> 'error' and age between 0 and 20""")
def flt3_timeline_records(spark, d):
    age = F.datediff(F.lit("2024-01-28").cast("date"), F.col("ts").cast("date"))
    e = table(spark, d, "events").where((F.col("event_type") != "error") & age.between(0, 20))
    return e.select("event_id", F.when(age <= 7, "recent").otherwise("prior").alias("bucket"))


@query("""select user_id, count(*) filter (where event_type <> 'signup') as upstream, count(*) filter (where event_type = 'signup' and value > 50) as ads from events group by 1 having count(*) filter (where event_type <> 'signup') > 0""")
def flt4_partition_rows(spark, d):
    e = table(spark, d, "events").groupBy("user_id")
    out = e.agg(F.count_if(F.col("event_type") != "signup").alias("upstream"), F.count_if((F.col("event_type") == "signup") & (F.col("value") > 50)).alias("ads"))
    return out.where("upstream > 0")


@query("""with s as (select distinct lower(regexp_replace(s_name, '[\\s._#-]+', '', 'g')) as k from supplier where s_acctbal > 9000)
select c_custkey from customer where lower(regexp_replace(replace(c_name, 'Customer', 'Supplier'), '[\\s._#-]+', '', 'g')) not in (select k from s)""".replace("\\\\", "\\"))
def flt5_suppression(spark, d):
    normal = lambda c: F.lower(F.regexp_replace(c, r"[\s._#-]+", ""))
    blocked = table(spark, d, "supplier").where("s_acctbal > 9000").select(normal(F.col("s_name")).alias("k")).distinct()
    names = table(spark, d, "customer").withColumn("k", normal(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))))
    return names.join(blocked, "k", "left_anti").select("c_custkey")


@query("""select user_id, bool_or(regexp_matches(props, '"k": (1|2)[0-9]')) as relevant from events group by 1""")
def flt6_group_relevance(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("props").rlike('"k": (1|2)[0-9]')).alias("relevant"))


@query("""select p_partkey, case when p_name like '%widget%' then 'core' when p_name like '%bolt%' or p_name like '%ring%' then 'parts' when p_type = 'PROMO' then 'sales' else 'other' end as layer from part""")
def flt7_first_match_layer(spark, d):
    n = F.col("p_name")
    layer = F.when(n.contains("widget"), "core").when(n.rlike("bolt|ring"), "parts").when(F.col("p_type") == "PROMO", "sales").otherwise("other")
    return table(spark, d, "part").select("p_partkey", layer.alias("layer"))


@query("""select doc_id from documents where (text like '%tion%' or text like '%heit%') and (text like '%the %' or text like '%der %')""")
def flt8_document_relevance(spark, d):
    found = lambda *terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains("text", t))
    return table(spark, d, "documents").where(found("tion", "heit") & found("the ", "der ")).select("doc_id")


@query("""with k as (select user_id, list_distinct(list(event_type)) as kinds from events where value > 95 group by 1) select user_id from k where list_has_any(kinds, ['purchase', 'signup'])""")
def flt9_tag_overlap(spark, d):
    k = table(spark, d, "events").where("value > 95").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return k.where(F.arrays_overlap("kinds", F.array(F.lit("purchase"), F.lit("signup")))).select("user_id")


@query("""select p_partkey from part where length(p_name) between 6 and 9 and regexp_matches(p_name, '^(hot|old|red|blue)') and not regexp_matches(p_name, '(nut|pin)$')""")
def flt11_title_rule(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").where(F.length(n).between(6, 9) & n.rlike("^(hot|old|red|blue)") & ~n.rlike("(nut|pin)$")).select("p_partkey")


@query("""select o_orderkey, list_filter(['status', 'price', 'priority'], lambda x: (x = 'status' and o_orderstatus <> 'F') or (x = 'price' and o_totalprice < 200000) or (x = 'priority' and o_orderpriority > '3'))::varchar as violations from orders""")
def flt13_violations(spark, d):
    from pyspark.sql import Column

    def when(name: str, bad: Column) -> Column:
        return F.when(bad, F.lit(name))

    v = F.array_compact(F.array(when("status", F.col("o_orderstatus") != "F"), when("price", F.col("o_totalprice") < 200000), when("priority", F.col("o_orderpriority") > "3")))
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("["), F.array_join(v, ", "), F.lit("]")).alias("violations"))


@query("""with x as (select c_custkey, c_custkey % 3 as t, c_custkey % 4 as s from customer)
select c_custkey, case t when 0 then ['Acme grows', 'Acme grows ACME hires! Beta sells。', 'Acme grows Beta sells。acme wins', 'Acme grows nobody'][(s + 1)::int]
  when 1 then ['', 'ACME hires!', 'acme wins', ''][(s + 1)::int] else '' end as told from x""")
def flt16_attributable_context(spark, d):
    k = F.col("c_custkey")
    title = F.when(k % 3 == 0, "Acme grows").when(k % 3 == 1, "A day").otherwise("Beta grows")
    snippet = F.when(k % 4 == 1, "ACME hires! Beta sells。").when(k % 4 == 2, "Beta sells。acme wins").when(k % 4 == 3, "nobody").otherwise("")
    titled = F.when(k % 3 == 2, F.array(F.lit("Beta"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "customer").select("c_custkey", O.attributable(F.lit("Acme"), title, snippet, titled).alias("told"))


@query("""select c_custkey, replace(replace(c_name || ' of ' || c_mktsegment, c_mktsegment, '***'), 'Customer', '***') as safe from customer""")
def flt18_scrubbed(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", T.scrubbed(F.concat("c_name", F.lit(" of "), "c_mktsegment"), F.array(F.lit("Customer"), F.col("c_mktsegment"))).alias("safe"))


@query("""with l as (select * from (values ('view', 3), ('click', 7), ('purchase', 20)) t(event_type, max_age)),
x as (select user_id, event_type, max(ts)::date as last from events group by 1, 2)
select user_id, event_type, case when max_age is null then 'unknown' when date_diff('day', last, date '2024-02-02') <= max_age then 'fresh' else 'stale' end as freshness from x left join l using (event_type)""")
def flt20_freshness(spark, d):
    limits = spark.createDataFrame([("view", 3), ("click", 7), ("purchase", 20)], "event_type string, max_age int")
    x = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").cast("date").alias("last"))
    age = F.datediff(F.lit("2024-02-02").cast("date"), F.col("last"))
    state = F.when(F.col("max_age").isNull(), "unknown").when(age <= F.col("max_age"), "fresh").otherwise("stale")
    return x.join(F.broadcast(limits), "event_type", "left").select("user_id", "event_type", state.alias("freshness"))


@query("""select (count(*) = count(distinct doc_id)) as ids_unique, (count(*) filter (where text is null) = 0) as texts_present, (count(distinct lang) between 2 and 10) as languages_ok, (count(*) >= 200) as enough from documents""")
def flt23_readiness_gates(spark, d):
    return table(spark, d, "documents").agg((F.count("*") == F.countDistinct("doc_id")).alias("ids_unique"), (F.count_if(F.col("text").isNull()) == 0).alias("texts_present"), F.countDistinct("lang").between(2, 10).alias("languages_ok"), (F.count("*") >= 200).alias("enough"))


@query("""select user_id, coalesce(sum(value) filter (where event_type in ('view', 'click')), 0) > 0 as has_portable, count(distinct event_type) filter (where event_type in ('view', 'click')) as portable from events group by 1""")
def flt24_feature_projection(spark, d):
    sums = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    m = sums.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    kept = F.map_filter("m", lambda k, v: k.isin("view", "click"))
    return m.select("user_id", (F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, v: a + v) > 0).alias("has_portable"), F.size(kept).cast("long").alias("portable"))


@query("select l_orderkey, l_linenumber, o_custkey, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 45")
def join1_inner(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 45")
    return li.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "o_orderstatus")


@query("select distinct o_orderkey, o_custkey from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R' and l_quantity > 40")
def join2_semi(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 40")
    o = table(spark, d, "orders")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_semi").select("o_orderkey", "o_custkey")


@query("select distinct n.n_nationkey from nation n left join supplier s on s.s_nationkey = n.n_nationkey where n.n_name = 'NATION_3' or s.s_name = 'Supplier#000000007' or s.s_acctbal > 9500")
def join3_name_or_alias(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    by_alias = s.where("s_name = 'Supplier#000000007' or s_acctbal > 9500").select(F.col("s_nationkey").alias("n_nationkey"))
    return n.where("n_name = 'NATION_3'").select("n_nationkey").union(n.join(by_alias, "n_nationkey", "left_semi").select("n_nationkey")).distinct()


@query("select o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')")
def join4_anti(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_anti").select("o_orderkey")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_totalprice > 450000)")
def join5_exists(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'P' and o_totalprice > 450000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query("select c_custkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 490000 where o_orderkey is null")
def join6_left_null(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 490000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 48)")
def join7_not_exists(spark, d):
    p, li = table(spark, d, "part"), table(spark, d, "lineitem").where("l_quantity > 48")
    return p.join(li, p["p_partkey"] == li["l_partkey"], "left_anti").select("p_partkey")


@query("""select c.c_custkey, o.o_orderkey, l.l_linenumber, p.p_brand from customer c join orders o on c.c_custkey = o.o_custkey join lineitem l on l.l_orderkey = o.o_orderkey join part p on p.p_partkey = l.l_partkey where c.c_acctbal > 9000 and l.l_quantity > 40""")
def join8_chain(spark, d):
    c, o = table(spark, d, "customer").where("c_acctbal > 9000"), table(spark, d, "orders")
    li, p = table(spark, d, "lineitem").where("l_quantity > 40"), table(spark, d, "part")
    out = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("c_custkey") == F.col("o_custkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    return out.select("c_custkey", "o_orderkey", "l_linenumber", "p_brand")


@query("select l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey where l_shipdate > o_orderdate and l_shipdate <= o_orderdate + interval 30 day")
def join9_date_range(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    days = F.datediff("l_shipdate", "o_orderdate")
    return li.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & days.between(1, 30)).select("l_orderkey", "l_linenumber")


@query("select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def join12_lookup(spark, d):
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("""select c.event_id as cut_id, e.event_id from events c join events e on c.user_id = e.user_id where c.event_type = 'signup' and c.value > 120 and e.event_type = 'purchase' and date_diff('day', c.ts::date, e.ts::date) between -5 and 0""")
def join13_look_back(spark, d):
    e = table(spark, d, "events")
    cuts = e.where("event_type = 'signup' and value > 120").select("user_id", F.col("event_id").alias("cut_id"), F.col("ts").cast("date").alias("cut_day"))
    facts = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").cast("date").alias("day"))
    return J.windowed_pairs(cuts, facts, ["user_id"], "cut_day", "day", -5, 0, 8).select("cut_id", "event_id")


@query("""select c.event_id as cut_id, count(e.event_id) as future from events c left join events e on c.user_id = e.user_id and e.event_type = 'purchase' and date_diff('day', c.ts::date, e.ts::date) between 1 and 7 where c.event_type = 'signup' and c.value > 120 group by 1""")
def join14_look_ahead(spark, d):
    e = table(spark, d, "events")
    cuts = e.where("event_type = 'signup' and value > 120").select("user_id", F.col("event_id").alias("cut_id"), F.col("ts").cast("date").alias("cut_day"))
    facts = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").cast("date").alias("day"))
    near = J.windowed_pairs(cuts, facts, ["user_id"], "cut_day", "day", 1, 7, 8).groupBy("cut_id").agg(F.count("*").alias("future"))
    return cuts.join(near, "cut_id", "left").select("cut_id", F.coalesce("future", F.lit(0)).alias("future"))


@query("""with v as (select user_id, min(ts)::date as a, max(ts)::date as b from events where event_type = 'view' group by 1),
p as (select user_id, min(ts)::date as s, max(ts)::date as e from events where event_type = 'purchase' group by 1)
select p.user_id, max(case when v.a <= p.s and v.b >= p.e then 2 when v.a <= p.e and v.b >= p.s then 1 else 0 end)::int as observability from p left join v using (user_id) group by 1""")
def join15_containment(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    v = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    p = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("day").alias("s"), F.max("day").alias("e"))
    level = F.when((F.col("a") <= F.col("s")) & (F.col("b") >= F.col("e")), 2).when((F.col("a") <= F.col("e")) & (F.col("b") >= F.col("s")), 1).otherwise(0)
    return p.join(v, "user_id", "left").groupBy("user_id").agg(F.max(level).alias("observability"))


@query("""with t as (select user_id, date '2024-01-10' as s, date '2024-01-17' as e from events group by 1),
o as (select user_id, min(ts)::date as a, max(ts)::date + 1 as b from events where event_type = 'purchase' and value > 20 group by user_id, date_trunc('week', ts))
select t.user_id, t.s, t.e, case when bool_or(coalesce(o.a >= t.s and o.b <= t.e, false)) then 'positive' when bool_or(coalesce(o.a < t.e and o.b > t.s, false)) then 'ambiguous' else 'none' end as label from t left join o using (user_id) group by 1, 2, 3""")
def join16_contain_or_overlap(spark, d):
    e = table(spark, d, "events")
    day = lambda x: F.lit(x).cast("date")
    t = e.select("user_id").distinct().select("user_id", day("2024-01-10").alias("s"), day("2024-01-17").alias("e"))
    o = e.where("event_type = 'purchase' and value > 20").groupBy("user_id", F.date_trunc("week", "ts").alias("w")).agg(F.min("ts").cast("date").alias("a"), F.date_add(F.max("ts").cast("date"), 1).alias("b"))
    return J.interval_label(t, o, ["user_id"], "s", "e", "a", "b")


@query("""with days as (select user_id, unnest(generate_series(date '2024-01-05', date '2024-01-12', interval 1 day))::date as day from (select distinct user_id from events)),
seen as (select distinct user_id, ts::date as day from events)
select d.user_id, count(*) = count(s.day) as covered, count(*) - count(s.day) as missing from days d left join seen s on d.user_id = s.user_id and d.day = s.day group by 1""")
def join17_full_coverage(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    t = e.select("user_id").distinct().select("user_id", F.lit("2024-01-05").cast("date").alias("s"), F.lit("2024-01-12").cast("date").alias("e"))
    return J.covered(t, e.select("user_id", F.col("day").alias("a"), F.col("day").alias("b")), ["user_id"], "s", "e", "a", "b").select("user_id", "covered", "missing")


@query()
def join18_cluster_events(spark, d):
    return J.cluster_events(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 2.0).select("user_id", "event_type", "event_id", "event", F.floor("occurred").alias("occurred"))


@query("""select u.user_id, cutoff::date as cutoff, k.kind, count(e.event_id) as n from (select distinct user_id from events) u cross join (select unnest([date '2024-01-10', date '2024-01-20', date '2024-01-30']) as cutoff) cross join (select unnest(['view', 'purchase']) as kind) k left join events e on e.user_id = u.user_id and e.event_type = k.kind and e.ts::date <= cutoff group by all""")
def join19_panel_skeleton(spark, d):
    e = table(spark, d, "events").where("event_type in ('view', 'purchase')")
    cut = F.array(*[F.lit(x).cast("date") for x in ("2024-01-10", "2024-01-20", "2024-01-30")])
    cells = table(spark, d, "events").select("user_id").distinct().withColumn("cutoff", F.explode(cut)).withColumn("kind", F.explode(F.array(F.lit("view"), F.lit("purchase"))))
    # A row counts at every cutoff on or after its day: summed by key, with no range join.
    hits = e.select("user_id", F.col("event_type").alias("kind"), F.explode(F.filter(cut, lambda c: F.col("ts").cast("date") <= c)).alias("cutoff")).groupBy("user_id", "kind", "cutoff").agg(F.count("*").alias("n"))
    return cells.join(hits, ["user_id", "cutoff", "kind"], "left").select("user_id", "cutoff", "kind", F.coalesce("n", F.lit(0)).alias("n"))


@query()
def join20_bipartite_matching(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") % 50).alias("l"), (F.col("l_partkey") % 40).alias("r")).where("l != r").distinct()
    return J.matching(li.where("(l * 7 + r) % 9 = 0"), "g", "l", "r")


@query()
def join21_near_duplicates(spark, d):
    return _alike(table(spark, d, "documents").select("doc_id", "text", F.lit("").alias("opening")))


def _alike(docs):
    """Pairs of texts alike in lower case without white space, between those of one opening."""
    x = F.lower(F.regexp_replace("text", r"\s+", "")).alias("x")
    pairs = N.similar_texts(docs.select("doc_id", x, "opening"), "doc_id", "x", "opening", 0.85, 7, (0.75, 1.34))
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query()
def join22_blocked_prefix(spark, d):
    # Signatures hold the block, so a common opening alone never meets itself.
    return _alike(table(spark, d, "documents").select("doc_id", "text", F.substring("text", 1, 20).alias("opening")))


@query("""with k as (select p_brand as entity, lower(p_name || ' ' || p_size) as alias from part group by 1, 2), u as (select alias, min(entity) as entity from k group by 1 having count(distinct entity) = 1)
select distinct upper(p_name || ' ' || p_size) as name, entity from part join u on lower(p_name || ' ' || p_size) = u.alias""")
def join23_unique_alias(spark, d):
    p = table(spark, d, "part").withColumn("label", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")))
    entities = p.groupBy(F.col("p_brand").alias("entity")).agg(F.collect_set("label").alias("aliases"))
    names = p.select(F.upper("label").alias("name")).distinct()
    return J.alias_matches(names, entities, "name", "entity", "aliases", lambda c: F.lower(c))


@query("""select a.l_orderkey, a.l_linenumber, count(*) as scopes from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_quantity >= b.l_quantity and a.l_quantity < b.l_quantity + 10 group by all""")
def join24_stabbing(spark, d):
    li = table(spark, d, "lineitem")
    points = li.select("l_orderkey", "l_linenumber", "l_quantity")
    scopes = li.select("l_orderkey", F.col("l_quantity").alias("lo"), (F.col("l_quantity") + 10).alias("hi"))
    return J.stabbing(points, scopes, ["l_orderkey"], "l_quantity", "lo", "hi").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("scopes"))


@query("select s.s_suppkey, c.c_custkey from supplier s join customer c on lower(regexp_replace(s_name, '^[a-z]+#', '', 'i')) = lower(regexp_replace(c_name, '^[a-z]+#', '', 'i'))")
def join25_normalised_equality(spark, d):
    key = lambda c: F.lower(F.regexp_replace(c, "(?i)^[a-z]+#", ""))
    s, c = table(spark, d, "supplier").select("s_suppkey", key(F.col("s_name")).alias("k")), table(spark, d, "customer").select("c_custkey", key(F.col("c_name")).alias("k"))
    return s.join(c, "k").select("s_suppkey", "c_custkey")


@query("select p_partkey, t.topic from part cross join (values ('widget'), ('bolt'), ('blue gear')) t(topic) where contains(p_name, topic) or contains(topic, p_name)")
def join26_containment(spark, d):
    topics = ("widget", "bolt", "blue gear")  # a fixed list: an array in each row, no join
    n = F.col("p_name")
    hit = F.filter(F.array(*[F.lit(t) for t in topics]), lambda t: F.contains(n, t) | F.contains(t, n))
    return table(spark, d, "part").select("p_partkey", F.explode(hit).alias("topic"))


@query("""select 'customer' as kind, c_custkey as node from customer where c_custkey in (select o_custkey from orders where o_totalprice > 480000) union all select 'nation', n_nationkey from nation where n_nationkey in (select c_nationkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 480000))""")
def join27_referenced_nodes(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    ends = table(spark, d, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey"))
    people = c.join(ends, "c_custkey", "left_semi")
    places = n.join(people.select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    return people.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("node")).unionByName(places.select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("node")))


@query("select count(*) filter (where d.doc_id is null) as only_labels, count(*) filter (where l.doc_id is null) as only_docs, count(*) filter (where d.doc_id = l.doc_id) as both_sides from documents d full join labels l on d.doc_id = l.doc_id")
def join28_key_sets(spark, d):
    a, b = table(spark, d, "documents").select(F.col("doc_id").alias("a")), table(spark, d, "labels").select(F.col("doc_id").alias("b"))
    j = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return j.agg(F.count_if(F.col("a").isNull()).alias("only_labels"), F.count_if(F.col("b").isNull()).alias("only_docs"), F.count_if(F.col("a") == F.col("b")).alias("both_sides"))


@query("""select p.event_id, s.last_value from (select * from events where event_type = 'purchase') p asof left join (select user_id, ts, arg_max(value, event_id) as last_value from events where event_type = 'signup' group by all) s on p.user_id = s.user_id and p.ts >= s.ts""")
def join13b_as_of(spark, d):
    e = table(spark, d, "events")
    right = R.latest_per_key(e.where("event_type = 'signup'").select("user_id", "ts", "event_id", F.col("value").alias("last_value")), ["user_id", "ts"], ["event_id"]).drop("event_id")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return J.as_of_join(left, right, ["user_id"], "ts", "ts", ["last_value"]).select("event_id", "last_value")
