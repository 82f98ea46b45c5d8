"""Queries on ledgers, registries, selections and the remaining scalar rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import maps as M
from lodestrata.functions import rules as U
from lodestrata.functions import text as T
from lodestrata.functions import time as D
from lodestrata.operators import graph as G
from lodestrata.operators import policy as O
from lodestrata.operators import ranges as J
from lodestrata.operators import records as E
from lodestrata.operators import rows as R
from lodestrata.operators import scoring as S
from lodestrata.operators import state as Z

from .catalog import query, table


def _c(*names):
    return [F.col(n) for n in names]


@query("""with o as (select c_mktsegment as k, min(c_acctbal) as lo from customer where c_nationkey < 12 group by 1), n as (select c_mktsegment as k, max(c_acctbal) as hi from customer where c_nationkey >= 12 group by 1)
select coalesce(o.k, n.k) as k, lo, hi from o full join n on o.k = n.k""")
def snk2_add_missing_attributes(spark, d):
    c = table(spark, d, "customer")
    m = lambda name, v: F.create_map(F.lit(name), v)
    old = c.where("c_nationkey < 12").groupBy(F.col("c_mktsegment").alias("k")).agg(m("lo", F.min("c_acctbal")).alias("attrs"))
    new = c.where("c_nationkey >= 12").groupBy(F.col("c_mktsegment").alias("k")).agg(F.map_concat(m("lo", F.lit(0.0)), m("hi", F.max("c_acctbal"))).alias("attrs"))
    out = R.upsert(old, new, ["k"], {"attrs": "union"})
    return out.select("k", F.try_element_at("attrs", F.lit("lo")).alias("lo"), F.try_element_at("attrs", F.lit("hi")).alias("hi"))


@query("select p_brand as entity, lower(p_name) as alias, min(p_partkey) as first from part group by 1, 2")
def snk3_insert_alias(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("entity"), F.lower("p_name").alias("alias"), F.col("p_partkey").alias("first"))
    stored = R.best_per_key(p.where("first < 500"), ["entity", "alias"], _c("first"))
    return R.insert_absent(stored, p, ["entity", "alias"], _c("first"))


@query("""select 'stmt_' || substr(sha256(user_id::varchar || chr(31) || event_type || chr(31) || ts::date::varchar), 1, 32) as id, min(event_id) as event_id from events group by 1""")
def snk4_insert_statement(spark, d):
    e = table(spark, d, "events").select(T.stable_id("stmt", F.col("user_id"), F.col("event_type"), F.col("ts").cast("date")).alias("id"), "event_id")
    old = R.best_per_key(e.where("event_id % 2 = 0"), ["id"], _c("event_id"))
    return R.best_per_key(R.insert_absent(old, e, ["id"], _c("event_id")).unionByName(e), ["id"], _c("event_id"))


@query("""select l_partkey, count(distinct l_suppkey) as sources, max(l_shipdate)::date as last from lineitem group by 1""")
def snk5_link_and_refresh(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    stored, new = li.where("l_linenumber < 3").distinct(), li.distinct()
    links = stored.unionByName(new.join(stored, li.columns, "left_anti"))
    return links.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("sources"), F.max("l_shipdate").cast("date").alias("last"))


@query("""select s_suppkey, case when s_suppkey % 3 = 0 or s_suppkey % 5 = 1 then 'old-' || s_suppkey else 'new-' || s_suppkey end as etag from supplier""")
def snk6_keep_when_empty(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    old = s.select("s_suppkey", F.concat(F.lit("old-"), k).alias("etag"))
    new = s.where("s_suppkey % 5 != 1").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("new-"), k)).alias("etag"))
    return R.upsert(old, new, ["s_suppkey"], {"etag": "fill"})


@query("""select user_id, event_type, ts::date as day, (event_id % 3)::bigint as source, min(epoch_us(ts)) as first_us, max(epoch_us(ts)) as last_us, max(value) as best from events group by all""")
def snk8_evidence_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"), (F.col("event_id") % 3).alias("source"), D.micros(F.col("ts")).alias("us"), "value", "event_id")
    state = lambda x: x.groupBy("user_id", "event_type", "day", "source").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max("value").alias("best"))
    return R.upsert(state(e.where("event_id % 2 = 0")), state(e.where("event_id % 2 = 1")), ["user_id", "event_type", "day", "source"], {"first_us": "min", "last_us": "max", "best": "max"})


@query("""select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{8,}'))) as alias from documents where lang = 'en' and doc_id % 2 = 1 union all select doc_id, 'kept' from documents where doc_id % 2 = 0""")
def snk11_replace_article_events(spark, d):
    docs = table(spark, d, "documents")
    old = docs.select("doc_id", F.lit("kept").alias("alias"))
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{8,}"), F.lit(0)))
    new = docs.where("lang = 'en' and doc_id % 2 = 1").select("doc_id", F.explode(names).alias("alias"))
    touched = docs.where("doc_id % 2 = 1").select("doc_id")
    return old.join(touched, "doc_id", "left_anti").unionByName(new)


@query("select event_type as source, max(epoch_us(ts)) as cursor from events group by 1")
def snk13_cursors(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), D.micros(F.col("ts")).alias("cursor"), "event_id")
    state = lambda x: x.groupBy("source").agg(F.max("cursor").alias("cursor"))
    return R.upsert(state(e.where("event_id % 4 = 0")), state(e.where("event_id % 4 != 0")), ["source"], {"cursor": "max"})


@query("select ts::date as run, event_type, count(*) as items, count(*) filter (where value > 100) as kept from events group by 1, 2")
def snk14_run_log(spark, d):
    return table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("run"), "event_type").agg(F.count("*").alias("items"), F.count_if(F.col("value") > 100).alias("kept"))


@query("""select substr(sha256(lower(replace(c_name || ' ' || c_mktsegment, ' ', ''))), 1, 24) as company_id, c_name || ' ' || c_mktsegment as company, 'x' as direction, c_nationkey as score, 'CTO、COO' as roles,
  '[{"项":"a","分":' || c_nationkey || ',"原因":"' || c_mktsegment || '"}]' as components, 'https://a.example/' || c_custkey || chr(10) || 'https://b.example/' as links, '{"seg":"' || c_mktsegment || '"}' as research, '待研究' as status from customer""")
def snk16_lead_projection(spark, d):
    some = lambda *x: F.array(*[F.lit(v) for v in x])
    company = F.concat("c_name", F.lit(" "), "c_mktsegment")
    parts = F.array(F.struct(F.lit("a").alias("label"), F.col("c_nationkey").alias("points"), F.col("c_mktsegment").alias("reason")))
    links = F.array(F.concat(F.lit("https://a.example/"), F.col("c_custkey").cast("string")), F.lit("https://b.example/"))
    plain = {c: F.lit(c) for c in ("mode", "grade", "timing", "thesis")}
    leads = table(spark, d, "customer").select(company.alias("company"), F.lit("x").alias("direction"), F.col("c_nationkey").alias("score"), some("CTO", "COO").alias("roles"), parts.alias("components"), links.alias("links"), F.create_map(F.lit("seg"), "c_mktsegment").alias("research"), *[v.alias(k) for k, v in plain.items()])
    return E.board_rows(leads).drop("mode", "grade", "timing", "thesis")


@query("select event_id, list_filter(['kind', 'value', 'props'], lambda x: (x = 'kind' and event_type = 'error') or (x = 'value' and value > 200) or (x = 'props' and length(props) < 9))::varchar as violations from events where event_type = 'error' or value > 200 or length(props) < 9")
def snk21_audit_validation(spark, d):
    bad = F.array_compact(F.array(F.when(F.col("event_type") == "error", "kind"), F.when(F.col("value") > 200, "value"), F.when(F.length("props") < 9, "props")))
    return table(spark, d, "events").select("event_id", bad.alias("b")).where(F.size("b") > 0).select("event_id", F.concat(F.lit("["), F.array_join("b", ", "), F.lit("]")).alias("violations"))


@query("select 'customer' as a_kind, c_custkey as a, case when c_acctbal > 5000 then 'invests' else 'works' end as relation, c_nationkey::bigint as b from customer union all select 'nation', n_nationkey, 'in', n_regionkey from nation")
def snk24_relationship_edges(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    works = c.select(F.lit("customer").alias("a_kind"), F.col("c_custkey").alias("a"), F.when(F.col("c_acctbal") > 5000, "invests").otherwise("works").alias("relation"), F.col("c_nationkey").cast("long").alias("b"))
    return works.unionByName(n.select(F.lit("nation").alias("a_kind"), F.col("n_nationkey").cast("long").alias("a"), F.lit("in").alias("relation"), F.col("n_regionkey").cast("long").alias("b")))


@query("""with l as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as i, o_orderstatus as company, o_orderpriority as role from orders),
r as (select l.*, c_mktsegment as title from l join customer on c_custkey = o_custkey where company <> 'P'),
x as (select o_custkey, company, i, o_orderkey, unnest(case when i % 3 = 0 then [title] when i % 3 = 1 then [role] else [role, 'second'] end) as role from r)
select o_custkey as draft, company, role, arg_max(o_orderkey, i)::varchar as urls from x group by 1, 2, 3""")
def snk26_opportunity_links(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("title"))
    drafts = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("rows")).join(c, "o_custkey")

    def lead(x, i):
        roles = F.when((i + 1) % 3 == 0, F.array(F.lit(" "))).when((i + 1) % 3 == 1, F.array(x["o_orderpriority"])).otherwise(F.array(x["o_orderpriority"], F.lit(" second ")))
        return F.struct(F.when(x["o_orderstatus"] != "P", F.concat(F.lit(" "), x["o_orderstatus"])).otherwise("").alias("company"), roles.alias("roles"), F.array(x["o_orderkey"].cast("string")).alias("urls"))

    links = E.opportunity_links(drafts.select(F.col("o_custkey").alias("draft"), "title", F.transform("rows", lead).alias("leads")), "draft", "title", "leads")
    return links.select("draft", "company", "role", F.array_join("urls", ",").alias("urls"))


@query("select l_orderkey || '/' || l_linenumber || '/' || l_partkey as new_key, l_quantity from lineitem")
def snk27_key_migration(spark, d):
    return table(spark, d, "lineitem").select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("new_key"), "l_quantity")


@query("select sha256(text) as digest, min(doc_id) as first, count(*) as captures from documents group by 1")
def snk28_raw_capture(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first"), F.count("*").alias("captures"))


@query("select e.event_id from events e where (e.user_id % 4 = 0 and e.event_type in ('view', 'click')) or (e.user_id % 4 = 1 and e.event_type = 'purchase')")
def flt10_supported_signals(spark, d):
    allowed = spark.createDataFrame([(0, ["view", "click"]), (1, ["purchase"])], "slot long, kinds array<string>")
    e = table(spark, d, "events").withColumn("slot", F.col("user_id") % 4)
    return e.join(F.broadcast(allowed), "slot").where(F.array_contains("kinds", F.col("event_type"))).select("event_id")


@query("select o_orderkey from orders where o_custkey is not null and o_orderstatus <> '' and o_orderpriority <> '' and o_totalprice > 100000 and year(o_orderdate) between 1996 and 2000 and o_orderkey in (select l_orderkey from lineitem)")
def flt12_strict_rows(spark, d):
    o = table(spark, d, "orders")
    filled = J.when_all(*[F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in ("o_custkey", "o_orderstatus", "o_orderpriority")])
    strict = o.where(filled & (F.col("o_totalprice") > 100000) & F.year("o_orderdate").between(1996, 2000))
    return strict.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("select p_partkey from part where p_name = 'new pin' or (length(p_name) between 5 and 30 and p_name not in ('red gear', 'old bolt') and not contains(p_name, 'nut') and not contains(p_name, 'pin') and regexp_matches(p_name, '(gear|bolt|rod|ring|widget)$'))")
def flt14_plausible_company(spark, d):
    fits = O.plausible_name(F.col("p_name"), ("new pin",), ("red gear", "old bolt"), ("nut", "pin"), "GEAR|bolt|rod|ring|widget", (5, 30))
    return table(spark, d, "part").where(fits).select("p_partkey")


@query("""with x as (select c_custkey, c_custkey % 3 as t, c_custkey % 4 as s, c_custkey % 2 as other from customer)
select c_custkey, case t when 0 then case s when 0 then 'Acme grows ' when 1 then 'Acme grows ACME hires! Beta sells.' when 2 then 'Acme grows Beta sells. acme wins' else 'Acme grows nobody' end
  when 1 then case s when 1 then 'ACME hires!' when 2 then 'Beta sells. acme wins' else '' end else '' end as told from x""")
def flt15_mention_context(spark, d):
    k = F.col("c_custkey")
    title = F.when(k % 3 == 0, "Acme grows").when(k % 3 == 1, "A day").otherwise("Beta grows")
    snippet = F.when(k % 4 == 1, "ACME hires! Beta sells.").when(k % 4 == 2, "Beta sells. acme wins").when(k % 4 == 3, "nobody").otherwise("")
    titled = F.when(k % 3 == 0, F.array(F.lit("Acme"))).when(k % 3 == 2, F.array(F.lit("Beta"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "customer").select("c_custkey", O.relevant_text(F.lit("Acme"), F.array(F.lit("Acme"), F.lit("acme inc")), title, snippet, titled).alias("told"))


@query("select o_orderkey from orders where o_orderstatus in ('O', 'P') and (contains(o_orderpriority, 'URGENT') or contains(o_orderpriority, 'HIGH')) order by o_totalprice desc, o_orderkey limit 30")
def flt17_opportunity_search(spark, d):
    terms = F.array(F.lit("URGENT"), F.lit("HIGH"))
    hit = F.exists(terms, lambda t: F.contains(F.col("o_orderpriority"), t))
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P") & hit).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey")


@query("""with s as (select s_suppkey, s_suppkey % 2 = 0 as granted, s_suppkey % 3 = 0 as robots, s_suppkey % 5 <> 0 as pub, ['open', 'licensed', 'restricted', 'unknown'][(s_suppkey % 4 + 1)::int] as licence, s_suppkey % 7 = 0 as api from supplier)
select s_suppkey, (pub or granted) and not (api and not granted) and robots and not (licence = 'restricted' and not granted) as allowed,
  concat_ws(',', case when not pub and not granted then 'source_not_public_or_authorized' end, case when api and not granted then 'authorization_required' end, case when not robots then 'robots_policy_disallows_collection' end,
    case when licence = 'restricted' and not granted then 'restricted_source_without_permission' end, 'private_contact_fields_excluded', 'unapproved_fields_excluded', case when licence not in ('open', 'licensed') then 'full_text_retention_downgraded' end, 'retention_period_capped') as reasons,
  'url,public_note' as collect, 'phone,salary' as excluded, case when licence in ('open', 'licensed') then 90 else 0 end as days from s""")
def flt19_collection_policy(spark, d):
    k = F.col("s_suppkey")
    yes, named = F.lit(True), lambda *x: F.array(*[F.lit(v) for v in x])
    licence = F.element_at(named("open", "licensed", "restricted", "unknown"), (k % 4 + 1).cast("int"))
    source = F.struct(F.lit(False).alias("bypass"), (k % 5 != 0).alias("public"), (k % 2 == 0).alias("authorized"), F.when(k % 7 == 0, "official_api").otherwise("public_web").alias("basis"), (k % 3 == 0).alias("robots"), yes.alias("terms"), licence.alias("licence"), yes.alias("full_text"), F.lit(90).alias("max_days"))
    wanted = F.struct(named("url", "phone", "salary", "public_note", "url").alias("fields"), yes.alias("full_text"), F.lit(180).alias("days"))
    rows = table(spark, d, "supplier").select("s_suppkey", source.alias("s"), wanted.alias("w")).select("s_suppkey", O.collection_decision(F.col("s"), F.col("w")).alias("d"))
    return rows.select("s_suppkey", "d.allowed", *[F.array_join(f"d.{c}", ",").alias(c) for c in ("reasons", "collect", "excluded")], "d.days")


@query("""select conv_id, string_agg(distinct code, ',' order by code) as codes from (select conv_id, unnest(list_filter(['empty', 'long', 'role'], lambda c: (c = 'empty' and length(coalesce(text, '')) = 0) or (c = 'long' and length(text) > 400) or (c = 'role' and role = 'system' and turn > 0))) as code from conversations) group by 1""")
def flt22_error_codes(spark, d):
    codes = F.array_compact(F.array(F.when(F.length(F.coalesce("text", F.lit(""))) == 0, "empty"), F.when(F.length("text") > 400, "long"), F.when((F.col("role") == "system") & (F.col("turn") > 0), "role")))
    return table(spark, d, "conversations").select("conv_id", F.explode(codes).alias("code")).groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


@query("select c_custkey, c_name as company, null::varchar as website from customer")
def flt25_permissive_projection(spark, d):
    c = table(spark, d, "customer")
    wanted = {"c_custkey": "c_custkey", "company": "c_name", "website": "c_website"}
    return c.select(*[(F.col(src) if src in c.columns else F.lit(None).cast("string")).alias(out) for out, src in wanted.items()])


@query("select p_partkey, p_name like '%widget%' and p_size between 10 and 40 and p_retailprice > 950 as verified, case when p_type in ('ECONOMY', 'PROMO') then 'B' else 'A' end as grade from part")
def flt27_artifact_verification(spark, d):
    ok = F.col("p_name").contains("widget") & F.col("p_size").between(10, 40) & (F.col("p_retailprice") > 950)
    return table(spark, d, "part").select("p_partkey", ok.alias("verified"), F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "B").otherwise("A").alias("grade"))


@query("select distinct o_orderkey, o_orderpriority from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R' and l_tax > 0.07)")
def join11_open_letters(spark, d):
    bad = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_tax > 0.07").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(bad, "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("select count(distinct user_id) as companies, round(count(distinct case when event_type = 'purchase' then user_id end) / count(distinct user_id), 6) as coverage, count(distinct ts::date) = 30 as cutoffs_once from events")
def agg17_holdout_gates(spark, d):
    buyer = F.when(F.col("event_type") == "purchase", F.col("user_id"))
    return table(spark, d, "events").agg(F.countDistinct("user_id").alias("companies"), F.round(F.countDistinct(buyer) / F.countDistinct("user_id"), 6).alias("coverage"), (F.countDistinct(F.col("ts").cast("date")) == 30).alias("cutoffs_once"))


@query("select o_orderstatus, count(*) as n, count(distinct o_custkey) as companies, round(count(*) filter (where o_totalprice > 400000) / count(*), 6) as strong from orders group by 1")
def agg18_prediction_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("companies"), F.round(F.count_if(F.col("o_totalprice") > 400000) / F.count("*"), 6).alias("strong"))


@query("""with v as (select p_brand, p_name, count(*) as n from part group by 1, 2) select p_brand, arg_max(p_name, (p_name like '%widget', n, length(p_name), p_name)) as name from v group by 1""")
def agg21_alias_votes(spark, d):
    v = table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    return v.groupBy("p_brand").agg(F.max_by("p_name", F.struct(F.col("p_name").endswith("widget"), "n", F.length("p_name"), "p_name")).alias("name"))


@query("select event_id, coalesce(last_value(case when value > 150 then event_type end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 'none') as last_company from events")
def win11_previous_subject(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "events").select("event_id", F.coalesce(F.last(F.when(F.col("value") > 150, F.col("event_type")), ignorenulls=True).over(w), F.lit("none")).alias("last_company"))


@query("select o_orderkey, (o_orderdate::date - (o_orderkey % 9)::int * 7 - 6) as start_day, (o_orderdate::date - (o_orderkey % 9)::int * 7 + 1) as end_exclusive from orders")
def win16_publication_window(spark, d):
    base = F.date_sub(F.col("o_orderdate").cast("date"), ((F.col("o_orderkey") % 9) * 7).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.date_sub(base, 6).alias("start_day"), F.date_add(base, 1).alias("end_exclusive"))


@query("select s_suppkey from supplier order by s_acctbal desc, s_nationkey desc, s_suppkey limit 25")
def top5_reverse_sort(spark, d):
    return table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), F.desc("s_nationkey"), "s_suppkey").limit(25).select("s_suppkey")


@query("""with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, -o_totalprice, o_orderkey) as place from orders) select * from r where place <= 3""")
def top6_review_queue(spark, d):
    first = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return R.top_n(table(spark, d, "orders"), ["o_custkey"], [first, -F.col("o_totalprice"), F.col("o_orderkey")], 3, "place").select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("""with r as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by sha256('pool|' || c_custkey), c_custkey) as k from customer) select c_custkey, case when k <= 100 then 'train' when k <= 140 then 'test' else 'reserve' end as split from r""")
def top10_quota_split(spark, d):
    h = F.sha2(F.concat(F.lit("pool|"), F.col("c_custkey").cast("string")), 256)
    k = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(h, "c_custkey"))
    return table(spark, d, "customer").select("c_custkey", F.when(k <= 100, "train").when(k <= 140, "test").otherwise("reserve").alias("split"))


@query("select doc_id from documents order by sha256('frozen-v1|' || doc_id::varchar), doc_id limit 25")
def top14_frozen_shuffle(spark, d):
    return R.hash_sample(table(spark, d, "documents"), "doc_id", "frozen-v1", 25).select("doc_id")


@query("select l_orderkey, arg_min(l_linenumber, (-l_quantity, l_discount, l_linenumber, l_partkey)) as best from lineitem group by 1")
def top16_quality_tuple(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct(-F.col("l_quantity"), "l_discount", "l_linenumber", "l_partkey")).alias("best"))


@query("""with u as (select user_id, event_type, event_id, 1 as pos from events where value > 50 union all select user_id, event_type, event_id, 2 from events where value <= 50)
select user_id, event_type, arg_min(event_id, (pos, event_id)) as event_id from u group by 1, 2""")
def set3_merge_sources(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    u = e.where("value > 50").withColumn("pos", F.lit(1)).unionByName(e.where("value <= 50").withColumn("pos", F.lit(2)))
    return R.best_per_key(u.select("user_id", "event_type", "event_id", "pos"), ["user_id", "event_type"], _c("pos", "event_id")).select("user_id", "event_type", "event_id")


@query(r"select s_suppkey, trim(regexp_replace(lower(s_name), '[\t\n\v\f\r ]+', ' ', 'g')) as name, lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '', 'g')) as key from supplier")
def str4_other_normalizers(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.compact(F.lower("s_name")).alias("name"), F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]+", "")).alias("key"))


@query("select item_id, len(list_distinct(list_transform(generate_series(1, length(x) - 4), lambda i: substr(x, i, 5))))::int as shingles from (select item_id, replace(replace(text, ' ', ''), chr(10), '') as x from benchmark)")
def str12_shingles(spark, d):
    x = F.replace(F.replace("text", F.lit(" ")), F.lit("\n"))
    return table(spark, d, "benchmark").select("item_id", F.size(T.char_grams(x, 5)).alias("shingles"))


@query(r"""select p_partkey, case when p_partkey % 3 = 2 then 'kind' when contains(p_name, 'gear') or contains(p_name, 'widget') then 'kind' when contains(p_name, 'red') or contains(p_name, 'blue') then 'color' else 'other' end || ':' ||
  case p_partkey % 3 when 0 then regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || '量产' when 1 then regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') else '技术' end as role_key from part""")
def str17_role_key(spark, d):
    k, n = F.col("p_partkey") % 3, F.col("p_name")
    title = F.when(k == 0, F.concat(n, F.lit("批量化 总监"))).when(k == 1, F.concat(F.lit("高级 "), n, F.lit(" Director"))).otherwise("技术总监")
    about = F.when(k == 2, "a gear, red").otherwise("")
    return table(spark, d, "part").select("p_partkey", U.role_key(title, about, {"color": ("red", "blue"), "kind": ("gear", "widget")}).alias("role_key"))


@query("""select c_custkey, ['苏州', '上海', '上海', '上海', '上海', '呼和浩特', '上海', '和田'][(c_custkey % 8 + 1)::int] as city, c_custkey % 8 not in (0, 5, 7) as defaulted from customer""")
def str25_role_city(spark, d):
    said = F.array(*[F.lit(x) for x in (" 苏州 ", "", "苏州、无锡", "多地", "北京和上海", "呼和浩特", "北京或上海", "和田")])
    city = O.one_city(F.element_at(said, (F.col("c_custkey") % 8 + 1).cast("int")), F.lit("公告"))
    return table(spark, d, "customer").select("c_custkey", city.alias("c")).select("c_custkey", "c.city", (F.col("c.basis") != "公告").alias("defaulted"))


@query("""select c_custkey, ['foreign', 'listed', 'startup_private'][(c_custkey % 3 + 1)::int] as archetype,
  c_name || '在机器人方向出现多源上游信号：' || ['新增资本可支持组织扩张；量产/产能建设要求建立制造与交付管理体系；订单和客户交付会放大供应链、质量与项目管理压力', '海外扩张需要区域业务与交付负责人', '多个上游事件正在形成新的组织责任'][(c_custkey % 3 + 1)::int]
  || '。因此未来 30–90 天最可能新增或升级的领导岗位为：研发总监、产品总监。' as thesis from customer""")
def str26_thesis_text(spark, d):
    k = F.col("c_custkey") % 3
    some = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    context = F.when(k == 0, "A GLOBAL group, 科创板").when(k == 1, "Annual Report 2023").otherwise("a small team")
    kinds = F.when(k == 0, some("partnership", "major_order", "factory_or_capacity", "funding")).when(k == 1, some("global_expansion", "other")).otherwise(some())
    return table(spark, d, "customer").select("c_custkey", E.archetype(context).alias("archetype"), E.thesis(F.col("c_name"), F.lit("机器人"), kinds, some("研发总监", "产品总监")).alias("thesis"))


@query(r"select doc_id, regexp_extract(text, '\b([A-Z][a-z]+) (?:de|of|der) ([a-z]+)', 1) as who, regexp_extract(text, '\b([A-Z][a-z]+) (?:de|of|der) ([a-z]+)', 2) as via from documents where regexp_matches(text, '\b([A-Z][a-z]+) (?:de|of|der) ([a-z]+)')")
def str27_route_inference(spark, d):
    p = r"\b([A-Z][a-z]+) (?:de|of|der) ([a-z]+)"
    return table(spark, d, "documents").where(F.col("text").rlike(p)).select("doc_id", F.regexp_extract("text", p, 1).alias("who"), F.regexp_extract("text", p, 2).alias("via"))


@query("select s_suppkey, unnest(list_sort(list_distinct(string_split(lower(s_name) || '|' || replace(lower(s_name), '#', ' '), '|')))) as alias from supplier")
def str29_alias_expansion(spark, d):
    low = F.lower("s_name")
    return table(spark, d, "supplier").select("s_suppkey", F.explode(F.array_sort(F.array_distinct(F.array(low, F.replace(low, F.lit("#"), F.lit(" ")))))).alias("alias"))


@query("select o_orderkey, (o_orderdate::date)::varchar as day from orders")
def dt3_first_date_in_text(spark, d):
    day = F.col("o_orderdate").cast("date").cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("posted "), day, F.lit(" and later"))).otherwise("none")
    found = F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(found, F.col("o_orderdate").cast("date")).cast("string").alias("day"))


@query("select c_custkey, unnest([last_day(date '2023-11-01'), last_day(date '2023-12-01'), last_day(date '2024-01-01')]) as cutoff from customer")
def dt6_monthly_cutoffs(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.explode(D.cutoffs_before(F.lit("2024-02-15").cast("date"), 3)).alias("cutoff"))


@query("select event_id, (event_id % 400)::int > 0 and (ts::date - (event_id % 400)::int) < ts::date - 365 as historical from events")
def dt14_historical_assertion(spark, d):
    day = F.col("ts").cast("date")
    said = F.date_sub(day, (F.col("event_id") % 400).cast("int"))
    return table(spark, d, "events").select("event_id", ((F.col("event_id") % 400 > 0) & (said < F.date_sub(day, 365))).alias("historical"))


@query("select event_id, event_type as kind, len(list_filter(['a', case when event_id % 2 = 0 then 'b' end], lambda x: x is not null))::int as slots from events")
def jsn2_normalize_slots(spark, d):
    raw = F.map_from_arrays(F.array(F.lit("kind"), F.lit("b"), F.lit("none")), F.array(F.concat(F.lit("  "), "event_type", F.lit(" ")), F.when(F.col("event_id") % 2 == 0, "x").otherwise(""), F.lit("")))
    m = M.clean_slots(raw)
    return table(spark, d, "events").select("event_id", F.element_at(m, "kind").alias("kind"), F.size(m).alias("slots"))


@query("select l_orderkey as claim, unnest([l_partkey, l_suppkey]) as node, unnest(['span', 'candidate']) as kind from lineitem where l_quantity > 49")
def jsn9_claim_relations(spark, d):
    ends = F.array(F.struct(F.col("l_partkey").alias("node"), F.lit("span").alias("kind")), F.struct(F.col("l_suppkey").alias("node"), F.lit("candidate").alias("kind")))
    return table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("claim"), F.inline(ends))


@query("""with u as (select doc_id, i, s, case when regexp_matches(s, '(?i)(^| )tion') then 2 when regexp_matches(s, '(?i)heit') then 1 else 0 end as p from (select doc_id, unnest(generate_series(0, len(l) - 1)) as i, unnest(l) as s from (select doc_id, string_split(text, chr(10)) as l from documents)))
select doc_id, arg_max(i, (p, -i)) as line, max(p) as priority from u where p > 0 group by 1""")
def ext1_priority_events(spark, d):
    return _priority_lines(table(spark, d, "documents"))


def _priority_lines(docs):
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    p = F.when(F.col("s").rlike("(?i)(^| )tion"), 2).when(F.col("s").rlike("(?i)heit"), 1).otherwise(0)
    found = lines.withColumn("p", p).where("p > 0")
    return found.groupBy("doc_id").agg(F.max_by(F.col("i").cast("long"), F.struct("p", -F.col("i"))).alias("line"), F.max("p").alias("priority"))


@query("""select doc_id, k as kind, case when contains(text, 'ed') then 'completed' else 'started' end as status from documents join (values ('site', 'heit'), ('order', 'tion'), ('team', 'mente')) p(k, w) on contains(text, w)""")
def ext2_industry_events(spark, d):
    kinds = {"site": "heit", "order": "tion", "team": "mente"}  # a fixed table: an array in each row
    hit = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(w)), F.lit(k)) for k, w in kinds.items()]))
    status = F.when(F.contains("text", F.lit("ed")), "completed").otherwise("started")
    return table(spark, d, "documents").select("doc_id", F.explode(hit).alias("kind"), status.alias("status"))


@query("""with e as (select user_id, event_type, event_id, 0 as src from events where event_id % 2 = 0 union all select user_id, event_type, event_id, 1 from events where event_id % 3 = 0) select user_id, event_type, arg_min(event_id, (src, event_id)) as event_id from e group by 1, 2""")
def ext3_combined_events(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    both = e.where("event_id % 2 = 0").withColumn("src", F.lit(0)).unionByName(e.where("event_id % 3 = 0").withColumn("src", F.lit(1)))
    return R.best_per_key(both, ["user_id", "event_type"], _c("src", "event_id")).select("user_id", "event_type", "event_id")


@query("select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}')[1:3])) as company from documents")
def ext5_three_companies(spark, d):
    found = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.slice(found, 1, 3))).alias("company"))


@query("""with d as (select doc_id, text, substr(text, 1, 2000) as head, substr(text, 2001) as tail, case doc_id % 5 when 0 then 'Weekly digest' when 1 then 'Opinion' when 2 then 'Interview' else '' end as title, doc_id % 11 = 0 as bulletin, length(text) as n from documents),
f as (select *, len(regexp_extract_all(text, '#')) >= 2 as sections, contains(head, 'heit') and (doc_id % 5 <> 1 or contains(head, 'mente')) as event, doc_id % 5 = 2 or len(regexp_extract_all(head, 'qu')) >= 2 as interview from d),
g as (select *, bulletin or doc_id % 5 = 0 or sections as digest from f),
m as (select *, case when digest then 'multi_event_digest' when n <= 2000 then 'full_short' when event and interview then 'interview_prefix' when event then 'single_event_expansion' else 'skip_low_value' end as window_mode from g)
select doc_id, window_mode, case when digest and sections and not bulletin then 'body_digest_structure' when digest then 'bulletin_or_digest_structure' when n <= 2000 then 'under_window_limit' when event and interview then 'interview_lead_contains_event' when event then 'concrete_lead_event_followed_by_long_form' when interview then 'interview_or_commentary_without_concrete_lead_event' else 'no_concrete_event_in_lead_window' end as reason,
  len(regexp_extract_all(head, 'tion'))::int as head_actions, len(regexp_extract_all(tail, 'tion'))::int as tail_actions,
  sha256(case when window_mode in ('multi_event_digest', 'full_short') then text when window_mode = 'skip_low_value' then repeat(' ', n) else head || repeat(' ', n - 2000) end) as body from m""")
def ext10_window_decision(spark, d):
    k = F.col("doc_id")
    title = F.when(k % 5 == 0, "Weekly digest").when(k % 5 == 1, "Opinion").when(k % 5 == 2, "Interview").otherwise("")
    patterns = {"section": "#", "bulletin_title": "digest", "event": "heit", "company_event": "mente", "commentary_title": "Opinion", "interview_title": "Interview", "interview_cue": "qu", "action": "tion"}
    docs = table(spark, d, "documents").select("doc_id", "text", U.article_window(F.col("text"), title, k % 11 == 0, patterns).alias("w"))
    return docs.select("doc_id", F.col("w.mode").alias("window_mode"), "w.reason", "w.head_actions", "w.tail_actions", F.sha2(U.windowed_body(F.col("text"), F.col("w")), 256).alias("body"))


@query("select user_id, event_type, false as seeded from (select distinct user_id, event_type from events where value > 80) union all select user_id, 'view', true from (select distinct user_id from events) where user_id not in (select user_id from events where value > 80 and event_type = 'view')")
def ext12_claim_ledger(spark, d):
    e = table(spark, d, "events")
    claims = e.where("value > 80").select("user_id", "event_type").distinct()
    seeds = e.select("user_id", F.lit("view").alias("event_type")).distinct().join(claims, ["user_id", "event_type"], "left_anti")
    return claims.withColumn("seeded", F.lit(False)).unionByName(seeds.withColumn("seeded", F.lit(True)))


@query("""with e as (select event_id as n, event_type as source, 'https://News.example/' || user_id as url, case when event_id % 7 = 0 then null else 'c' || user_id end as company, case when event_type = 'error' then 'other' else event_type end as kind, strftime(ts, '%Y-%m-%d') as day, props from events)
select n, company, kind, day, case when n % 2 = 0 then 'sum' else props end as title, props as snippet, sha256(source || '|' || url) as document_id, sha256(sha256(source || '|' || url) || '|' || company || '|' || kind || '|' || day || '||done') as record_id, 'news.example' as source_group
from e where kind <> 'other' and company is not null and n % 5 <> 0""")
def ext23_events_to_evidence(spark, d):
    n = F.col("event_id")
    quotes = F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("props", F.lit("more")))
    events = table(spark, d, "events").select(
        F.col("event_type").alias("source_id"), F.concat(F.lit("https://News.example/"), F.col("user_id").cast("string")).alias("url"), F.when(n % 7 != 0, F.concat(F.lit("c"), F.col("user_id").cast("string"))).alias("company"), F.when(F.col("event_type") == "error", "other").otherwise(F.col("event_type")).alias("kind"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit(None).cast("string").alias("round"), F.lit("done").alias("status"), F.when(n % 2 == 0, "sum").alias("summary"), quotes.alias("quotes"), n.alias("n"),
    )
    return E.event_evidence(events, "n").withColumnRenamed("event_id", "record_id")


@query("""with u as (select user_id, event_type, event_id % 4 as g, event_type in ('purchase', 'signup') and value > 90 as strong from events where event_type <> 'view' and event_id % 5 <> 0),
n as (select user_id, count(*) as n, count(distinct event_type) as kinds, count(distinct g) filter (where g <> 0) as groups, bool_or(strong) as strong from u group by 1)
select user_id, coalesce(n, 0) > 0 as upstream, coalesce(strong or (n >= 2 and kinds >= 2 and groups >= 2), false) as near_term from (select distinct user_id from events) left join n using (user_id)""")
def ext24_hypothesis_gate(spark, d):
    group = F.when(F.col("event_id") % 4 == 0, " ").otherwise((F.col("event_id") % 4).cast("string"))
    e = table(spark, d, "events").select("user_id", "event_type", group.alias("source"), F.when(F.col("value") > 90, "a").otherwise("B").alias("grade"), (F.col("event_id") % 5 == 0).alias("late"))
    return O.evidence_gate(e, "user_id", "event_type", "source", "grade", "late", ("purchase", "signup"), "view")


@query("select doc_id, len(regexp_extract_all(text, 'tion'))::int * 2 + len(regexp_extract_all(text, 'heit'))::int as score from documents")
def ext28_topic_matching(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.regexp_count("text", F.lit("tion")) * 2 + F.regexp_count("text", F.lit("heit"))).alias("score"))


@query()
def gr4_shared_company_cases(spark, d):
    # Companies stand on negative nodes, which no case key meets; a component is named by its least case.
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("a"), (-1 - F.col("c_nationkey")).cast("long").alias("b"))
    found = G.components(e, "a", "b").where("node >= 0")
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


@query("select s_suppkey::bigint as a, s_nationkey::bigint as b, 'in' as relation from supplier where s_acctbal > 5000")
def gr5_graph_view(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 5000")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    return s.join(n, "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").cast("long").alias("b"), F.lit("in").alias("relation"))


@query("select o_custkey, count(*) as rows, count(distinct sha256(o_orderkey || '|' || o_orderstatus)) = count(*) as hashes_unique from orders group by 1")
def ml2_row_hashes(spark, d):
    h = F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("rows"), (F.countDistinct(h) == F.count("*")).alias("hashes_unique"))


@query("""with w as (select user_id, date_trunc('week', ts)::date as a, (date_trunc('week', ts) + interval 7 day)::date as b, count(*) filter (where event_type = 'purchase') as p from events group by 1, 2, 3)
select coalesce(case when a < date '2024-01-15' then 'train' else 'test' end, 'all') as split, count(*) as rows, count(*) filter (where p > 0) as positive from w group by rollup (case when a < date '2024-01-15' then 'train' else 'test' end)""")
def ml7_panel_counts(spark, d):
    w = table(spark, d, "events").groupBy("user_id", F.date_trunc("week", "ts").cast("date").alias("a")).agg(F.count_if(F.col("event_type") == "purchase").alias("p"))
    split = F.when(F.col("a") < F.lit("2024-01-15").cast("date"), "train").otherwise("test")
    return w.withColumn("split", split).rollup("split").agg(F.count("*").alias("rows"), F.count_if(F.col("p") > 0).alias("positive")).select(F.coalesce("split", F.lit("all")).alias("split"), "rows", "positive")


@query("""with r as (select user_id, event_id, event_type, row_number() over (partition by user_id order by value desc, event_id) as k from events where ts < timestamp '2024-01-20') select user_id, 'case-' || substr(sha256(user_id::varchar), 1, 8) as alias, string_agg(event_id || ':' || event_type, ' ' order by k) as packet from r where k <= 5 group by 1""")
def ml8_prediction_packets(spark, d):
    e = table(spark, d, "events").where("ts < timestamp_ntz'2024-01-20'").select("user_id", "event_id", "event_type", "value")
    top = R.top_n(e, ["user_id"], [F.desc("value"), F.col("event_id")], 5, "k")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("t")))), lambda x: x["t"]), " ")
    return top.groupBy("user_id").agg(text.alias("packet")).select("user_id", F.concat(F.lit("case-"), F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 8)).alias("alias"), "packet")


@query("""select user_id, list_sort(list_distinct(list(event_type) filter (where event_id % 2 = 0))) is not distinct from list_sort(list_distinct(list(event_type) filter (where event_id % 2 = 1))) as agree from events group by 1""")
def ml10_annotation_agreement(spark, d):
    sig = lambda k: F.array_sort(F.collect_set(F.when(F.col("event_id") % 2 == k, F.col("event_type"))))
    a = table(spark, d, "events").groupBy("user_id").agg(sig(0).alias("a"), sig(1).alias("b"))
    return a.select("user_id", (F.col("a") == F.col("b")).alias("agree"))


@query("""with g as (select l_orderkey, l_partkey % 100 as k, bool_or(l_returnflag = 'A') as gold, bool_or(l_quantity > 25) as pred from lineitem group by 1, 2)
select round(count(*) filter (where gold and pred) / count(*) filter (where pred), 8) as precision_, round(count(*) filter (where gold and pred) / count(*) filter (where gold), 8) as recall from g""")
def ml11_event_metrics(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_partkey") % 100).agg(F.bool_or(F.col("l_returnflag") == "A").alias("gold"), F.bool_or(F.col("l_quantity") > 25).alias("pred"))
    both = F.count_if(F.col("gold") & F.col("pred"))
    return g.agg(F.round(both / F.count_if("pred"), 8).alias("precision_"), F.round(both / F.count_if("gold"), 8).alias("recall"))


@query("""with l as (select user_id, arg_max(event_type, (ts, event_id)) as status, arg_max(value, (ts, event_id)) as v from events group by 1) select user_id, status <> 'error' and v < 200 as valid from l""")
def st3_cache_validity(spark, d):
    l = R.latest_per_key(table(spark, d, "events").select("user_id", "event_type", "value", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    return l.select("user_id", ((F.col("event_type") != "error") & (F.col("value") < 200)).alias("valid"))


@query("select o_custkey, date_diff('day', max(o_orderdate)::date, date '2001-08-02') > 180 as stale from orders group by 1")
def st5_staleness(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.datediff(F.lit("2001-08-02").cast("date"), F.max("o_orderdate").cast("date")) > S.STALE_DAYS).alias("stale"))


@query("""with recursive r as (select event_type as provider, ts::date as day, event_id // 2 as operation, event_id % 6 + 1 as points, event_id % 3 = 0 as committed, row_number() over (partition by event_type, ts::date order by event_id) as i from events),
f as (select provider, day, operation, points, committed, i, points <= 30 as passed, case when points <= 30 then points else 0 end as used, case when points <= 30 then [operation] else [] end as known from r where i = 1
  union all select r.provider, r.day, r.operation, r.points, r.committed, r.i, not list_contains(f.known, r.operation) and f.used + r.points <= 30,
    case when not list_contains(f.known, r.operation) and f.used + r.points <= 30 then f.used + r.points else f.used end, case when not list_contains(f.known, r.operation) and f.used + r.points <= 30 then list_append(f.known, r.operation) else f.known end
  from f join r on r.provider = f.provider and r.day = f.day and r.i = f.i + 1)
select provider, day, operation, points, case when not passed then 'refused' when committed then 'spent' else 'reserved' end as state from f""")
def st10_budget_ledger(spark, d):
    asked = table(spark, d, "events").select(F.col("event_type").alias("provider"), F.col("ts").cast("date").alias("day"), "event_id", F.floor(F.col("event_id") / 2).alias("operation"), (F.col("event_id") % 6 + 1).alias("points"), (F.col("event_id") % 3 == 0).alias("committed"))
    return O.budget_ledger(asked, ["provider", "day"], F.col("event_id"), "operation", "points", "committed", 30)


@query("""with h as (select user_id, list_distinct(list(event_type)) as urls from events where ts::date >= date '2024-01-10' and ts::date < date '2024-01-17' group by 1), n as (select user_id, list_distinct(list(event_type)) as urls from events where ts::date = date '2024-01-17' group by 1),
p as (select distinct user_id from events where ts::date < date '2024-01-10')
select n.user_id, case when h.user_id is null and p.user_id is null then 'new' when h.user_id is null then 'returning' when len(list_filter(n.urls, lambda x: not list_contains(h.urls, x))) > 0 then 'new evidence' else 'cooling' end as segment from n left join h using (user_id) left join p on n.user_id = p.user_id""")
def st11_cooldown(spark, d):
    daily = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.collect_set("event_type").alias("urls"))
    today = F.lit("2024-01-17").cast("date")
    return O.cooled(daily.where(F.col("day") == today).drop("day"), daily.where(F.col("day") < today), "user_id", "urls", "day", today)


@query("""with l as (select user_id, max(ts) as ts, arg_max(event_type, (ts, event_id)) as state from events group by 1) select user_id, case when state = 'view' and ts < timestamp '2024-01-30 12:00:00' then 'reclaim' when state = 'view' then 'claimed' else 'free' end as claim from l""")
def st14_stale_claim(spark, d):
    l = R.latest_per_key(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    old = F.col("ts") < F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return l.select("user_id", F.when((F.col("event_type") == "view") & old, "reclaim").when(F.col("event_type") == "view", "claimed").otherwise("free").alias("claim"))


@query("select o_custkey, md5(string_agg(o_orderkey || ':' || o_orderstatus, ',' order by o_orderkey)) as output from orders group by 1")
def st17_stage_output(spark, d):
    item = F.struct("o_orderkey", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ",")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.md5(text.cast("binary")).alias("output"))


@query("select s_suppkey, greatest(300.0, least(604800.0, 3600.0 * (1 + s_suppkey % 400)))::double as seconds from supplier")
def st6b_bounded_interval(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", Z.bounded(F.lit(3600.0) * (1 + F.col("s_suppkey") % 400)).alias("seconds"))
