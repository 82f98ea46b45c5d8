"""Queries on adapters, reports, bundles, small selections and payloads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestrata.functions import rules as U
from lodestrata.functions import text as T
from lodestrata.functions import time as D
from lodestrata.operators import extraction as X
from lodestrata.operators import graph as G
from lodestrata.operators import ranges as J
from lodestrata.operators import rows as R
from lodestrata.operators import scoring as S
from lodestrata.operators import selection as P
from lodestrata.operators.shared import shared
from lodestrata.sources import adapters as A
from lodestrata.sources import readers

from .catalog import query, table
from .texts import TOLD

#: Leads of a packed report, at most.
REPORT_LEADS = 4096


@query("select o_custkey, o_orderkey, o_orderpriority as title from orders where o_totalprice > 300000")
def src2_jobs_json(spark, d):
    packed = table(spark, d, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("title")))).alias("value"))
    return packed.select("o_custkey", F.inline(F.from_json("value", "array<struct<o_orderkey:long,title:string>>")))


@query("select source as folder, count(*) as files, sum(strlen(text))::bigint as bytes, count(distinct sha256(text)) as contents from documents group by 1")
def src3_corpus_scan(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("folder")).agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct(F.sha2("text", 256)).alias("contents"))


@query("select c_nationkey, case when c_nationkey % 2 = 0 then 1 else 2 end as version, c_name as company from customer")
def src4_report_versions(spark, d):
    packed = _reports(table(spark, d, "customer"))
    one = F.startswith("value", F.lit("["))
    v1, v2 = F.from_json("value", "array<struct<company:string>>"), F.from_json("value", "struct<schema_version:int,leads:array<struct<company:string>>>")
    # Each version is read by its own parser alone, and each report once.
    read = packed.select("c_nationkey", one.alias("one"), F.when(one, v1).alias("v1"), F.when(~one, v2).alias("v2"))
    return read.select("c_nationkey", F.when(F.col("one"), 1).otherwise(F.col("v2.schema_version")).alias("version"), F.inline(F.coalesce("v1", "v2.leads")))


def _reports(customers, leads=REPORT_LEADS):
    """Reports of one nation each, of so many leads at most, by version 1 or 2: a nation has as many as its
    leads need, and a task packs those of its own rows, so neither a report nor a group grows with the table."""
    lead = F.collect_list(F.struct(F.col("c_name").alias("company")))
    parted = customers.select("c_nationkey", "c_name", F.floor(F.monotonically_increasing_id() / leads).alias("part"))
    return parted.groupBy("c_nationkey", "part").agg(F.when(F.col("c_nationkey") % 2 == 0, F.to_json(lead)).otherwise(F.to_json(F.struct(F.lit(2).alias("schema_version"), lead.alias("leads")))).alias("value")).drop("part")


@query("select event_id, (" + repr([t[1] for t in TOLD]) + ")[i] as event_type, value > 20 as routed from (select event_id, value, (event_id % " + str(len(TOLD)) + " + 1)::int as i from events) where (" + repr([t[2] for t in TOLD]) + ")[i] <> 'ignore' and (" + repr([t[1] for t in TOLD]) + ")[i] not in ('job_ad', 'workforce_cluster')")
def src5_legacy_replay(spark, d):
    # An old report has texts without types: these are told anew, and ended or recruiting ones are left out.
    text = F.element_at(F.array(*[F.lit(t[0]) for t in TOLD]), (F.col("event_id") % len(TOLD) + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", "value", T.signal(text).alias("s"))
    return e.where((F.col("s.phase") != "ignore") & ~F.col("s.event_type").isin(*T.RECRUITING)).select("event_id", "s.event_type", (F.col("value") > 20).alias("routed"))


@query("select * from (values (1, 'Alpha', 'funding'), (2, 'Beta', 'factory_or_capacity'), (3, 'Gamma', 'job_ad')) t(id, company, event_type)")
def src6_demo_fixture(spark, d):
    return spark.createDataFrame([(1, "Alpha", "funding"), (2, "Beta", "factory_or_capacity"), (3, "Gamma", "job_ad")], "id int, company string, event_type string")


@query("select event_id, case event_id % 3 when 0 then event_type || ' seen' when 1 then event_type else event_type || ' raw' end as text from events")
def src13_detail_text(spark, d):
    k = F.col("event_id") % 3
    body = F.when(k == 0, F.concat(F.lit("<p>"), "event_type", F.lit("</p><b>seen</b>"))).when(k == 1, F.concat(F.lit('{"content": "'), "event_type", F.lit('"}'))).otherwise(F.concat(F.lit("  "), "event_type", F.lit(" \n raw ")))
    kind = F.when(k == 0, "text/html; charset=utf-8").when(k == 1, "application/json").otherwise("text/plain")
    return table(spark, d, "events").select("event_id", A.detail_text(body, kind).alias("text"))


@query("select page_id, 'html' as kind, true as ok from pages where page_id % 3 = 0 union all select page_id, 'json', false from pages where page_id % 3 = 1 union all select page_id, 'odd', false from pages where page_id % 3 = 2")
def src23_adapter_registry(spark, d):
    kind = F.element_at(F.array(F.lit("html"), F.lit("json"), F.lit("odd")), (F.col("page_id") % 3 + 1).cast("int"))
    return A.parsed_by_source(table(spark, d, "pages").withColumn("kind", kind), "page_id", "kind", "html").select("page_id", "kind", "ok")


@query(r"select page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) as lang, len(regexp_extract_all(html, '<li>'))::int as items from pages")
def src27_guest_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<li>")).alias("items"))


@query("select page_id, url, lower(html) like '%tion%' as relevant from pages where url like 'https%'")
def src28_fixed_crawl(spark, d):
    return table(spark, d, "pages").where(F.startswith("url", F.lit("https"))).select("page_id", "url", F.contains(F.lower("html"), F.lit("tion")).alias("relevant"))


@query("select distinct user_id, event_type from events where value > 40 or (value <= 40 and value > 10)")
def src29_two_pass_discovery(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value")
    first, second = e.where("value > 40").drop("value").distinct(), e.where("value <= 40 and value > 10").drop("value").distinct()
    return A.two_pass_links(first, second, "user_id", "event_type")


@query("select * from (values ('A', '1'), ('B', 'two words'), ('C', 'x=y')) t(name, value)")
def src30_env_values(spark, d):
    return spark.createDataFrame(list(A.env_values("# c\nA=1\nexport B='two words'\n\nC=x=y").items()), "name string, value string")


@query("select conv_id, turn, unnest(string_split(text, chr(10))) as block from conversations where role = 'assistant'")
def src31_block_split(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("block"))


@query("select s_suppkey, round(s_acctbal, 2) as balance, true as refused from supplier")
def snk19_frozen_snapshot(spark, d):
    at = shared(spark, "snapshot")
    rows = table(spark, d, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("balance"))
    readers.write_once(rows, at)
    try:
        readers.write_once(rows.limit(0), at)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(at).withColumn("refused", F.lit(refused))


@query("select o_custkey as company, strftime(o_orderdate, '%Y-%m') as month, count(*) as orders from orders group by 1, 2")
def snk20_dataset(spark, d):
    at = shared(spark, "dataset")
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("orders"))
    rows.repartition("month").write.partitionBy("month").parquet(at)
    back = spark.read.schema("company long, orders long, month string").parquet(at)
    return back.select("company", "month", "orders")


@query("select c_custkey, case when c_custkey % 5 = 0 then 'deactivate' when c_custkey % 7 = 0 then 'create' else 'update' end as action, c_acctbal >= 0 as applied from customer where c_custkey % 5 = 0 or c_custkey % 7 = 0 or c_custkey % 11 = 0")
def snk17_apply_changes(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    old = c.where("c_custkey % 7 != 0 or c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("v"))
    new = c.where("c_custkey % 5 != 0").select("c_custkey", F.col("c_acctbal").alias("v"))
    return R.change_set(old, new, "c_custkey", ["v"]).join(c, "c_custkey").select("c_custkey", "action", (F.col("c_acctbal") >= 0).alias("applied"))


@query("""select c_nationkey, '{"schema_version":2,"leads":' || count(*) || '}' as head from customer group by 1""")
def snk18_report_envelope(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.struct(F.lit(2).alias("schema_version"), F.count("*").alias("leads"))).alias("head"))


@query("select event_type as key, sum(event_id % 5)::bigint as counter, max(epoch_us(ts)) as gauge from events group by 1")
def snk23_ops_metrics(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), (F.col("event_id") % 5).alias("c"), D.micros(F.col("ts")).alias("g"))
    return e.groupBy("key").agg(F.sum("c").alias("counter"), F.max("g").alias("gauge"))


@query("""select 'snap_' || substr(sha256(string_agg(o_orderkey || '=' || o_orderstatus, ',' order by o_orderkey)), 1, 16) as snapshot, o_custkey, count(*) as drafts from orders group by o_custkey""")
def snk25_bundle_snapshot(spark, d):
    item = F.struct("o_orderkey", F.concat_ws("=", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ",")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.lit("snap_"), F.substring(F.sha2(text, 256), 1, 16)).alias("snapshot"), F.count("*").alias("drafts"))


@query("select count(*) as rows, count(distinct md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey)) as hashes from lineitem")
def snk22_copy_check(spark, d):
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).cast("binary"))
    return table(spark, d, "lineitem").agg(F.count("*").alias("rows"), F.countDistinct(h).alias("hashes"))


@query("select conv_id, turn from conversations where role not in ('user', 'assistant', 'system') or text is null or length(text) > 900")
def flt21_payload_contract(spark, d):
    c = table(spark, d, "conversations")
    return c.where(~F.col("role").isin("user", "assistant", "system") | F.col("text").isNull() | (F.length("text") > 900)).select("conv_id", "turn")


@query("select c_custkey, c_mktsegment from customer")
def flt26_key_stripping(spark, d):
    c = table(spark, d, "customer")
    private = ("name", "acctbal", "nationkey")
    return c.select(*[x for x in c.columns if not x.endswith(private)])


@query("select event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by 1")
def win3_latest(spark, d):
    return R.latest_per_key(table(spark, d, "events").select("event_type", "event_id", "ts"), ["event_type"], ["ts", "event_id"]).select("event_type", "event_id")


@query()
def top7_greedy_pick(spark, d):
    # Of a nation only its best customer in a segment can ever be picked there: any other comes later.
    c = table(spark, d, "customer")
    best = c.groupBy("c_mktsegment", "c_nationkey").agg(F.max(F.struct("c_acctbal", (-F.col("c_custkey")).alias("k"))).alias("b"))
    rows = P.pool(best.select("c_mktsegment", (-F.col("b.c_acctbal")).alias("order"), (-F.col("b.k")).alias("c_custkey"), "c_nationkey"), "c_mktsegment", "order", "c_custkey", "c_nationkey")
    return spark.createDataFrame(P.greedy_distinct([(g, k, n) for g, _, k, n in sorted(rows)], 3), "segment string, custkey long, nation int")


@query()
def top11_greedy_coverage(spark, d):
    parts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.col("l_partkey") % 60).alias("s"))
    return spark.createDataFrame(list(enumerate(P.greedy_cover_rows(parts, "l_suppkey", "s", 5))), "place int, l_suppkey long")


@query()
def top12_quota_restarts(spark, d):
    quotas = {"BUILDING": 5, "MACHINERY": 4, "HOUSEHOLD": 3}
    rows = P.pool(P.quota_candidates(table(spark, d, "customer"), "c_custkey", "c_mktsegment", quotas, "v2"), "c_custkey", "c_mktsegment")
    chosen = P.quota_restarts(rows, quotas, "v2")
    return spark.createDataFrame([(k,) for k in chosen], "c_custkey long")


@query()
def top13_exact_size_split(spark, d):
    c, beyond = table(spark, d, "customer"), 1 << 40  # groups stand on nodes above every key
    comp = G.components(c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") % 17 + beyond).alias("b")), "a", "b").where(F.col("node") < beyond)
    return P.group_disjoint_split(comp, "component", c.count() // 2)


@query("select p_partkey, p_type in ('LARGE', 'PROMO') as director from part")
def str14_director_predicate(spark, d):
    title = F.when(F.col("p_type") == "LARGE", "VP of Rods").when(F.col("p_type") == "PROMO", "Sales Director").otherwise("Account Manager")
    return table(spark, d, "part").select("p_partkey", (T.seniority(title) == "director_plus").alias("director"))


@query("select p_partkey, case when p_partkey % 2 = 0 then 'A轮' else 'B+轮' end as round, case when p_partkey % 2 = 0 then p_size || '万元' else '超' || p_size || '亿元' end as amount, case when p_partkey % 2 = 0 then '5亿元' else '8亿美元' end as in_all from part")
def str23_nearest_amount(spark, d):
    n, closed = F.col("p_size").cast("string"), F.col("p_partkey") % 2 == 0
    done = F.concat(F.lit("总融资额5亿元；公司今日公告称其已经正式完成A轮融资"), n, F.lit("万元，估值10亿元"))
    begun = F.concat(F.lit("此前天使轮获投，现启动B+轮融资，拟募超"), n, F.lit("亿元，累计融资额8亿美元"))
    at = F.instr(F.when(closed, done).otherwise(begun), F.when(closed, "完成A轮").otherwise("启动B+轮")) - 1
    rows = table(spark, d, "part").select("p_partkey", U.funding(F.when(closed, done).otherwise(begun), at, at + 5, ~closed).alias("f"))
    return rows.select("p_partkey", "f.round", "f.amount", "f.in_all")


@query(r"select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+'))) as person from documents")
def str28_people(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [A-Z][a-z]+"), F.lit(0)))).alias("person"))


@query("select o_orderkey, (o_orderdate::date + 7)::varchar as expires, case when o_orderkey % 2 = 0 then (o_orderdate::date - 13)::varchar else (o_orderdate::date - 1)::varchar end as start_day from orders")
def dt10_publication_interval(spark, d):
    day = F.col("o_orderdate").cast("date")
    start = F.when(F.col("o_orderkey") % 2 == 0, F.date_sub(D.relative_date(F.lit("1 week ago"), day), 6)).otherwise(D.relative_date(F.lit("1 day ago"), day))
    return table(spark, d, "orders").select("o_orderkey", F.date_add(day, 7).cast("string").alias("expires"), start.cast("string").alias("start_day"))


@query("select event_id, case when event_id % 3 = 2 then null else '{\"kind\":\"' || event_type || '\"}' end as json from events")
def jsn6_bounded_repair(spark, d):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit('```json{"kind":"'), "event_type", F.lit('",}```'))).when(k == 1, F.concat(F.lit('{“kind”:"'), "event_type", F.lit('"}'))).otherwise("{broken")
    return table(spark, d, "events").select("event_id", A.repaired_json(raw).alias("json"))


@query("select event_id, case when event_type = 'view' and value > 50 then 'long view' else event_type end as kind from events where event_type in ('view', 'click')")
def ext4_supplemental_events(spark, d):
    return table(spark, d, "events").where("event_type in ('view', 'click')").select("event_id", F.when((F.col("event_type") == "view") & (F.col("value") > 50), "long view").otherwise(F.col("event_type")).alias("kind"))


@query(r"select doc_id, sha256(text) as digest, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{7,}')))::int as companies from documents where n_chars > 50 and contains(text, 'tion')")
def ext6_process_document(spark, d):
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), F.lit(0)))
    return table(spark, d, "documents").where(F.col("n_chars") > 50).where(F.contains("text", F.lit("tion"))).select("doc_id", F.sha2("text", 256).alias("digest"), F.size(names).alias("companies"))


@query("select doc_id, lang as family, case when n_chars > 4000 then 'window' else 'whole' end as mode, n_chars > 4000 or lang = 'de' as needs_model from documents")
def ext8_route_profile(spark, d):
    long = F.col("n_chars") > 4000
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("family"), F.when(long, "window").otherwise("whole").alias("mode"), (long | (F.col("lang") == "de")).alias("needs_model"))


@query("""with k as (select lower(p_name) as alias, min(p_partkey) as entity from part group by 1) select l_orderkey, l_linenumber, k.entity from lineitem join part on l_partkey = p_partkey join k on lower(p_name) = k.alias where l_quantity > 47""")
def ext14_bind_candidates(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("alias"))
    k = p.groupBy("alias").agg(F.min("p_partkey").alias("entity"))
    li = table(spark, d, "lineitem").where("l_quantity > 47")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).join(k, "alias").select("l_orderkey", "l_linenumber", "entity")


@query(r"""with u as (select item_id, unnest(string_split_regex(regexp_replace(text, '([.!?。！？；\n])', '\1' || chr(1), 'g'), chr(1))) as t from benchmark)
select item_id, count(*) as spans, sum(len(regexp_extract_all(t, '[a-z]+ing')))::bigint as claims from u where regexp_matches(t, '[a-z]+ing') group by 1""")
def ext15_action_spans(spark, d):
    u = X.units(table(spark, d, "benchmark"), "item_id", "text").withColumn("n", F.regexp_count("text", F.lit("[a-z]+ing"))).where("n > 0")
    return u.groupBy("item_id").agg(F.count("*").alias("spans"), F.sum("n").alias("claims"))


@query("""with a as (select distinct user_id, event_type, ts::date as day from events), b as (select * from a where not (event_type = 'click' and exists (select 1 from a x where x.user_id = a.user_id and x.day = a.day and x.event_type = 'purchase')))
select * from b where not (event_type = 'view' and exists (select 1 from b x where x.user_id = b.user_id and x.day = b.day and x.event_type = 'click'))""")
def ext19_merge_passes(spark, d):
    a = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day")).distinct()
    for weaker, stronger in (("click", "purchase"), ("view", "click")):  # ordered passes, each an anti join
        hide = a.where(F.col("event_type") == stronger).select("user_id", "day", F.lit(weaker).alias("event_type"))
        a = a.join(hide, ["user_id", "day", "event_type"], "left_anti").select("user_id", "event_type", "day")
    return a


@query("select item_id, true as grounded, d.doc_id from benchmark b join documents d on contains(d.text, b.text)")
def ext22_grounding(spark, d):
    # Whole items, met by their first 12 characters among the 12-grams of documents; shorter items are compared with every text.
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    heads = b.where(F.length("q") >= 12).select("item_id", F.substring("q", 1, 12).alias("h"))
    met = docs.select("doc_id", F.explode(T.char_grams(F.col("text"), 12)).alias("h")).join(heads, "h").select("item_id", "doc_id").distinct()
    long = met.join(docs, "doc_id").join(b, "item_id").where(F.contains("text", F.col("q"))).select("item_id", F.lit(True).alias("grounded"), "doc_id")
    short = docs.crossJoin(b.where(F.length("q") < 12)).where(F.contains("text", F.col("q"))).select("item_id", F.lit(True).alias("grounded"), "doc_id")
    return long.unionByName(short)


@query("select event_id, event_type as role, event_id % 4 <> 3 as valid from events")
def ext25_response_parsing(spark, d):
    raw = F.when(F.col("event_id") % 4 == 3, '{"roles": 7').otherwise(F.concat(F.lit('{"roles": [{"title": "'), "event_type", F.lit('"}]}')))
    parsed = F.from_json(raw, "struct<roles:array<struct<title:string>>>")
    return table(spark, d, "events").select("event_id", F.coalesce(F.get(parsed["roles"], F.lit(0))["title"], F.col("event_type")).alias("role"), F.try_parse_json(raw).isNotNull().alias("valid"))


@query("select doc_id, i as query, regexp_extract(text, case i when 0 then '([A-Z][a-z]+), ' else '([A-Z][a-z]+)\\.' end, 1) as person from documents cross join (select unnest([0, 1]) as i) where regexp_matches(text, case i when 0 then '([A-Z][a-z]+), ' else '([A-Z][a-z]+)\\.' end)")
def ext29_people_by_query(spark, d):
    patterns = ("([A-Z][a-z]+), ", r"([A-Z][a-z]+)\.")
    found = F.array(*[F.struct(F.lit(i).alias("query"), F.regexp_extract("text", p, 1).alias("person")) for i, p in enumerate(patterns)])
    return table(spark, d, "documents").select("doc_id", F.inline(found)).where("person != ''")


@query()
def gr6_maximum_matching(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", (F.col("o_custkey") % 30).alias("l"), (F.col("o_orderkey") % 25).alias("r")).where("(l + r) % 4 = 0").distinct()
    return J.matching(o, "o_orderstatus", "l", "r")


@query("""with r as (select user_id, event_id, value, event_type = 'purchase' as rel, row_number() over (partition by user_id order by value desc, event_id) as k from events), b as (select user_id, min(case when rel then k end) as best from r group by 1)
select count(*) as queries, round(avg(coalesce((best = 1)::int, 0)), 8) as top1, round(avg(coalesce((best <= 5)::int, 0)), 8) as topk from b""")
def ml5_ranking_evaluation(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_type") == "purchase").alias("rel"))
    m = S.ranking_metrics(e, "user_id", "event_id", "value", "rel", 5)
    return m.select("queries", F.round("top1", 8).alias("top1"), F.round("topk", 8).alias("topk"))


@query("""with o as (select user_id, count(*) as retries from events where event_type = 'error' and ts < timestamp '2024-01-15' group by 1), f as (select distinct user_id from events where event_type = 'error' and ts >= timestamp '2024-01-28')
select coalesce(o.user_id, f.user_id) as user_id, f.user_id is not null as open from o full join f on o.user_id = f.user_id""")
def st7_dead_letter_lifecycle(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    open_ = e.where("ts < timestamp_ntz'2024-01-15'").groupBy("user_id").agg(F.count("*").alias("retries"))
    return R.dead_letters(open_, e.where("ts >= timestamp_ntz'2024-01-28'"), "user_id").select("user_id", (F.col("state") == "open").alias("open"))
