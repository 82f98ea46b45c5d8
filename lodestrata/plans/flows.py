"""Queries on sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import time as D
from lodestrata.operators import extraction as X
from lodestrata.sources import readers as S
from lodestrata.streaming import windows as W

from .catalog import query, table


@query("select user_id, event_id, event_type, value from events")
def src1_evidence_json(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("evidence"))).alias("value"))
    rows = F.from_json("value", "struct<evidence:array<struct<event_id:long,event_type:string,value:double>>>")["evidence"]
    return e.select("user_id", F.inline(rows))


@query("select event_id, event_type, (props->>'k')::bigint as k from events")
def src8_json_columns(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


@query("select c_nationkey::varchar as key, c_name as title, 'https://example.org/' || c_custkey as url, '2024-01-01' as published, c_mktsegment as text from customer")
def src9_rss(spark, d):
    c = table(spark, d, "customer")
    item = F.concat(F.lit("<item><title>"), "c_name", F.lit("</title><link>https://example.org/"), F.col("c_custkey").cast("string"), F.lit("</link><pubDate>2024-01-01</pubDate><description>"), "c_mktsegment", F.lit("</description></item>"))
    feeds = c.groupBy("c_nationkey").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml"))
    return S.read_feeds(feeds, "c_nationkey", "xml")


@query("select c_nationkey::varchar as key, c_name as title, 'https://example.org/' || c_custkey as url, null::varchar as published, c_mktsegment as text from customer")
def src10_json_feed(spark, d):
    c = table(spark, d, "customer")
    item = F.struct(F.concat(F.lit("https://example.org/"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("content_text"))
    feeds = c.groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("json"))
    return S.read_json_feeds(feeds, "c_nationkey", "json")


@query(r"select page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"'))::int as links from pages")
def src11_html_links(spark, d):
    return X.parsed_pages(table(spark, d, "pages"), "page_id", "html").select("page_id", F.size("links").alias("links"))


@query(r"""with l as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as title, unnest(generate_series(0, len(regexp_extract_all(html, '<a href="')) - 1)) as position from pages),
f as (select page_id, href, min(position) as position, arg_min(title, position) as title from l where regexp_matches(href, '^/[A-Za-z]+$') and length(title) >= 4 group by 1, 2)
select page_id, position::int as position, href, title from f qualify row_number() over (partition by page_id order by position) <= 5""")
def src12_candidate_links(spark, d):
    parsed = X.parsed_pages(table(spark, d, "pages"), "page_id", "html")
    return X.candidate_links(parsed, "page_id", "^/[A-Za-z]+$", 4, 5)


@query("select doc_id, text = text as same, length(text)::int as n from documents")
def src14_decode_body(spark, d):
    docs = table(spark, d, "documents")
    body = F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(F.encode("text", "UTF-8"))
    back = S.decode_body(body, F.lit("utf-8"))
    return docs.select("doc_id", (back == F.col("text")).alias("same"), F.length(back).alias("n"))


@query("select 's' || s_suppkey as source, 'N' || min(s_nationkey) as pack, 'direct' as kind from supplier where s_acctbal > 0 and s_nationkey in (1, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 21) group by s_suppkey")
def src21_select_sources(spark, d):
    s = table(spark, d, "supplier")
    packs = s.select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("pack")).distinct().withColumn("alias", F.col("pack"))
    sources = s.select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("pack"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source"), F.lit("direct").alias("kind"), (F.col("s_acctbal") > 0).alias("enabled"))
    return S.select_sources(packs, sources.where("pack rlike '1'"), "1").select("source", "pack", "kind")


@query("select 's' || s_suppkey % 90 as source, 'listed twice' as violation from supplier group by s_suppkey % 90 having count(*) > 1 union all select 's' || s_suppkey % 90, 'unknown kind' from supplier where s_acctbal < 0")
def src22_registry_violations(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 90).cast("string")).alias("source"), F.when(F.col("s_acctbal") < 0, "odd").otherwise("direct").alias("kind"))
    return S.registry_violations(s, ["direct", "feed"])


@query("select l_orderkey, count(*) between 2 and 6 and count(distinct l_linenumber) = count(*) and count(distinct l_partkey) = count(*) as ok, count(*) as items from lineitem group by 1")
def src25_valid_listing(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("https://h.example/"), F.col("l_partkey").cast("string")).alias("url"), F.lit("a title").alias("title"))
    return S.valid_listing(li, "l_orderkey", "l_linenumber", "url", "title", "h.example", (2, 6), (3, 20))


@query("select epoch_us(time_bucket(interval 1 day, ts)) as start_us, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def st_tumbling_window(spark, d):
    out = W.drained(W.tumbling(W.stream(spark, d, "events"), "event_type", "1 day", "40 days"), "complete")
    return out.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""select epoch_us(s) as start_us, event_type, count(*) as n from (select event_type, unnest([time_bucket(interval 6 hour, ts), time_bucket(interval 6 hour, ts) - interval 6 hour]) as s from events) group by 1, 2""")
def st_sliding_window(spark, d):
    out = W.drained(W.sliding(W.stream(spark, d, "events"), "event_type", "12 hours", "6 hours", "40 days"), "complete")
    return out.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")


@query("""with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 8 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as i from g) select user_id, epoch_us(min(ts)) as start_us, count(*) as n from s group by user_id, i""")
def st_session_window(spark, d):
    out = W.drained(W.sessions(W.stream(spark, d, "events"), "user_id", "8 hours", "40 days"), "complete")
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("select user_id, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us, count(*) as n from events group by 1")
def st4_first_last_seen(spark, d):
    out = W.drained(W.first_last_seen(W.stream(spark, d, "events"), "user_id"), "complete")
    return out.select("user_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n")


@query("select count(distinct (user_id, event_type)) as n from events")
def st1_stream_dedup(spark, d):
    once = W.once(W.stream(spark, d, "events"), ["user_id", "event_type"], "40 days")
    return W.drained(once.select("user_id", "event_type"), "append").agg(F.count("*").alias("n"))


@query("select event_id, epoch_us(ts) // 86400000000 as day from events")
def src7_probed_columns(spark, d):
    e = table(spark, d, "events")
    at = F.coalesce(*[F.col(c) for c in ("published_at", "ts", "created") if c in e.columns])
    return e.select("event_id", F.floor(D.micros(at) / F.lit(86_400_000_000)).alias("day"))
