"""Queries on scalar functions, extraction, graphs and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import maps as M
from lodestrata.functions import rules as U
from lodestrata.functions import text as T
from lodestrata.functions import time as D
from lodestrata.operators import extraction as X
from lodestrata.operators import graph as G
from lodestrata.operators import state as Z

from .catalog import query, table

DAY = "2024-01-31"


@query(r"""with u as (select page_id, lower(split_part(url, '://', 1)) as scheme, regexp_replace(split_part(url, '://', 2), '#.*$', '') as rest from pages),
q as (select *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|fbclid|gclid|mc_cid|mc_eid|spm|from|from_source|ref|referrer|source)$'))) as kept from u)
select page_id, scheme || '://' || lower(regexp_extract(rest, '^([^/?]*)', 1)) || regexp_extract(rest, '^[^/?]*([^?]*)', 1) || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as url from q""")
def str2_normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.plain_url(F.col("url")).alias("url"))


@query()
def str2_normalize_url_full(spark, d):
    return table(spark, d, "pages").select("page_id", T.normalize_url("url").alias("url"))


@query(r"select c_custkey, lower(regexp_replace(c_name, '[\s._\-/\\()\[\]\"'',:;]+', '', 'g')) as name from customer")
def str3_normalize_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.ascii_name(F.col("c_name")).alias("name"))


@query(r"select p_partkey, upper(substr(replace(p_name, ' ', ''), 1, 3)) || p_brand as name from part where false or true")
def str5_canonical_company(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.upper(F.substring(F.replace("p_name", F.lit(" ")), 1, 3)), "p_brand").alias("name"))


@query(r"select p_partkey, lower(regexp_replace(p_name || '-' || p_type, '[^A-Za-z0-9_]+', '', 'g')) as title from part")
def str6_canonical_title(spark, d):
    return table(spark, d, "part").select("p_partkey", T.canonical_title(F.concat_ws("-", "p_name", "p_type")).alias("title"))


@query(r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\t\n\v\f\r ]+', ' ', 'g'), ' ') as text from pages""")
def str7_strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query(r"""select item_id, len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?。！？；\n])', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(10) || chr(32))), lambda s: s <> ''))::int as sentences from benchmark""")
def str8_sentences(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query("""select doc_id, i as unit, (i * 900)::int as start, substr(text, (i * 900 + 1)::bigint, 1000) as text from (select doc_id, text, unnest(generate_series(0, greatest(ceil((length(text) - 100) / 900.0), 1)::bigint - 1))::int as i from documents)""")
def str9_chunk_windows(spark, d):
    return X.windows(table(spark, d, "documents"), "doc_id", "text", 1000, 100)


@query("select item_id, substr(text, 1, 10) || repeat(' ', least(30, length(text)) - 10) || substr(text, 31) as text from benchmark")
def str10_mask(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.masked(F.col("text"), F.lit(10), F.lit(30)).alias("text"))


@query("""with g as (select c_custkey, list_distinct(list_transform(generate_series(1, length(c_mktsegment) - 1), lambda i: substr(c_mktsegment, i, 2))) as g from customer)
select c_custkey, len(g)::int as grams, len(list_intersect(g, ['HO', 'US', 'SE', 'EH', 'OL', 'LD']))::int as shared from g""")
def str11_ngrams(spark, d):
    g = T.char_grams(F.col("c_mktsegment"), 2)
    return table(spark, d, "customer").select("c_custkey", F.size(g).alias("grams"), F.size(F.array_intersect(g, F.array(*[F.lit(x) for x in ("HO", "US", "SE", "EH", "OL", "LD")]))).alias("shared"))


#: Titles, what is said of them, and the rank that they stand for.
RANKED = (
    ("Associate Director", "owns a team", "below_director_or_ic"), ("Site Quality Head", "owns site quality", "director_plus"), ("Head, TCO", "owns the function", "director_plus"), ("算法经理", "向总经理汇报并跨部门协作", "below_director_or_ic"),
    ("Assistant Head of Quality", "owns quality", "below_director_or_ic"), ("MVP Product Manager", "owns the roadmap", "unknown"), ("Head of Quality", "advises the team", "unknown"), ("Deputy VP", "owns sales", "below_director_or_ic"),
    ("VP Assistant", "supports sales", "below_director_or_ic"), ("SVP, Operations", "owns operations", "director_plus"), ("General Manager, Greater China", "", "director_plus"), ("发射技术中心主任", "全面负责中心团队", "director_plus"),
    ("发射技术中心副主任", "", "below_director_or_ic"), ("中心主任助理", "", "below_director_or_ic"), ("销售总监储备", "", "below_director_or_ic"), ("销售经理/总监", "", "below_director_or_ic"),
    ("首席科学家", "团队搭建，预算", "director_plus"), ("首席科学家", "团队搭建", "unknown"), ("Principal Engineer", "", "below_director_or_ic"), ("Overhead crane driver", "", "unknown"),
)


@query("select c_custkey, (" + repr([r[2] for r in RANKED]) + ")[(c_custkey % " + str(len(RANKED)) + " + 1)::int] as level from customer")
def str13_seniority(spark, d):
    pick = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in RANKED]), (F.col("c_custkey") % len(RANKED) + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", T.seniority(pick(0), pick(1)).alias("level"))


@query("""select doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') as word, contains(lower(text), 'tion') as part from documents""")
def str15_term_match(spark, d):
    return table(spark, d, "documents").select("doc_id", T.term_found(F.col("text"), "the").alias("word"), F.contains(F.lower("text"), F.lit("tion")).alias("part"))


@query("""with k as (select * from (values ('small', 'size'), ('big', 'size'), ('red', 'color'), ('blue', 'color'), ('widget', 'kind'), ('gear', 'kind')) t(term, family)),
w as (select p_partkey, p_name, p_type, ' ' || regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') || ' ' as t, ' ' || regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g') || ' ' as b from part),
h as (select p_partkey, family, sum(contains(t, ' ' || term || ' ')::int) as n, sum(contains(b, ' ' || term || ' ')::int) as m from w, k group by 1, 2),
f as (select p_partkey, arg_max(family, (n, family)) as one, max(n) as n, arg_max(family, (m, family)) as two, max(m) as m from h group by 1)
select p_partkey, case when contains(lower(p_name), 'nut') then 'fastener' when n > 0 then one when m > 0 then two else 'other' end as family from f join w using (p_partkey)""")
def str16_role_family(spark, d):
    terms = {"size": ("small", "big"), "color": ("red", "blue"), "kind": ("widget", "gear")}
    return table(spark, d, "part").select("p_partkey", U.role_family(F.col("p_name"), F.col("p_type"), terms, [("nut", "fastener")]).alias("family"))


#: Texts, and the event and phase that they tell.
TOLD = (
    ("公司任命新的中国区总裁", "executive_change", "build_organize"), ("刘某加入公司担任中国区总经理", "executive_change", "build_organize"), ("The board named Jane Doe CEO", "executive_change", "build_organize"), ("公司加入产业生态联盟", "other", "build_organize"),
    ("完成对目标公司的控股权收购", "merger_acquisition", "strategy_capital"), ("双方成立合资公司独立运营", "joint_venture_or_spinout", "build_organize"), ("正式启动上市辅导", "ipo_or_listing", "strategy_capital"), ("新设华东区域总部", "new_site_or_entity", "build_organize"),
    ("新产线正式投产", "factory_or_capacity", "strategy_capital"), ("重点项目开工", "project_buildout", "strategy_capital"), ("场景征集", "project_call", "build_organize"), ("取得施工许可", "eia_or_permit", "strategy_capital"),
    ("发布采购意向，预算金额一亿元", "procurement_intention", "strategy_capital"), ("竞争性磋商", "procurement_tender", "strategy_capital"), ("公司中标", "major_order", "strategy_capital"), ("产品通过头部客户验证", "customer_validation", "build_organize"),
    ("Acme RAISED a seed round", "funding", "strategy_capital"), ("进入东南亚市场", "global_expansion", "build_organize"), ("启动全国经销商渠道体系", "channel_expansion", "build_organize"), ("新品亮相", "technical_milestone", "build_organize"),
    ("自研大模型", "data_or_model", "build_organize"), ("获得医疗器械注册证", "regulatory_or_clinical", "build_organize"), ("与高校成立联合研究中心", "research_or_ip", "build_organize"), ("集团 MES 改造", "enterprise_system", "build_organize"),
    ("签署合作", "partnership", "build_organize"), ("牵头国家标准", "policy_or_standard", "build_organize"), ("新工厂招聘机械工程师和软件专家", "workforce_cluster", "build_organize"), ("新工厂招聘", "job_ad", "recruit"),
    ("关闭工厂并削减产能", "other", "ignore"), ("funding round cancelled", "other", "ignore"), ("nothing of the kind", "other", "build_organize"),
)


@query("select event_id, (" + repr([t[1] for t in TOLD]) + ")[i] as event_type, (" + repr([t[2] for t in TOLD]) + ")[i] as phase from (select event_id, (event_id % " + str(len(TOLD)) + " + 1)::int as i from events)")
def str18_signal(spark, d):
    text = F.element_at(F.array(*[F.lit(t[0]) for t in TOLD]), (F.col("event_id") % len(TOLD) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.signal(text).alias("s")).select("event_id", "s.event_type", "s.phase")


@query("select event_id, case event_id % 3 when 0 then 'funding' when 1 then 'executive_change' else event_type end as kind from events")
def str19_canonical_event_type(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "financing").when(F.col("event_id") % 3 == 1, " leadership ").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", T.canonical_event_type(kind).alias("kind"))


@query("""select page_id, case when regexp_matches(h, '(^|\\.)example\\.org$') then 'A' when regexp_matches(h, '(^|\\.)example\\.net$') then 'B' else 'C' end as grade from (select page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) as h from pages)""".replace("\\\\", "\\"))
def str20_source_grade(spark, d):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, d, "pages").select("page_id", T.source_grade(host, ("example.org",), ("example.net",)).alias("grade"))


@query(r"select doc_id, array_to_string(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{6,9}\b')), ',') <> '' as named, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{6,9}\b')))::int as n from documents")
def str21_extract_names(spark, d):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{6,9}(?![A-Za-z0-9_])"), F.lit(0)))
    return table(spark, d, "documents").select("doc_id", (F.size(found) > 0).alias("named"), F.size(found).alias("n"))


@query("select p_partkey, array_to_string(list_filter(['hot', 'metal', 'round'], lambda x: (x = 'hot' and contains(p_name, 'hot')) or (x = 'metal' and regexp_matches(p_name, 'bolt|nut|gear')) or (x = 'round' and regexp_matches(p_name, 'ring|rod'))), ',') as tags from part")
def str22_industry_tags(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.tags(F.col("p_name"), {"hot": "hot", "metal": "bolt|nut|gear", "round": "ring|rod"}), ",").alias("tags"))


@query("""select p_partkey, ([chr((65 + p_size % 6)::int) || '轮', chr((65 + p_size % 6)::int) || '++轮', 'Pre-' || chr((65 + p_size % 6)::int), 'Pre-IPO', '战略融资', '', '', '种子轮'])[(p_partkey % 8 + 1)::int] as round from part""")
def str24_round(spark, d):
    letter = F.char(65 + F.col("p_size") % 6)
    said = F.array(F.concat(letter, F.lit("轮（首期）")), F.concat(F.lit(" "), letter, F.lit("++ ")), F.concat(F.lit("Pre-"), letter, F.lit("轮")), F.lit("pre ipo轮融资"), F.lit("战略轮"), F.lit("未披露"), F.lit("新一轮融资"), F.lit("种子轮"))
    return table(spark, d, "part").select("p_partkey", U.normal_round(F.element_at(said, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("round"))


@query("""with h as (select c_custkey, c_custkey % 2 = 0 as named, c_custkey % 3 = 0 as ranked, c_custkey % 5 = 0 as recruits, c_custkey % 7 = 0 as paper, case c_custkey % 4 when 0 then date '2024-03-01' when 1 then date '2024-01-01' when 2 then null else date '2024-02-28' end as day from customer)
select c_custkey, named::int * 3 + ranked::int * 3 + 2 + recruits::int + (day is not null)::int - (not coalesce(day > date '2024-01-01' and day < date '2024-03-01', false))::int * 4 - paper::int * 5 as score,
  case when paper then 'low' when coalesce(day > date '2024-01-01' and day < date '2024-03-01', false) and named and ranked then 'high' else 'low' end as priority from h""")
def str30_triage_score(spark, d):
    k = F.col("c_custkey")
    pick = lambda n, yes, no="": F.when(k % n == 0, yes).otherwise(no)
    title = F.concat(pick(2, "Acme "), pick(3, "Director "), pick(7, "论文 "), F.lit("job"))
    url = F.concat(F.lit("https://"), pick(5, "jobs.example.org", "example.org"), F.lit("/job/1"))
    day = F.when(k % 4 == 0, "2024-03-01").when(k % 4 == 1, "2024年1月1日").when(k % 4 == 3, "20240228")
    names = U.company_aliases(F.lit("Acme Robotics (中国)"), F.array().cast("array<string>"))
    hit = U.triage(names, F.lit("x after:2024-01-01 before:2024-03-01"), title, F.lit("career"), url, day)
    return table(spark, d, "customer").select("c_custkey", hit.alias("t")).select("c_custkey", "t.score", "t.priority")


@query("""with x as (select c_custkey, (c_custkey % 6)::int as k from customer) select c_custkey, unnest(list_concat(['Custome', 'r#' || lpad(c_custkey::varchar, 5, '0')[:5], 'abcd' || repeat('é', least(k, 1))],
  list_transform(generate_series(0, greatest(ceil((k - 1) / 3.0), 0)::int - 1), lambda j: repeat('é', least(3, k - 1 - 3 * j)::int)))) as part from x""")
def str31_byte_parts(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit("Customer#"), F.substring(F.lpad(k.cast("string"), F.greatest(F.length(k.cast("string")), F.lit(5)), F.lit("0")), 1, 5), F.lit("abcd"), F.repeat(F.lit("é"), (k % 6).cast("int")))
    return table(spark, d, "customer").select("c_custkey", F.explode(T.byte_parts(text, 7)).alias("part"))


@query(r"""select page_id, case when host in ('example.org', 'www.example.org') then 'https://example.org' || rtrim(path, '/') else url end as url,
  case page_id % 6 when 0 then '2024-02-03' when 1 then '2024-02-03T07:00:00+08:00' when 2 then '2024-02-03T11:30:00+08:00' when 3 then '2024-02-02' when 4 then '2024-02-01' else '' end as published
from (select page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from pages)""")
def str32_site_forms(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("2024-02-03", "5小时前", " 30 分钟前", "昨天", "前天", "刚刚")]), (F.col("page_id") % 6 + 1).cast("int"))
    now = F.to_timestamp(F.lit("2024-02-03 04:00:00"))
    return table(spark, d, "pages").select("page_id", U.site_url(F.col("url"), ("example.org", "www.example.org"), "https://example.org").alias("url"), U.site_date(said, now).alias("published"))


@query("select o_orderkey, (o_orderdate::date + 7)::date as expires from orders")
def dt13_draft_expiry(spark, d):
    return table(spark, d, "orders").select("o_orderkey", U.expiry(F.col("o_orderdate")).alias("expires"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as at from orders")
def dt1_utc_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query("""select o_orderkey, case when o_orderkey % 4 = 3 then null else make_date(2000 + (o_orderkey % 20)::int, 1 + (o_orderkey % 12)::int, case when o_orderkey % 4 = 1 then 1 else 1 + (o_orderkey % 28)::int end)::varchar end as day from orders""")
def dt2_lenient_date(spark, d):
    k = F.col("o_orderkey")
    y, m, day = (2000 + k % 20).cast("string"), (1 + k % 12).cast("string"), (1 + k % 28).cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("on "), y, F.lit("-"), m, F.lit("-"), day)).when(k % 4 == 1, F.concat(y, F.lit("/"), m)).when(k % 4 == 2, F.concat(y, F.lit("年"), m, F.lit("月"), day, F.lit("日"))).otherwise("no date")
    return table(spark, d, "orders").select("o_orderkey", D.lenient_date(text).cast("string").alias("day"))


@query("select strftime(ts, '%Y-%m') as month, count(*) as n from events group by 1")
def dt4_month_bucket(spark, d):
    return table(spark, d, "events").groupBy(D.month_bucket(F.col("ts")).alias("month")).agg(F.count("*").alias("n"))


@query("select o_orderkey, (o_orderdate + interval 3 month)::date as shifted, last_day(o_orderdate) as month_end, last_day((date_trunc('month', o_orderdate) - interval 2 month)::date) as before from orders")
def dt5_month_arithmetic(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", D.shifted_months(day, 3).alias("shifted"), D.month_end(day).alias("month_end"), D.month_end(day, -2).alias("before"))


@query("select l_orderkey, l_linenumber, abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400e6 as days from lineitem join orders on l_orderkey = o_orderkey")
def dt7_days_apart(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", D.days_apart(F.col("l_shipdate"), F.col("o_orderdate")).alias("days"))


@query("select event_id, (case event_id % 4 when 0 then date '2024-01-31' - (event_id % 9)::int when 1 then date '2024-01-31' - 7 * (event_id % 9)::int when 2 then date '2024-01-31' - 30 * (event_id % 9)::int end)::varchar as day from events")
def dt8_relative_date(spark, d):
    k = F.col("event_id")
    unit = F.element_at(F.array(*[F.lit(x) for x in (" days ago", " weeks ago", " months ago", " moons")]), (k % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", D.relative_date(F.concat((k % 9).cast("string"), unit), F.lit(DAY).cast("date")).cast("string").alias("day"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 'undated' when date_diff('day', o_orderdate::date, date '2001-08-01') between 0 and 90 then '0-90' when date_diff('day', o_orderdate::date, date '2001-08-01') between 91 and 180 then '91-180' end as bucket from orders")
def dt9_age_bucket(spark, d):
    day = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", D.age_bucket(day, F.lit("2001-08-01").cast("date")).alias("bucket"))


@query("select (ts + interval 8 hour)::date as day, count(*) as n, round(sum(value), 4) as spent from events group by 1")
def dt11_billing_day(spark, d):
    return table(spark, d, "events").groupBy(D.billing_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("spent"))


@query("select o_orderkey, (o_orderdate - interval 30 day)::date as after, o_orderdate::date as before, (o_orderdate + interval 7 day)::date as expires from orders")
def dt12_query_window(spark, d):
    day = F.col("o_orderdate").cast("date")
    text = F.concat(F.lit("jobs after:"), F.date_sub(day, 30).cast("string"), F.lit(" before:"), day.cast("string"))
    return table(spark, d, "orders").select("o_orderkey", D.query_window(text).alias("w"), F.date_add(day, 7).alias("expires")).select("o_orderkey", "w.after", "w.before", "expires")


@query("select event_id, round((('0x' || substr(sha256(event_id::varchar), 1, 8))::bigint / 4294967295.0 * 2 - 1) * 0.1, 9) as jitter from events")
def math_jitter(spark, d):
    return table(spark, d, "events").select("event_id", F.round(D.jitter(F.col("event_id").cast("string"), 0.1), 9).alias("jitter"))


@query("""select event_id, case when event_id % 2 = 0 then '{"a":"' || event_type || '","k":' || (props->>'k') || '}' else '{"k":' || (props->>'k') || '}' end as json from events""")
def jsn1_canonical_json(spark, d):
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{ "k": '), k, F.lit(', "a": "'), "event_type", F.lit('" }'))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", M.canonical_json(raw).alias("json"))


@query("""select event_id, case when event_id % 3 = 0 then 'old' else event_type end as kind, (event_id % 7)::varchar as stage from events""")
def jsn3_merge_slots(spark, d):
    k = F.col("event_id")
    old = F.when(k % 3 == 0, F.create_map(F.lit("kind"), F.lit("old"))).otherwise(F.create_map(F.lit("stage"), (k % 7).cast("string")))
    new = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("stage"), (k % 7).cast("string"))
    m = M.merged_slots(old, new)
    return table(spark, d, "events").select("event_id", F.element_at(m, "kind").alias("kind"), F.element_at(m, "stage").alias("stage"))


@query("""select event_id, case when event_id % 2 = 0 then event_id % 5 = event_id % 3 else event_id % 11 <= 7 end as same from events""")
def jsn4_slots_compatible(spark, d):
    k = F.col("event_id")
    old = F.when(k % 2 == 0, F.create_map(F.lit("round"), (k % 5).cast("string"))).otherwise(F.create_map(F.lit("x"), F.lit("1")))
    new = F.when(k % 2 == 0, F.create_map(F.lit("round"), (k % 3).cast("string"))).otherwise(F.create_map(F.lit("y"), F.lit("1")))
    return table(spark, d, "events").select("event_id", M.slots_compatible(old, new, (k % 11).cast("double"), F.lit(45.0)).alias("same"))


@query("select event_id, '{\"k\":' || (props->>'k') || '}' as found from events")
def jsn5_objects_in_text(spark, d):
    text = F.concat(F.lit("model said {oops "), "props", F.lit(" and no more}"))
    return table(spark, d, "events").select("event_id", M.json_objects(text).alias("f")).select("event_id", F.element_at("f", 1).alias("found"))


@query("select event_id, case when event_id % 2 = 0 then event_type else 'x' end as first from events")
def jsn7_first_nonempty(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["", null, "'), "event_type", F.lit('", "z"]'))).otherwise('["x"]')
    return table(spark, d, "events").select("event_id", M.first_in_json_array(raw).alias("first"))


@query("select event_id, props->>'k' as k, (event_id % 10)::varchar as deep from events")
def jsn8_dotted_path(spark, d):
    nested = F.concat(F.lit('{"a": {"b": {"c": '), (F.col("event_id") % 10).cast("string"), F.lit("}}}"))
    return table(spark, d, "events").select("event_id", M.dotted(F.col("props"), "k").alias("k"), M.dotted(nested, "a.b.c").alias("deep"))


@query(r"""with s as (select doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?。！？；\n])', '\1' || chr(1), 'g'), chr(1))) as t from documents)
select doc_id, sum(ceil(length(t) / 5000.0))::bigint as units, sum(length(t))::bigint as chars from s where t <> '' group by 1""")
def ext9_units(spark, d):
    return _unit_sums(table(spark, d, "documents"))


def _unit_sums(docs):
    return X.units(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("units"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query(r"""select doc_id, case when length(text) = 0 then 'empty' when len(regexp_extract_all(text, '(?m)^#+ ')) >= 2 then 'report' when len(regexp_extract_all(text, '(?m)^[\t\n\v\f\r ]*[-*•]')) >= 3 then 'digest' when length(text) < 200 then 'flash' when length(text) > 8000 or len(regexp_extract_all(text, '\n')) + 1 > 60 then 'long' else 'article' end as kind from documents""")
def ext7_route(spark, d):
    return table(spark, d, "documents").select("doc_id", X.route(F.col("text")).alias("r")).select("doc_id", "r.kind")


@query(r"""with u as (select item_id, unnest(string_split_regex(regexp_replace(text, '([.!?。！？；\n])', '\1' || chr(1), 'g'), chr(1))) as t from benchmark)
select item_id, k as kind, count(*) as n from u join (values ('then', '(?i)\bth'), ('ing', 'ing\b'), ('er', 'er[ ,.]')) p(k, re) on regexp_matches(t, re) group by 1, 2""")
def ext11_recall_candidates(spark, d):
    u = X.units(table(spark, d, "benchmark"), "item_id", "text")
    c = X.candidates(u, "item_id", "text", [("then", r"(?i)\bth"), ("ing", r"ing\b"), ("er", r"er[ ,.]")])
    return c.groupBy("item_id", "kind").agg(F.count("*").alias("n"))


@query("""with s as (select l_orderkey, l_linenumber, l_quantity as a, l_quantity + l_partkey % 20 as b from lineitem), o as (select *, row_number() over (partition by l_orderkey order by a, b desc, l_linenumber) as r from s)
select x.l_orderkey, x.a, x.b from o x where not exists (select 1 from o y where y.l_orderkey = x.l_orderkey and (y.a < x.a or (y.a = x.a and y.b > x.b) or (y.a = x.a and y.b = x.b and y.r < x.r)) and y.b >= x.b)""")
def ext16_suppress_nested(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("a"), (F.col("l_quantity") + F.col("l_partkey") % 20).alias("b"))
    return X.suppress_nested(li, ["l_orderkey"], "a", "b")


@query("select l_orderkey, l_linenumber, l_partkey, floor((row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1) / 3)::bigint as batch from lineitem")
def ext17_claim_batches(spark, d):
    return X.batches(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber", "l_partkey"], 3)


@query("""with r as (select user_id, event_type, ts::date as day, event_id, value, row_number() over (partition by user_id, event_type, ts::date order by value desc, event_id) as k from events)
select user_id, event_type, day, max(case when k = 1 then event_id end) as event_id, string_agg(event_id::varchar, ',' order by value desc, event_id) as refs from r group by 1, 2, 3""")
def ext20_merge_events(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"), "event_id", "value", F.array(F.col("event_id").cast("string")).alias("refs"))
    out = X.merge_events(e, ["user_id", "event_type", "day"], [-F.col("value"), F.col("event_id")], ["refs"])
    return out.select("user_id", "event_type", "day", "event_id", F.array_join("refs", ",").alias("refs"))


@query("""select user_id, event_type from (select distinct user_id, event_type from events where value > 60) union select user_id, 'seed' from events where user_id % 10 = 0 and user_id not in (select user_id from events where value > 60 and event_type = 'seed')""")
def ext21_preserve_seeds(spark, d):
    e = table(spark, d, "events")
    out = e.where("value > 60").select("user_id", "event_type").distinct()
    seeds = e.where("user_id % 10 = 0").select("user_id", F.lit("seed").alias("event_type")).distinct()
    return out.unionByName(seeds.join(out, ["user_id", "event_type"], "left_anti"))


@query()
def ext26_greedy_themes(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.split("p_name", " ").alias("words"))
    return X.greedy_themes(p, "p_brand", "p_partkey", "words", 0.5)


@query()
def gr1_components(spark, d):
    return G.components(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("""with recursive e as (select c_custkey as a, c_custkey // 2 as b from customer where c_custkey % 7 <> 0), s as (select a, b from e union select b, a from e),
r as (select a as node, a as reach from s union select r.node, s.b from r join s on r.reach = s.a) select node, min(least(node, reach)) as component from r group by 1""")
def gr2_merge_components(spark, d):
    e = table(spark, d, "customer").where("c_custkey % 7 != 0").select(F.col("c_custkey").alias("a"), F.floor(F.col("c_custkey") / 2).alias("b"))
    return G.components(e, "a", "b")


@query("""with v as (select c_nationkey as component, c_mktsegment as name, count(*) as votes from customer group by 1, 2)
select component, arg_min(name, (not suffix(name, 'Y'), -votes, -length(name), name)) as canonical, sum(votes)::bigint as votes from v group by 1""")
def gr3_canonical_names(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("component"), F.col("c_mktsegment").alias("name"))
    return G.canonical_names(c, "component", "name", ("Y",))


@query("""select user_id, case when new_items > 0 then 0.75 when parsed = 0 then 2.0 when dup >= 0.9 then 1.75 when dup >= 0.5 then 1.25 else 1.0 end::double as multiplier,
greatest(300.0, least(604800.0, 3600.0 * pow(2.0, fails - 1)))::double as backoff, case when fails >= 20 then 'open' else 'closed' end as circuit
from (select user_id, count(*) filter (where value > 300) as new_items, count(*) filter (where value > 1) as parsed, count(*) filter (where event_type = 'view') / count(*) as dup, count(*) filter (where event_type = 'error') as fails from events group by 1)""")
def st6_adaptive_schedule(spark, d):
    kind = F.col("event_type")
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 300).alias("new_items"), F.count_if(F.col("value") > 1).alias("parsed"), (F.count_if(kind == "view") / F.count("*")).alias("dup"), F.count_if(kind == "error").alias("fails"))
    c = F.col
    return g.select("user_id", Z.success_multiplier(c("new_items"), c("parsed"), c("dup")).alias("multiplier"), Z.failure_interval(F.lit(3600.0), c("fails")).alias("backoff"), Z.circuit(c("fails"), 20).alias("circuit"))


@query("""select event_id, (event_id % 7 = 0) or (date_diff('second', ts, timestamp '2024-01-20 12:00:00') / 3600.0 between 0 and 48 and event_id % 24 >= 12) as recheck from (select event_id, date_trunc('second', ts) as ts from events)""")
def st2_freshness_recheck(spark, d):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    fetched = now - F.make_dt_interval(hours=(F.col("event_id") % 24).cast("int"))
    e = table(spark, d, "events").withColumn("ts", F.date_trunc("second", "ts"))
    return e.select("event_id", Z.needs_recheck(F.col("ts"), fetched, F.col("event_id") % 7 != 0, now).alias("recheck"))


@query("""select o_orderkey, case when o_orderstatus = 'O' and o_orderpriority < '3' then 'approved' when o_orderstatus = 'P' and o_orderpriority < '3' then 'published' end as next from orders""")
def st12_state_machine(spark, d):
    move = {("O", "approve"): "approved", ("P", "approve"): "published"}
    action = F.when(F.col("o_orderpriority") < "3", "approve").otherwise("wait")
    return table(spark, d, "orders").select("o_orderkey", Z.transition(F.col("o_orderstatus"), action, move).alias("next"))


@query("select o_orderkey, case when o_orderstatus = 'O' and o_orderdate::date + 7 < date '2000-01-01' then 'expired' when o_orderstatus = 'O' then 'draft' else 'done' end as state from orders")
def st13_expiry(spark, d):
    state = F.when(F.col("o_orderstatus") == "O", "draft").otherwise("done")
    return table(spark, d, "orders").select("o_orderkey", Z.expired(state, F.date_add(F.col("o_orderdate").cast("date"), 7), F.lit("2000-01-01").cast("date")).alias("state"))


@query("select doc_id, case when doc_id % 6 = 2 or doc_id % 5 = 1 then 'run' else 'reuse' end as action from documents")
def st8_stage_cache(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    stored = docs.where("doc_id % 5 != 1").select("doc_id", F.when(F.col("doc_id") % 6 == 2, F.lit("other")).otherwise(F.col("h")).alias("h"))
    return Z.stage_cache(stored, docs, "doc_id", "h")


@query("select o_custkey as k, case when min(o_orderstatus) = max(o_orderstatus) then 'same' else 'conflict' end as state, count(*) as tries from orders group by 1")
def st9_idempotency(spark, d):
    return Z.idempotent(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus"), "k", "o_orderstatus")


@query("""select 'quiet' as rule, user_id as subject, 'warning' as severity from events group by user_id having max(ts) < timestamp '2024-01-30' union all
select 'errors', user_id, 'critical' from events group by user_id having count(*) filter (where event_type = 'error') * 4 > count(*)""")
def st15_monitoring_issues(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.count_if(F.col("event_type") == "error").alias("bad"), F.count("*").alias("n"))
    rule = lambda name, cond, sev: g.where(cond).select(F.lit(name).alias("rule"), F.col("user_id").alias("subject"), F.lit(sev).alias("severity"))
    return Z.issues(rule("quiet", F.col("last") < F.lit("2024-01-30").cast("timestamp_ntz"), "warning"), rule("errors", F.col("bad") * 4 > F.col("n"), "critical"))


@query("select event_id, date_diff('day', ts::date, date '2024-02-20') <= 30 as valid from events")
def st16_cache_age(spark, d):
    return table(spark, d, "events").select("event_id", (F.datediff(F.lit("2024-02-20").cast("date"), F.col("ts").cast("date")) <= 30).alias("valid"))
