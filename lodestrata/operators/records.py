"""Rows that leave the engine: leads for a board, links of drafts to leads, evidence of extracted events,
and the texts that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that make a company a foreign or a listed one.
FOREIGN = ("外企", "跨国公司", "中国区", "大中华区", "global", "china president", "中国有限公司")
LISTED = ("上市公司", "证券代码", "上交所", "深交所", "港交所", "科创板", "创业板", "annual report")
#: What each kind of event says of an organisation's needs, in the order in which it is
#: told, and what stands for none.
DRIVERS = (
    ("funding", "新增资本可支持组织扩张"),
    ("factory_or_capacity", "量产/产能建设要求建立制造与交付管理体系"),
    ("major_order", "订单和客户交付会放大供应链、质量与项目管理压力"),
    ("data_or_model", "数据和模型建设需要独立的平台型领导者"),
    ("global_expansion", "海外扩张需要区域业务与交付负责人"),
    ("partnership", "产业合作正在从技术验证转向规模化落地"),
)
NO_DRIVER = "多个上游事件正在形成新的组织责任"
#: The status of a lead that is new to the board.
NEW_LEAD = "待研究"


def archetype(context: Column) -> Column:
    """foreign, listed or startup_private, by the first kind of words that a text has."""
    low = F.lower(F.coalesce(context, F.lit("")))
    has = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))
    return F.when(has(FOREIGN), "foreign").when(has(LISTED), "listed").otherwise("startup_private")


def thesis(company: Column, direction: Column, kinds: Column, roles: Column) -> Column:
    """Why a company may hire: what its kinds of events say, three at most, and the roles that follow."""
    said = F.slice(F.array_compact(F.array(*[F.when(F.array_contains(kinds, k), F.lit(text)) for k, text in DRIVERS])), 1, 3)
    drivers = F.when(F.size(said) > 0, F.array_join(said, "；")).otherwise(NO_DRIVER)
    return F.concat(company, F.lit("在"), direction, F.lit("方向出现多源上游信号："), drivers, F.lit("。因此未来 30–90 天最可能新增或升级的领导岗位为："), F.array_join(roles, "、"), F.lit("。"))


def company_key(company: Column) -> Column:
    """A board's id of a company: its name's hash, whatever its case and white space."""
    return F.substring(F.sha2(F.lower(F.regexp_replace(company, r"(?U)\s+", "")).cast("binary"), 256), 1, 24)


def board_rows(leads: DataFrame) -> DataFrame:
    """Leads (company, direction, mode, score, grade, timing, roles, thesis, components: label, points and
    reason, links, research: a map) as rows of text for a board, all new."""
    parts = F.transform("components", lambda c: F.struct(c["label"].alias("项"), c["points"].alias("分"), c["reason"].alias("原因")))
    return leads.select(
        company_key(F.col("company")).alias("company_id"), "company", "direction", "mode", "score", "grade", "timing", F.array_join("roles", "、").alias("roles"), "thesis",
        F.to_json(parts).alias("components"), F.array_join("links", "\n").alias("links"), F.to_json("research").alias("research"), F.lit(NEW_LEAD).alias("status"),
    )


def opportunity_links(drafts: DataFrame, key: str, title: str, leads: str) -> DataFrame:
    """(key, company, role, urls) for every lead of a draft (`leads`: structs of company, roles and urls) and
    each of its roles; a lead without any has the draft's title; leads without a company have no link.
    A company and role that occur again replace the earlier one, so each occurs once, the last."""
    one = drafts.select(key, F.trim(F.coalesce(F.col(title), F.lit(""))).alias("__title"), F.posexplode(leads).alias("__at", "lead")).withColumn("company", F.trim(F.coalesce("lead.company", F.lit("")))).where("company != ''")
    named = F.filter(F.transform(F.coalesce("lead.roles", F.array().cast("array<string>")), lambda r: F.trim(r)), lambda r: r != "")
    rows = one.select(key, "company", "__at", F.coalesce("lead.urls", F.array().cast("array<string>")).alias("urls"), F.explode(F.when(F.size(named) > 0, named).otherwise(F.array("__title"))).alias("role"))
    return rows.groupBy(key, "company", "role").agg(F.max_by("urls", "__at").alias("urls"))


def event_evidence(events: DataFrame, *carried: str) -> DataFrame:
    """Extracted events (source_id, url, company, kind, day, round, status, summary, quotes) as evidence,
    with the columns `carried`: those of a known kind, with a company and a quote; ids are hashes of
    what they stand for."""
    known = events.where((F.col("kind") != "other") & (F.coalesce("company", F.lit("")) != "") & (F.size("quotes") > 0))
    hashed = lambda *parts: F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256)
    quote = F.element_at("quotes", 1)
    document = hashed(F.col("source_id"), F.col("url"))
    title = F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(F.substring(quote, 1, 180))
    return known.select(
        *carried, "company", "kind", "day", title.alias("title"), F.substring(quote, 1, 500).alias("snippet"), document.alias("document_id"), hashed(document, *[F.col(c) for c in ("company", "kind", "day", "round", "status")]).alias("event_id"),
        F.lower(F.regexp_extract("url", r"^[^:/?#]*://([^/?#]*)", 1)).alias("source_group"),
    )

