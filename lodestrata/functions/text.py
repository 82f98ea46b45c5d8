"""Column functions on text: identity, normalisation, similarity, rules."""

from __future__ import annotations

import re
import unicodedata
import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track a visitor (besides utm_*).
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "spm", "from", "from_source", "ref", "referrer", "source")
#: Event types in the order in which they are tried, their phase, words for them (in
#: either case), and their older names.
SIGNALS = (
    ("executive_change", "build_organize", r"任命|履新|接任|升任|新任|换帅|人事调整|出任|调任|(?:加盟|加入).{0,18}(?:董事长|总裁|副总裁|总经理|CEO|CTO|COO|首席|董事|总监)|appointed|joins? as|named .{0,30}(?:ceo|cto|coo|president|general manager|vice president|managing director)", ("leadership",)),
    ("merger_acquisition", "strategy_capital", r"并购|收购|控股权|控制权变更|要约收购|acquisition|acquires?|merger", ("m_and_a", "change_of_control")),
    ("joint_venture_or_spinout", "build_organize", r"合资公司|成立合资|分拆|拆分|独立运营|spin[- ]?off|joint venture", ("joint_venture", "spinout")),
    ("ipo_or_listing", "strategy_capital", r"上市辅导|辅导备案|递交招股书|申报上市|启动上市|ipo|initial public offering", ("listing_preparation",)),
    ("new_site_or_entity", "build_organize", r"区域总部|新设子公司|成立子公司|新事业部|第二总部|研发中心|运营中心|落户", ("new_subsidiary", "regional_hq", "new_business_unit")),
    ("factory_or_capacity", "strategy_capital", r"工厂|基地|产线|扩产|产能|设备入场|量产|投产|制造中心", ("capacity_expansion", "mass_production")),
    ("project_buildout", "strategy_capital", r"项目启动|项目开工|建设项目|项目落地|竣工|投运|装置建成", ("project_approval",)),
    ("project_call", "build_organize", r"项目征集|揭榜挂帅|场景征集|供应商征集|申报通知|项目申报|project call", ("pilot_program", "supplier_call")),
    ("eia_or_permit", "strategy_capital", r"环境影响|环评|拟审查|建设项目受理|用地获批|施工许可|批复", ("land_or_environment",)),
    ("procurement_intention", "strategy_capital", r"采购意向|拟采购|预算金额|采购预算|计划采购", ()),
    ("procurement_tender", "strategy_capital", r"公开招标|招标公告|采购公告|竞争性磋商|竞争性谈判", ()),
    ("major_order", "strategy_capital", r"重大订单|亿元订单|中标|定点|供应商|框架合同|采购合同|批量订单", ("award_or_supplier", "contract_award")),
    ("customer_validation", "build_organize", r"客户验证|通过验证|供应商认证|准入|首批交付|批量交付|复购", ("product_validation",)),
    ("funding", "strategy_capital", r"融资|增资|战略投资|入股|募资|funding|raises?|raised|venture round|seed round|series [a-f]", ("financing", "industrial_fund")),
    ("global_expansion", "build_organize", r"出海|海外市场|全球市场|国际化|进入.{0,20}市场|海外子公司|海外基地", ("market_expansion",)),
    ("channel_expansion", "build_organize", r"渠道体系|经销商|代理商|渠道伙伴|全国渠道|销售网络|服务网络", ()),
    ("technical_milestone", "build_organize", r"发布|首发|亮相|展示|技术突破|试验成功|样机|迭代|首飞|点火|试车|流片成功|验证成功", ("product_launch", "technology_milestone")),
    ("data_or_model", "build_organize", r"数据集|数据采集|大模型|vla|vtla|技能库|训练平台|数据平台", ()),
    ("regulatory_or_clinical", "build_organize", r"获批|注册证|临床试验|临床研究|受理|审评|审批|适航", ("regulatory_approval", "clinical_milestone")),
    ("research_or_ip", "build_organize", r"联合实验室|研究院|联合研究中心|专利授权|技术许可|知识产权|首席科学家", ("research_program", "technology_asset")),
    ("enterprise_system", "build_organize", r"\bERP\b|\bMES\b|\bPLM\b|\bCRM\b|数字化转型|信息化升级|系统上线", ("digital_transformation",)),
    ("partnership", "build_organize", r"战略合作|生态伙伴|合作协议|联合解决方案|签署合作", ()),
    ("policy_or_standard", "build_organize", r"牵头.{0,20}标准|参与制定.{0,20}标准|入选.{0,20}试点|示范名单", ()),
    ("workforce_cluster", "build_organize", r"(?:经理|专家|工程师).{0,20}(?:招聘|岗位|职位)|(?:招聘|岗位|职位).{0,20}(?:经理|专家|工程师)", ()),
    ("job_ad", "recruit", r"招聘|职位|岗位|加入我们", ()),
)
#: Told before all other events; and what ends an undertaking, which is no event.
RECRUITING = ("workforce_cluster", "job_ad")
ENDED = r"关闭|削减|终止|撤回|撤销|取消|暂停|停产|搁置|解散|破产|裁员|shutdown|cancel(?:led|ed)?|withdrawn?|terminated?|layoffs?"
#: Words of titles that tell a director or above; that do so with two words of scope; that
#: tell a rank below; the words of scope; and those of ownership, which a "head of" needs.
TARGET_TITLES = ("董事长", "首席执行官", "首席技术官", "首席运营官", "首席人力资源官", "总裁", "副总裁", "总经理", "事业部负责人", "事业部总经理", "基地负责人", "工厂负责人", "中心主任", "总监")
CONDITIONAL_TITLES = ("首席科学家", "chief scientist", "总师", "chief engineer", "负责人")
LOWER_TITLES = ("高级经理", "资深经理", "经理", "主管", "高级专家", "资深专家", "专家", "principal", "staff", "fellow", "individual contributor")
SCOPE = ("团队搭建", "组建团队", "团队管理", "预算", "p&l", "损益", "招聘决策", "绩效管理", "跨部门", "向ceo汇报", "向cto汇报", "向总经理汇报", "全面负责")
OWNERSHIP = ("负责", "全面负责", "团队管理", "预算", "p&l", "owns ", "own ", "leads ", "lead ", "accountable", "reports to")


def stable_id(prefix: str, *parts: Column, length: int = 32) -> Column:
    """prefix_ and the start of the sha256 of the parts, joined by 0x1f; null parts are empty."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, length))


def one_url(url: str | None) -> str:
    """A URL in the form in which equal pages are equal."""
    value = (url or "").strip()
    if not value:
        return ""
    try:
        u = urllib.parse.urlsplit(value)
        port = u.port
    except ValueError:
        return value
    host = (u.hostname or "").lower()
    try:
        host = host.encode("idna").decode("ascii")
    except UnicodeError:
        pass
    if port and port != {"http": 80, "https": 443}.get(u.scheme.lower()):
        host += f":{port}"
    if u.username:
        host = ":".join(urllib.parse.quote(x, safe="") for x in (u.username, u.password) if x) + "@" + host
    steps: list[str] = []
    for step in u.path.split("/"):
        if step == "..":
            steps[-1:] = []
        elif step not in ("", "."):
            steps.append(step)
    path = "/" + "/".join(steps) + ("/" if steps and u.path.endswith("/") else "")
    path = urllib.parse.quote(urllib.parse.unquote(path), safe="/:@!$&'()*+,;=-._~")
    kept = sorted(kv for kv in urllib.parse.parse_qsl(u.query, keep_blank_values=True) if not kv[0].lower().startswith("utm_") and kv[0].lower() not in TRACKING_KEYS)
    return urllib.parse.urlunsplit((u.scheme.lower(), host, path, urllib.parse.urlencode(kept), ""))


def _urls(url: pd.Series) -> pd.Series:
    return url.map(one_url)


def normalize_url(url: Column | str) -> Column:
    """one_url in Arrow batches."""
    return F.pandas_udf(_urls, "string")(url)


def plain_url(url: Column) -> Column:
    """normalize_url for URLs without ports, credentials, escapes or dot segments, inside the JVM."""
    at = F.instr(url, "://")
    scheme = F.lower(F.substring_index(url, "://", 1))
    rest = F.regexp_replace(F.substr(url, at + 3), r"#.*$", "")
    host, path = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/{2,}", "/")
    pairs = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).startswith("utm_") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING_KEYS))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


_NAME_MARKS = re.compile(r"[\s　·•・._\-—–/\\（）()【】\[\]「」“”\"'，,：:；;]+")


def one_name(name: str | None) -> str:
    return _NAME_MARKS.sub("", unicodedata.normalize("NFKC", name or "").casefold().strip())


def _names(name: pd.Series) -> pd.Series:
    return name.map(one_name)


def normalize_name(name: Column | str) -> Column:
    """NFKC, case folded, without separators and quotes: for lookup, not for merging."""
    return F.pandas_udf(_names, "string")(name)


def ascii_name(name: Column) -> Column:
    """normalize_name for ASCII names, inside the JVM."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[\s._\-/\\()\[\]\"',:;]+", "")


def canonical_title(title: Column) -> Column:
    """Letters, digits and underscores of any script, lower-cased."""
    return F.lower(F.regexp_replace(title, r"(?U)\W+", ""))


def compact(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_html(html: Column) -> Column:
    """Text of an HTML fragment: scripts, styles, comments and tags out, the five entities back."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(mark))
    return compact(bare)


def sentences(text: Column) -> Column:
    """Sentences up to and with their terminator, trimmed, none empty."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?。！？；\n])"), compact), lambda s: s != "")


def char_grams(text: Column, n: int) -> Column:
    """The distinct character n-grams; a shorter text is its own, an empty one has none. One regular
    expression finds them all; texts with characters outside the basic plane are cut one by one."""

    def grams(t: Column) -> Column:
        steps = F.sequence(F.lit(1), F.length(t) - n + 1)
        cut = F.when(t.rlike(r"[\x{10000}-\x{10FFFF}]"), F.transform(steps, lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= n, F.array(t)).otherwise(F.array_distinct(cut))

    return F.get(F.transform(F.array(text), grams), 0)  # so the text is computed once


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def signal(text: Column, workforce: bool = True) -> Column:
    """(event_type, phase) of a text: ended undertakings are no event, then recruiting (without
    `workforce` only plain advertisements), then the first other type in order that fits."""
    text = F.coalesce(text, F.lit(""))
    found = lambda pattern: text.rlike(f"(?iuU){pattern}")
    pair = lambda kind, phase: F.struct(F.lit(kind).alias("event_type"), F.lit(phase).alias("phase"))
    out = F.when(found(ENDED), pair("other", "ignore"))
    for early in (True, False):
        for kind, phase, pattern, _ in SIGNALS:
            if (kind in RECRUITING) == early and (workforce or kind != "workforce_cluster"):
                out = out.when(found(pattern), pair(kind, phase))
    return out.otherwise(pair("other", "build_organize"))


def canonical_event_type(kind: Column) -> Column:
    """The type that a name or an older name stands for; any other name as it is."""
    older = [F.lit(x) for name, _, _, names in SIGNALS for old in names for x in (old, name)]
    return F.coalesce(F.try_element_at(F.create_map(*older), F.trim(kind)), F.trim(kind), F.lit(""))


def scope_terms(title: Column, description: Column) -> Column:
    """The words of scope that a title or its description has, in order."""
    whole = F.lower(F.concat_ws(" ", F.trim(F.coalesce(title, F.lit(""))), F.coalesce(description, F.lit(""))))
    return F.array_compact(F.array(*[F.when(F.contains(whole, F.lit(t)), F.lit(t)) for t in SCOPE]))


def seniority(title: Column, description: Column | None = None) -> Column:
    """director_plus, below_director_or_ic or unknown, by ordered rules on a title; what its description
    owns decides for heads of something, and its words of scope for chief scientists and the like."""
    description = F.lit("") if description is None else F.coalesce(description, F.lit(""))
    t, about = F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lower(description)
    any_of = lambda text, terms: F.exists(F.array(*[F.lit(x) for x in terms]), lambda x: F.contains(text, x))
    senior = r"(?:director|head|vice\s+president|vp)"
    return (
        F.when(t.rlike(rf"(?U)\b(?:associate|assistant|deputy)\s+{senior}\b|\b{senior}\s+(?:assistant|deputy)\b"), "below_director_or_ic")
        .when(t.rlike("副主任|主任助理|副总监|总监助理|总监储备"), "below_director_or_ic")
        .when(t.rlike("(?:经理|专家).*(?:总监|负责人)|(?:总监|负责人).*(?:经理|专家)"), "below_director_or_ic")
        .when(any_of(t, TARGET_TITLES) | t.rlike(r"(?U)\b(?:director|vice\s+president|svp|evp|vp|cxo|general\s+manager)\b"), "director_plus")
        .when(t.rlike(r"(?U)(?<![a-z])head(?:\s+of|[\s,:/-]|$)"), F.when(any_of(about, OWNERSHIP), "director_plus").otherwise("unknown"))
        .when(any_of(t, CONDITIONAL_TITLES) & (F.size(scope_terms(title, description)) >= 2), "director_plus")
        .when(any_of(t, LOWER_TITLES), "below_director_or_ic")
        .otherwise("unknown")
    )


def term_found(text: Column, term: str) -> Column:
    """A term of ASCII letters needs a boundary on either side; any other is plain containment."""
    low = F.lower(text)
    if re.fullmatch(r"[\x00-\x7f]+", term):
        return low.rlike(f"(?<![a-z0-9]){re.escape(term.lower())}(?![a-z0-9])")
    return F.contains(low, F.lit(term.lower()))


def source_grade(host: Column, grade_a: tuple[str, ...], grade_b: tuple[str, ...]) -> Column:
    """A, B or C by the host's suffix."""
    under = lambda ends: F.lit(False) if not ends else F.lower(host).rlike("(^|\\.)(" + "|".join(re.escape(e) for e in ends) + ")$")
    return F.when(under(grade_a), "A").when(under(grade_b), "B").otherwise("C")


def scrubbed(text: Column, names: Column) -> Column:
    """The text with every name (longest first) put as ***."""
    longest = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, text, lambda acc, n: F.when(n == "", acc).otherwise(F.replace(acc, n, F.lit("***"))))


def tags(text: Column, rules: dict[str, str]) -> Column:
    """The labels whose pattern is found, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in rules.items()]))


def byte_parts(text: Column, most: int) -> Column:
    """The text in parts of at most `most` UTF-8 bytes, cut between characters, each as long as fits (a
    character of more bytes is a part of its own). An empty text is one part."""
    char = F.split(text, "")
    nothing = F.array().cast("array<struct<at:int,n:int,size:int>>")

    def step(cuts: Column, one: Column) -> Column:
        # The last part, and where it stands: it grows while it fits.
        last, size = F.element_at(cuts, -1), F.octet_length(one)
        grown = F.struct(last["at"].alias("at"), (last["n"] + 1).alias("n"), (last["size"] + size).alias("size"))
        fresh = F.struct((last["at"] + last["n"]).alias("at"), F.lit(1).alias("n"), size.alias("size"))
        fits = (last["n"] == 0) | (last["size"] + size <= most)
        return F.when(fits, F.concat(F.slice(cuts, 1, F.size(cuts) - 1), F.array(grown))).otherwise(F.concat(cuts, F.array(fresh)))

    start = F.array(F.struct(F.lit(1).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("size")))
    cuts = F.aggregate(F.when(F.octet_length(text) > most, char).otherwise(F.array().cast("array<string>")), F.concat(nothing, start), step)
    return F.when(F.octet_length(text) <= most, F.array(text)).otherwise(F.transform(cuts, lambda c: F.substring(text, c["at"], c["n"])))


def masked(text: Column, start: Column, end: Column) -> Column:
    """The text with [start, end) (code points) as spaces: other offsets stay."""
    size = F.greatest(F.least(end, F.length(text)) - start, F.lit(0)).cast("int")
    return F.concat(F.substring(text, F.lit(1), start.cast("int")), F.repeat(F.lit(" "), size), F.substr(text, (start + size + 1).cast("int")))
