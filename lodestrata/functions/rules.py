"""Column functions for ordered rules on titles, rounds, search hits and site-bound URLs and dates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, term_found

#: What says that a round is not known, or is new and has no name; what is strategic.
NO_ROUND = ("未披露", "未明确", "未知", "不详", "新一轮", "新一轮融资")
STRATEGIC = ("战略轮", "战略融资")
#: How rounds and amounts are written; what before or after an amount makes it a valuation or
#: a figure of business; and what before it makes it the sum of all rounds.
ROUND = r"(Pre-IPO(?:轮)?|Pre-[A-Z](?:\+{1,2})?(?:轮)?|(?<![A-Z])[A-Z](?:\+{1,2})?轮|天使(?:\+{1,2})?轮|种子(?:\+{1,2})?轮|战略融资)"
AMOUNT = r"((?:近|超|逾|数)?\s*\d+(?:\.\d+)?\s*(?:万|千万|亿)\s*(?:元|美元|人民币)|(?:近|超|逾)?\s*(?:数千万元|数亿元|千万级|亿元级|千万元|亿元))"
VALUED_BEFORE, OTHER_AFTER = r"(?:估值|投前|投后).{0,6}$", r"(?:的)?(?:投前|投后)?估值|.{0,4}(?:订单|营收|利润|交付|小时)"
IN_ALL = r"总融资(?:规模|额|金额)?|累计(?:融资)?(?:额|金额)?|(?:\d+轮|多轮).{0,16}$"
#: Words of rank and of jobs in search hits, hosts that recruit, titles that are no job's.
RANK_TERMS = ("总监", "副总裁", "director", "head of", "vice president", " vp ")
JOB_TERMS = ("招聘", "职位", "岗位", "job", "career", "join us", "招募")
RECRUITING_HOSTS = ("liepin.com", "zhipin.com", "linkedin.com", "jobs.", "career.", "careers.")
NO_JOB_TITLES = ("管理层", "management team", "产品升级", "新版本发布", "app下载", "app store", "论文", "算法")
#: Words of rank that a role's key leaves out, words that it puts for others, and words of degree.
ROLE_WORDS = (
    ("副总裁|总裁|总经理|总监|主管|负责人|vp|head|director|chief|ceo|cto|coo", ""),
    ("具身智能机器人|人形机器人|四足机器人", "机器人"),
    ("批量化|规模化|批产", "量产"),
    ("商业闭环", "商业化"),
    ("战略|高级|资深", ""),
)
#: Parts of names that are no alias.
NO_ALIASES = ("中国", "group", "robotics")


def normal_round(value: Column) -> Column:
    """A funding round's name: empty if it is not known or only new, 战略融资 for strategic ones, Pre-IPO, a
    letter with its pluses as X轮 (Pre-X as it is), any other name trimmed."""
    v = F.trim(F.coalesce(value, F.lit("")))
    letter = r"^(Pre-)?([A-Z])(\+{0,2})(?:轮)?(?:（[^）]{1,30}）)?$"
    part = lambda i: F.regexp_extract(v, letter, i)
    lettered = F.concat(part(1), part(2), part(3), F.when(part(1) == "", "轮").otherwise(""))
    return F.when(v.isin(*NO_ROUND), "").when(v.rlike(r"(?i)^Pre[\s-]*IPO(?:轮)?(?:融资)?$"), "Pre-IPO").when(v.isin(*STRATEGIC), "战略融资").when(v.rlike(letter), lettered).otherwise(v)


def _family_by_terms(text: Column, families: Mapping[str, Sequence[str]]) -> Column:
    """The family of which most terms are found; of equals the last by name; other if none is."""
    hits = lambda terms: sum((term_found(text, t).cast("int") for t in terms), F.lit(0))
    best = F.array_max(F.array(*[F.struct(hits(terms).alias("n"), F.lit(name).alias("family")) for name, terms in families.items()]))
    return F.when(best["n"] > 0, best["family"]).otherwise("other")


def role_family(title: Column, description: Column, families: Mapping[str, Sequence[str]], overrides: Sequence[tuple[str, str]] = (), text_overrides: Sequence[tuple[str, str]] = ()) -> Column:
    """The family of a role: the first override (pattern, family) that its title fits, else by the terms of
    its title; where the title says nothing, the same from title and description."""
    t = F.lower(F.coalesce(title, F.lit("")))
    both = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))

    def decided(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
        out = F.when(F.lit(False), "other")
        for pattern, family in rules:
            out = out.when(text.rlike(f"(?U){pattern}"), family)
        return out.otherwise(_family_by_terms(text, families))

    first = decided(t, overrides)
    return F.when(first != "other", first).otherwise(decided(both, text_overrides))


def generic_title(title: Column) -> Column:
    """Whether a title names a rank and a field so wide that only the description tells the role."""
    bare = F.regexp_replace(title, r"[\s/_-]+", "")
    return bare.rlike(r"(?i)^(?:技术|研发|工程|业务|运营)(?:高级)?(?:副总裁|总经理|总监|负责人|head|director)$")


def role_key(title: Column, description: Column, families: Mapping[str, Sequence[str]], overrides: Sequence[tuple[str, str]] = (), text_overrides: Sequence[tuple[str, str]] = ()) -> Column:
    """family:core of a role, by which equal roles are one: the title without words of rank and of degree,
    with one word for like things, of letters and digits alone; a title of rank and field alone has
    the family of its description."""
    family = F.when(generic_title(title), role_family(F.lit(""), description, families, overrides, text_overrides)).otherwise(role_family(title, description, families, overrides, text_overrides))
    core = F.lower(title)
    for pattern, word in ROLE_WORDS:
        core = F.regexp_replace(core, pattern, word)
    core = F.regexp_replace(core, r"(?U)[\W_]+", "")
    return F.concat(family, F.lit(":"), F.when(core == "", "generic").otherwise(core))


def company_aliases(company: Column, supplied: Column) -> Column:
    """Names under which a company may be found, the longest first: its names and the supplied ones, cut at
    white space, slashes and brackets, and without what stands in brackets."""
    names = F.concat(F.array(company), F.coalesce(supplied, F.array().cast("array<string>")))
    cut = F.flatten(F.transform(names, lambda n: F.concat(F.split(n, r"[\s/（()）]+"), F.array(F.regexp_replace(n, r"[（(].*?[）)]", "")))))
    bare = F.transform(cut, lambda n: F.regexp_replace(compact(F.lower(n)), r"^[-_,，。]+|[-_,，。]+$", ""))
    fit = F.filter(F.array_distinct(bare), lambda n: (F.length(n) >= 2) & ~n.isin(*NO_ALIASES))
    longer = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(fit, longer)


def loose_date(value: Column) -> Column:
    """The first year, month and day in a text, two characters between them at most; null if there is none
    or it is no date."""
    rule = r"([0-9]{4})[^0-9]{0,2}([0-9]{1,2})[^0-9]{0,2}([0-9]{1,2})"
    part = lambda i, n: F.lpad(F.regexp_extract(value, rule, i), n, "0")
    return F.when(value.rlike(rule), F.try_to_timestamp(F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)), F.lit("yyyy-MM-dd")).cast("date"))


def query_window(query: Column) -> tuple[Column, Column]:
    """The dates of after: and before: in a search query; null where there is none."""
    day = lambda word: F.try_to_timestamp(F.nullif(F.regexp_extract(query, rf"\b{word}:([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    return day("after"), day("before")


def triage(aliases: Column, query: Column, title: Column, snippet: Column, url: Column, published: Column) -> Column:
    """A search hit's struct of score, priority, in_window and reasons (in order). Points: an alias or a
    rank found 3, a word of jobs 2, a recruiting host 1, a date 1; 4 less outside the query's window or
    without a date, 5 less for a title that is no job's."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    title_text, whole = compact(F.lower(blank(title))), compact(F.lower(F.concat_ws(" ", blank(title), blank(snippet))))
    first = lambda text, terms: F.element_at(F.filter(F.concat(terms, F.array(F.lit(None).cast("string"))), lambda t: t.isNull() | F.contains(text, t)), 1)
    fixed = lambda terms: F.array(*[F.lit(t) for t in terms])
    padded = lambda text: F.concat(F.lit(" "), text, F.lit(" "))
    company, in_title = first(whole, aliases), first(title_text, aliases)
    rank, title_rank = F.trim(first(padded(whole), fixed(RANK_TERMS))), first(padded(title_text), fixed(RANK_TERMS))
    job, no_job = first(whole, fixed(JOB_TERMS)), first(title_text, fixed(NO_JOB_TITLES))
    host = F.lower(F.regexp_extract(blank(url), r"^[^:/?#]*://([^/?#]*)", 1))
    path = F.lower(F.regexp_extract(blank(url), r"^[^:/?#]*://[^/?#]*([^?#]*)", 1))
    recruits = F.exists(fixed(RECRUITING_HOSTS), lambda h: F.contains(host, h))
    direct = F.contains(path, F.lit("/job/")) | F.contains(path, F.lit("/jobs/view/")) | path.rlike("/a/[0-9]+")
    day, (after, before) = loose_date(blank(published)), query_window(blank(query))
    inside = day.isNotNull() & ~F.coalesce(day <= after, F.lit(False)) & ~F.coalesce(day >= before, F.lit(False))
    told = [
        (company.isNotNull(), 3, F.concat(F.lit("company:"), company)),
        (rank.isNotNull(), 3, F.concat(F.lit("seniority:"), rank)),
        (job.isNotNull(), 2, F.concat(F.lit("job_context:"), job)),
        (recruits, 1, F.lit("recruiting_host")),
        (day.isNotNull(), 1, F.lit("parseable_publication_date")),
        (~inside, -4, F.lit("outside_or_missing_query_window")),
        (no_job.isNotNull(), -5, F.concat(F.lit("non_job_title:"), no_job)),
    ]
    score = sum((F.when(on, points).otherwise(0) for on, points, _ in told), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(on, why) for on, _, why in told]))
    high = inside & direct & in_title.isNotNull() & title_rank.isNotNull() & (job.isNotNull() | recruits)
    medium = inside & in_title.isNotNull() & rank.isNotNull() & recruits
    priority = F.when(no_job.isNotNull(), "low").when(high, "high").when(medium, "medium").otherwise("low")
    return F.struct(score.alias("score"), priority.alias("priority"), inside.alias("in_window"), reasons.alias("reasons"))


def site_url(url: Column, hosts: Sequence[str], base: str) -> Column:
    """A page of one of a site's hosts at its one base, without query and end slashes; others as they are."""
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(host.isin(*hosts), F.concat(F.lit(base), path)).otherwise(url)


def site_date(value: Column, now: Column, zone: str = "Asia/Shanghai") -> Column:
    """A listing's date as text: a day as it stands; hours or minutes ago as a moment in the site's zone;
    yesterday and the day before as days; empty for anything else. `now` is in UTC."""
    v, local = F.trim(F.coalesce(value, F.lit(""))), F.from_utc_timestamp(now, zone)
    ago = lambda unit: F.regexp_extract(v, rf"^([0-9]+)\s*{unit}前$", 1)
    moment = lambda n, seconds: F.date_format(F.timestamp_seconds(F.unix_timestamp(local) - n.cast("long") * seconds), "yyyy-MM-dd'T'HH:mm:ss'+08:00'")
    day = lambda n: F.date_format(F.date_sub(local.cast("date"), n), "yyyy-MM-dd")
    return F.when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), v).when(ago("小时") != "", moment(ago("小时"), 3600)).when(ago("分钟") != "", moment(ago("分钟"), 60)).when(v == "昨天", day(1)).when(v == "前天", day(2)).otherwise("")


def expiry(run_day: Column, days: int = 7) -> Column:
    """The last day on which a draft of a run can be reviewed."""
    return F.date_add(run_day.cast("date"), days)


def article_window(body: Column, title: Column, bulletin: Column, patterns: Mapping[str, str], window: int = 2000) -> Column:
    """What part of an article to read: a struct of mode, reason, chars and actions (in the window, and behind
    it). `patterns`: section (of a digest), bulletin_title, event, company_event, commentary_title,
    interview_title, interview_cue and action. Digests (said so, titled so, or of two sections) and short
    articles are read whole; of long ones the window, if it has an event (a company's, where the title
    is of commentary), else nothing."""
    b, t = F.coalesce(body, F.lit("")), F.coalesce(title, F.lit(""))
    head, tail = F.substring(b, 1, window), F.substr(b, F.lit(window + 1), F.length(b))
    count = lambda text, name: F.regexp_count(text, F.lit(patterns[name]))
    found = lambda text, name: text.rlike(patterns[name])
    sections = count(b, "section") >= 2
    digest = F.coalesce(bulletin, F.lit(False)) | found(t, "bulletin_title") | sections
    event = found(head, "event") & (~found(t, "commentary_title") | found(head, "company_event"))
    interview = found(t, "interview_title") | (count(head, "interview_cue") >= 2)
    mode = F.when(digest, "multi_event_digest").when(F.length(b) <= window, "full_short").when(event & interview, "interview_prefix").when(event, "single_event_expansion").otherwise("skip_low_value")
    reason = (
        F.when(digest & sections & ~F.coalesce(bulletin, F.lit(False)), "body_digest_structure").when(digest, "bulletin_or_digest_structure").when(F.length(b) <= window, "under_window_limit")
        .when(event & interview, "interview_lead_contains_event").when(event, "concrete_lead_event_followed_by_long_form").when(interview, "interview_or_commentary_without_concrete_lead_event").otherwise("no_concrete_event_in_lead_window")
    )
    chars = F.when(mode.isin("multi_event_digest", "full_short"), F.length(b)).when(mode == "skip_low_value", 0).otherwise(window)
    return F.struct(mode.alias("mode"), reason.alias("reason"), chars.alias("chars"), count(head, "action").alias("head_actions"), count(tail, "action").alias("tail_actions"))


def windowed_body(body: Column, decision: Column) -> Column:
    """The body with what is not read as spaces, so that offsets stay."""
    read = F.substr(body, F.lit(1), decision["chars"])
    return F.concat(read, F.repeat(F.lit(" "), F.length(body) - F.length(read)))


def one_funding(sentence: str, start: int, end: int, started: bool) -> tuple[str, str, str]:
    """The round, the amount and the sum of all rounds that a sentence gives for what it asserts between
    start and end: those nearest to its middle. Of a round that only begins, the last one named inside."""
    far = lambda m: abs((m.start() + m.end()) / 2 - (start + end) / 2)
    rounds = list(re.finditer(ROUND, sentence))
    inside = [m for m in rounds if start <= m.start() <= end] if started else []
    told = inside[-1] if inside else min(rounds, key=far, default=None)
    sums: tuple[list, list] = ([], [])
    for m in re.finditer(AMOUNT, sentence):
        before, after = sentence[max(0, m.start() - 18) : m.start()], sentence[m.end() : m.end() + 12]
        if not re.search(VALUED_BEFORE, before) and not re.match(OTHER_AFTER, after):
            sums[bool(re.search(IN_ALL, before))].append((far(m), m[1]))
    return told[1] if told else "", *(min(x)[1] if x else "" for x in sums)


def _fundings(sentence: pd.Series, start: pd.Series, end: pd.Series, started: pd.Series) -> pd.DataFrame:
    rows = [one_funding(t or "", int(a), int(b), bool(on)) for t, a, b, on in zip(sentence, start, end, started, strict=True)]
    return pd.DataFrame(rows, columns=["round", "amount", "in_all"])


def funding(sentence: Column, start: Column, end: Column, started: Column) -> Column:
    """one_funding in Arrow batches: a struct of round, amount and in_all. Offsets of matches decide, which
    built-in functions do not give."""
    return F.pandas_udf(_fundings, "round string, amount string, in_all string")(sentence, start, end, started)
