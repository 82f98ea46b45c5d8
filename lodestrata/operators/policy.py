"""Decisions by rules: attribution of text to a company, collection policy, evidence gates, budgets,
cooldown."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that are never collected, and those that may be (besides public_*).
PRIVATE_FIELDS = ("personal_email", "private_email", "email", "personal_phone", "private_phone", "mobile_phone", "phone", "home_address", "wechat_id", "qq_id", "id_card")
SAFE_FIELDS = ("url", "title", "published_at", "company_name", "person_name", "professional_role", "public_statement", "official_profile_url", "institution_name", "event_type", "source_name")
#: Access that needs an authorization; licences that allow full text.
GRANTED_ACCESS = ("official_api", "licensed_feed", "user_authorized")
FULL_TEXT_LICENCES = ("open", "licensed")
#: Marks of a city that is not certain; the city and the basis that stand in for it.
UNCERTAIN_CITY = ("待定", "未知", "不确定", "全国", "多地", "待核", "未确认", "暂无")
DEFAULT_CITY, DEFAULT_CITY_BASIS = "上海", "公开证据未确认唯一城市；按发布规则默认上海，需人工复核"
#: What sentences end with.
SENTENCE_END, LOOSE_SENTENCE_END = r"(?<=[。！？；!?;])\s*|[\r\n]+", r"(?<=[。！？；!?;])\s*|\.{2,}|…+|[\r\n]+"


def _names_any(text: Column, names: Column) -> Column:
    return F.exists(names, lambda n: F.contains(F.lower(text), F.lower(n)))


def plausible_name(name: Column, seeds: Sequence[str], generic: Sequence[str], fragments: Sequence[str], endings: str, length: tuple[int, int] = (2, 16)) -> Column:
    """Whether a name can be a company's: a known one, or one of likely length that is no general term, has
    no fragment of a headline, and ends as company names do (a pattern, in either case)."""
    odd = F.exists(F.array(*[F.lit(f) for f in fragments]).cast("array<string>"), lambda f: F.contains(name, f))
    return F.coalesce(name.isin(*seeds) | (F.length(name).between(*length) & ~name.isin(*generic) & ~odd & name.rlike(f"(?i)(?:{endings})$")), F.lit(False))


def attributable(name: Column, title: Column, snippet: Column, titled: Column) -> Column:
    """The text that may be laid to a company: title and snippet if the title names it; nothing if the
    title names others only (`titled`: the companies found in it); else the snippet's sentences that
    name it."""
    t, s = F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))
    own = F.array(name)
    local = F.array_join(F.filter(F.split(s, SENTENCE_END), lambda x: _names_any(x, own)), " ")
    return F.when(_names_any(t, own), F.trim(F.concat_ws(" ", t, s))).when((F.size(titled) > 0) & ~F.array_contains(titled, name), "").otherwise(local)


def local_context(names: Column, title: Column, snippet: Column, window: int = 180) -> Column:
    """The title if it has one of a company's names, and the starts of the snippet's sentences that have
    one, each text once."""
    t, s = F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))
    near = F.transform(F.filter(F.split(s, LOOSE_SENTENCE_END), lambda x: _names_any(x, names)), lambda x: F.substring(x, 1, 2 * window))
    head = F.when(_names_any(t, names), F.array(t)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.array_distinct(F.concat(head, near)), " ")


def relevant_text(name: Column, names: Column, title: Column, snippet: Column, titled: Column) -> Column:
    """What of a result tells of a company: all of it if the title names it, nothing if the title names
    another or no sentence has it, else its local context."""
    t, s = F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))
    context = local_context(names, title, snippet)
    others = F.exists(titled, lambda x: x != name)
    return F.when(context == "", "").when(_names_any(t, names), F.concat_ws(" ", t, s)).when(others, "").otherwise(context)


def collection_decision(source: Column, wanted: Column) -> Column:
    """What may be collected: a struct of allowed, reasons (what blocks, then notices), collect, excluded,
    mode and days. `source` has bypass, public, authorized, basis, robots, terms, licence, full_text and
    max_days; `wanted` has fields, full_text and days. Fetched bodies are kept only as full text that
    the licence allows."""
    fields = F.array_distinct(wanted["fields"])
    private = F.filter(fields, lambda f: f.isin(*PRIVATE_FIELDS))
    collect = F.filter(fields, lambda f: ~f.isin(*PRIVATE_FIELDS) & (f.isin(*SAFE_FIELDS) | F.startswith(f, F.lit("public_"))))
    unknown = F.array_except(F.array_except(fields, private), collect)
    full = wanted["full_text"] & source["full_text"] & source["licence"].isin(*FULL_TEXT_LICENCES)
    blocking = [
        (source["bypass"], "access_control_bypass_forbidden"),
        (~source["public"] & ~source["authorized"], "source_not_public_or_authorized"),
        (source["basis"].isin(*GRANTED_ACCESS) & ~source["authorized"], "authorization_required"),
        (~source["robots"], "robots_policy_disallows_collection"),
        (~source["terms"], "source_terms_disallow_collection"),
        ((source["licence"] == "restricted") & ~source["authorized"], "restricted_source_without_permission"),
    ]
    notices = [
        (F.size(private) > 0, "private_contact_fields_excluded"),
        (F.size(unknown) > 0, "unapproved_fields_excluded"),
        (wanted["full_text"] & ~full, "full_text_retention_downgraded"),
        (wanted["days"] > source["max_days"], "retention_period_capped"),
    ]
    told = lambda rules: F.array_compact(F.array(*[F.when(on, why) for on, why in rules]))
    return F.struct(
        (F.size(told(blocking)) == 0).alias("allowed"), F.concat(told(blocking), told(notices)).alias("reasons"), collect.alias("collect"), F.concat(private, unknown).alias("excluded"),
        F.when(full, "full_text").otherwise("metadata_and_extracted_facts").alias("mode"), F.when(full, F.least(wanted["days"], source["max_days"])).otherwise(0).alias("days"),
    )


def one_city(city: Column, basis: Column) -> Column:
    """(city, basis): a city that is certain and single as it is; otherwise the default and why. A single
    city without a basis has a null basis, which callers reject."""
    c = F.trim(F.coalesce(city, F.lit("")))
    marks = F.exists(F.array(*[F.lit(m) for m in (*UNCERTAIN_CITY, ",", "，", "、", "/", "；", "或")]), lambda m: F.contains(c, m))
    # 和, 及 and 与 join two cities only where two characters stand on either side of the last one.
    joined = F.lit(False)
    for mark in ("和", "及", "与"):
        sides = c.rlike(f"^.*\\S.*\\S.*{mark}[^{mark}]*$")
        left, right = F.trim(F.regexp_extract(c, f"^(.*){mark}[^{mark}]*$", 1)), F.trim(F.regexp_extract(c, f"^.*{mark}([^{mark}]*)$", 1))
        joined = joined | (sides & (F.length(left) >= 2) & (F.length(right) >= 2))
    uncertain = (c == "") | marks | joined
    said = F.nullif(F.trim(F.coalesce(basis, F.lit(""))), F.lit(""))
    return F.struct(F.when(uncertain, DEFAULT_CITY).otherwise(c).alias("city"), F.when(uncertain, DEFAULT_CITY_BASIS).otherwise(said).alias("basis"))


def evidence_gate(evidence: DataFrame, key: str, kind: str, source_group: str, grade: str, late: str, operational: Sequence[str], advertisement: str = "job_ad") -> DataFrame:
    """(key, upstream, near_term): whether a hypothesis has any evidence from before the advertisement, and
    whether that carries a near-term claim: two rows of two kinds from two groups of sources, or an
    operational one of grade A. Empty kinds and groups do not count as kinds and groups."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    up = ~F.coalesce(F.col(late), F.lit(False)) & (F.coalesce(F.col(kind), F.lit("")) != advertisement)
    told = lambda c: F.countDistinct(F.when(up & (blank(c) != ""), blank(c)))
    strong = up & F.col(kind).isin(*operational) & (F.upper(F.col(grade)) == "A")
    g = evidence.groupBy(key).agg(F.count_if(up).alias("n"), told(kind).alias("kinds"), told(source_group).alias("groups"), F.coalesce(F.bool_or(strong), F.lit(False)).alias("strong"))
    return g.select(key, (F.col("n") > 0).alias("upstream"), (F.col("strong") | ((F.col("n") >= 2) & (F.col("kinds") >= 2) & (F.col("groups") >= 2))).alias("near_term"))


def budget_ledger(requests: DataFrame, account: Sequence[str], order: Column, operation: str, points: str, committed: str, limit: int) -> DataFrame:
    """account, operation, points, state of the requests of each account (say a provider's day), in order.
    An operation that has asked before is refused, and so is one whose points would lead beyond the
    limit; a smaller one after it may still pass. Accepted ones are reserved, or spent where
    `committed`. Order decides, so an account's day is folded in one place: a task reads its accounts'
    sorted rows one after another and holds the known operations of one account only."""
    asked = requests.select(*account, order.alias("__at"), F.col(operation), F.col(points).cast("long").alias(points), F.col(committed).alias("__committed"))
    name = F.col(operation).cast("string").alias("__name")
    spread = asked.repartition(*account).sortWithinPartitions(*account, "__at", operation, points, "__committed").select(*account, operation, points, "__committed", name)

    def fold(batches):
        now, used, known = None, 0, set()
        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in account), strict=True)
            passed = []
            for key, one, cost in zip(keys, b.column("__name").to_pylist(), b.column(points).to_pylist(), strict=True):
                if key != now:
                    now, used, known = key, 0, set()
                within = None if cost is None else used + cost <= limit
                unknown = None if one is None else one not in known
                fits = False if within is False or unknown is False else None if within is None or unknown is None else True
                if fits:
                    used += cost
                    known.add(one)
                passed.append(fits)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*account, operation, points, "__committed"]), pa.array(passed, pa.bool_())], [*account, operation, points, "__committed", "passed"])

    kinds = dict(spread.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*account, operation, points, "__committed"]), "passed boolean"])
    state = F.when(~F.col("passed"), "refused").when(F.col("__committed"), "spent").otherwise("reserved")
    return spread.mapInArrow(fold, schema).select(*account, operation, points, state.alias("state"))


def cooled(leads: DataFrame, shown: DataFrame, company: str, items: str, day: str, as_of: Column, days: int = 7) -> DataFrame:
    """(company, segment) of today's leads (company, items) beside what was shown (company, day, items): new,
    returning after the cooldown, new evidence (an item not shown within it), or cooling."""
    recent = (F.col(day) < as_of) & (F.col(day) >= F.date_sub(as_of, days))
    past = shown.groupBy(company).agg(F.array_distinct(F.flatten(F.collect_list(F.when(recent, F.col(items))))).alias("__seen"), F.bool_or(recent).alias("__recent"))
    fresh = F.size(F.array_except(F.col(items), F.coalesce("__seen", F.array().cast(dict(leads.dtypes)[items])))) > 0
    segment = F.when(F.col("__recent").isNull(), "new").when(~F.col("__recent"), "returning").when(fresh, "new evidence").otherwise("cooling")
    return leads.join(past, company, "left").select(company, segment.alias("segment"))
