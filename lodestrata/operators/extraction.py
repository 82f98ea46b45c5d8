"""Deterministic extraction from text: units, routes, candidates, claims, merges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def units(df: DataFrame, key: str, text: str, most: int = 5000) -> DataFrame:
    """(key, unit, start, end, text): consecutive pieces of a text that lose nothing: sentences, cut at
    `most` code points. Offsets are half-open code points."""
    parts = F.split(F.col(text), r"(?<=[.!?。！？；\n])")
    cut = F.flatten(F.transform(parts, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / most) - 1, F.lit(0))), lambda i: F.substring(s, (i * most + 1).cast("int"), F.lit(most)))))
    pieces = F.filter(cut, lambda s: s != "")
    ends = F.aggregate(pieces, F.array().cast("array<struct<end:int,text:string>>"), lambda acc, s: F.concat(acc, F.array(F.struct((F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + F.length(s)).cast("int").alias("end"), s.alias("text")))))
    rows = df.select(key, F.posexplode(ends).alias("unit", "p"))
    return rows.select(key, "unit", (F.col("p.end") - F.length("p.text")).alias("start"), F.col("p.end").alias("end"), F.col("p.text").alias("text"))


def windows(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, unit, start, text): windows of `size` code points, each `overlap` into the one before."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1))
    rows = df.select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("unit"))
    start = (F.col("unit") * step).cast("int")
    return rows.select(key, F.col("unit").cast("int").alias("unit"), start.alias("start"), F.substr(F.col(text), start + 1, F.lit(size)).alias("text"))


def route(text: Column, headings: str = r"(?m)^#+ ", items: str = r"(?m)^\s*[-*•]") -> Column:
    """(kind, confidence) of a document by ordered rules on its shape."""
    pair = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))
    lines = F.regexp_count(text, F.lit(r"\n")) + 1
    return (
        F.when(F.length(text) == 0, pair("empty", 1.0))
        .when(F.regexp_count(text, F.lit(headings)) >= 2, pair("report", 0.9))
        .when(F.regexp_count(text, F.lit(items)) >= 3, pair("digest", 0.85))
        .when(F.length(text) < 200, pair("flash", 0.8))
        .when((F.length(text) > 8000) | (lines > 60), pair("long", 0.7))
        .otherwise(pair("article", 0.6))
    )


def candidates(units_: DataFrame, key: str, text: str, patterns: Sequence[tuple[str, str]], carry: str | None = None) -> DataFrame:
    """One row for each unit and pattern that it matches, with `kind` and, where `carry` is a pattern
    that names a subject, the last subject named in this unit or one before."""
    hit = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(k)) for k, p in patterns]))
    out = units_.withColumn("__kinds", hit)
    if carry:
        named = F.nullif(F.regexp_extract(F.col(text), carry, 1), F.lit(""))
        w = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("subject", F.last(named, ignorenulls=True).over(w))
    return out.select("*", F.explode("__kinds").alias("kind")).drop("__kinds")


def suppress_nested(spans: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """Spans that no longer (or equal and earlier) span of their key holds: ordered by start and -end,
    a span is nested if some span before it ends at or after its end."""
    w = Window.partitionBy(*key).orderBy(F.col(start), F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__far", F.max(end).over(w)).where(F.col("__far").isNull() | (F.col("__far") < F.col(end))).drop("__far")


def batches(df: DataFrame, key: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1) / size))


def merge_events(events: DataFrame, key: Sequence[str], order: Sequence[Column], unions: Sequence[str]) -> DataFrame:
    """One event for each key: the preferred row, with the array columns of all rows united in order."""
    others = [c for c in events.columns if c not in key and c not in unions]
    marked = events.withColumn("__o", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    best = F.min_by(F.struct(*others), "__o").alias("__b")
    lists = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__o", F.col(u).alias("v")))), lambda x: x["v"]))).alias(u) for u in unions]
    merged = marked.groupBy(*key).agg(best, *lists)
    return merged.select(*[F.col(k) for k in key], *[F.col(f"__b.{c}").alias(c) for c in others], *unions)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.text, self.skip, self.href, self.label = [], [], 0, None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif tag == "a":
            self.href, self.label = dict(attrs).get("href") or "", []

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join("".join(self.label).split())))
            self.href = None

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            if self.href is not None:
                self.label.append(data)


def parse_page(html: str | None) -> tuple[list[dict], str]:
    """The links (href, title) of a page in order, and its visible text with white space compacted."""
    p = _Page()
    p.feed(html or "")
    p.close()
    return [{"href": h, "title": t} for h, t in p.links], " ".join(" ".join(p.text).split())


def parsed_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, links, text) of HTML pages, in Arrow batches."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [parse_page(x) for x in pdf[html]]
            yield pd.DataFrame({key: pdf[key], "links": [g[0] for g in got], "text": [g[1] for g in got]})

    return pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, links array<struct<href:string,title:string>>, text string")


def candidate_links(parsed: DataFrame, key: str, pattern: str, least_title: int, most: int) -> DataFrame:
    """(key, position, href, title): links that fit a pattern and have a title, each href once, the
    first `most` of a page."""
    rows = parsed.select(key, F.posexplode("links").alias("position", "l")).select(key, "position", "l.href", "l.title")
    fit = rows.where(F.col("href").rlike(pattern) & (F.length("title") >= least_title))
    first = fit.groupBy(key, "href").agg(F.min(F.struct("position", "title")).alias("f")).select(key, "f.position", "href", "f.title")
    return first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("position"))).where(F.col("n") <= most).drop("n")


def greedy_themes(items: DataFrame, group: str, key: str, grams: str, least: float) -> DataFrame:
    """(group, key, leader): items in order of key join the first leader whose set overlaps theirs by
    `least` (of the smaller set), else they lead. Order decides: one task for each group."""
    kinds = dict(items.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders: list[tuple] = []
        out = []
        for k, s in sorted(zip(pdf[key], map(set, pdf[grams]), strict=True), key=lambda x: x[0]):
            mine = next((l for l, t in leaders if s and t and len(s & t) / min(len(s), len(t)) >= least), None)
            if mine is None:
                leaders.append((k, s))
                mine = k
            out.append((k, mine))
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(out), key: [k for k, _ in out], "leader": [m for _, m in out]})

    return items.select(group, key, grams).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, leader {kinds[key]}")
