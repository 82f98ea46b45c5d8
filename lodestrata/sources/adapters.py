"""Parsers by source: a registry of functions that one batch operator applies to stored pages."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.extraction import parse_page

#: Parsers by kind of source; each gives (title, text) of a body, or None if it is not its form.
PARSERS: dict[str, Callable[[str], tuple[str, str] | None]] = {}


def parser(kind: str):
    def add(f):
        PARSERS[kind] = f
        return f

    return add


@parser("html")
def html_page(body: str) -> tuple[str, str] | None:
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", body)
    return (" ".join(title[1].split()), parse_page(body)[1]) if title else None


@parser("json")
def json_article(body: str) -> tuple[str, str] | None:
    try:
        value = json.loads(body)
    except ValueError:
        return None
    return (str(value.get("title") or ""), str(value.get("content") or value.get("text") or "")) if isinstance(value, dict) else None


@parser("text")
def plain_text(body: str) -> tuple[str, str] | None:
    head, _, rest = body.strip().partition("\n")
    return (head[:200], rest.strip()) if head else None


def parsed_by_source(pages: DataFrame, key: str, kind: str, body: str) -> DataFrame:
    """(key, kind, ok, title, text): every page by its source's parser. An unknown kind or a body that
    the parser refuses is a row with ok false: it fails closed and can be queued again."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [(PARSERS.get(k) or (lambda _: None))(b or "") for k, b in zip(pdf[kind], pdf[body], strict=True)]
            yield pd.DataFrame({key: pdf[key], "kind": pdf[kind], "ok": [g is not None for g in got], "title": [g[0] if g else None for g in got], "text": [g[1] if g else None for g in got]})

    return pages.select(key, kind, body).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, kind string, ok boolean, title string, text string")


def detail_text(body: Column, content_type: Column) -> Column:
    """The visible text of a body by its content type: HTML without tags, JSON's content, else as is."""
    from lodestrata.functions.text import compact, strip_html

    kind = F.lower(F.substring_index(content_type, ";", 1))
    content = F.coalesce(F.get_json_object(body, "$.content"), F.get_json_object(body, "$.text"))
    return F.when(kind.isin("text/html", "application/xhtml+xml"), strip_html(body)).when(kind.endswith("json"), content).otherwise(compact(body))


def env_values(text: str) -> dict[str, str]:
    """KEY=value lines; comments and blank lines are left out, quotes around a value dropped."""
    out = {}
    for line in text.splitlines():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return out


def two_pass_links(first: DataFrame, second: DataFrame, key: str, url: str) -> DataFrame:
    """Rows of the first pass, and of the second those whose (key, url) it has not."""
    return first.unionByName(second.join(first.select(key, url).distinct(), [key, url], "left_anti")).dropDuplicates([key, url])


def repaired_json(text: Column) -> Column:
    """Bounded repair of near-JSON: code fences, trailing commas and typographic quotes; null if it is
    still no JSON object."""
    bare = F.trim(F.regexp_replace(text, r"^\s*```(?:json)?|```\s*$", ""))
    fixed = F.regexp_replace(F.regexp_replace(bare, "[“”]", '"'), r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(fixed).isNotNull() & F.startswith(fixed, F.lit("{")), fixed)
