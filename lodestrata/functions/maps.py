"""Column functions on slots (maps) and JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slots that identify an event; two events with different ones are not the same.
IDENTIFYING = ("round", "funding_round", "project", "project_name", "product", "location", "contract", "order")
#: Days within which reports without a shared slot may be one event.
TIGHT_DAYS = 7


def clean_slots(slots: Column) -> Column:
    """Without empty values; white space compacted."""
    kept = F.map_filter(slots, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    return F.transform_values(kept, lambda k, v: F.trim(F.regexp_replace(v, r"\s+", " ")))


def merged_slots(old: Column, new: Column) -> Column:
    """Both maps; where they differ the old value stands."""
    return F.map_zip_with(old, new, lambda k, o, n: F.coalesce(o, n))


def slots_compatible(old: Column, new: Column, days: Column, window: Column) -> Column:
    """Whether two slot maps can be one event: equal, or no identifying slot differs and some slot
    agrees, or nothing is shared and they are close in time."""
    shared = F.array_intersect(F.map_keys(old), F.map_keys(new))
    value = F.try_element_at
    clash = F.exists(shared, lambda k: k.isin(*IDENTIFYING) & (value(old, k) != value(new, k)))
    agree = F.exists(shared, lambda k: value(old, k) == value(new, k))
    same = (F.size(old) > 0) & (F.to_json(F.array_sort(F.map_entries(old))) == F.to_json(F.array_sort(F.map_entries(new))))
    return same | (~clash & (agree | (days <= F.least(F.lit(TIGHT_DAYS), window))))


def slots_fingerprint(slots: Column) -> Column:
    """sha256 of the map as JSON with sorted keys and no spaces (string values)."""
    quoted = lambda s: F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    items = F.transform(F.array_sort(F.map_entries(slots)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"])))
    return F.sha2(F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}")), 256)


def _dumped(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _canonical(text: pd.Series) -> pd.Series:
    def one(x):
        try:
            return _dumped(json.loads(x))
        except (TypeError, ValueError):
            return None

    return text.map(one)


def canonical_json(text: Column | str) -> Column:
    """JSON with sorted keys, no spaces, no escapes beyond the needed; what is no JSON gives null."""
    return F.pandas_udf(_canonical, "string")(text)


def _objects(text: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def one(x):
        found, at = [], 0
        while (at := (x or "").find("{", at)) >= 0:
            try:
                value, end = decoder.raw_decode(x, at)
            except ValueError:
                at += 1
                continue
            found.append(_dumped(value))
            at = end
        return found

    return text.map(one)


def json_objects(text: Column | str) -> Column:
    """The JSON objects that stand in free text, leftmost first, none inside another."""
    return F.pandas_udf(_objects, "array<string>")(text)


def first_in_json_array(text: Column) -> Column:
    """The first element of a JSON array of texts that is not empty."""
    values = F.from_json(text, "array<string>")
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")), F.lit(1))


def dotted(text: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text."""
    return F.get_json_object(text, "$." + path)
