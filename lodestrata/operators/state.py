"""Batch forms of stateful and operational behaviour; the moment of judging is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and most seconds between two visits of a source.
LEAST_INTERVAL, MOST_INTERVAL = 300.0, 604_800.0


def success_multiplier(new_items: Column, parsed: Column, duplicate_share: Column) -> Column:
    """How a successful visit stretches the interval: new items shorten it, emptiness and duplicates
    lengthen it."""
    return F.when(new_items > 0, 0.75).when(parsed == 0, 2.0).when(duplicate_share >= 0.9, 1.75).when(duplicate_share >= 0.5, 1.25).otherwise(1.0)


def bounded(seconds: Column, least: float = LEAST_INTERVAL, most: float = MOST_INTERVAL) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), seconds))


def failure_interval(base: Column, failures: Column) -> Column:
    """Doubles with every failure in a row."""
    return bounded(base * F.pow(F.lit(2.0), failures - 1))


def circuit(failures: Column, threshold: int) -> Column:
    return F.when(failures >= threshold, "open").otherwise("closed")


def needs_recheck(published: Column, fetched: Column, same_hash: Column, now: Column, overlap_hours: int = 48, recheck_hours: int = 12) -> Column:
    """Whether a stored article is fetched again: never seen or changed, or young and not looked at for
    a while. A young one lies within the overlap after its publication."""
    hours = lambda a, b: (F.unix_seconds(a.cast("timestamp")) - F.unix_seconds(b.cast("timestamp"))) / 3600
    age, since = hours(now, published), hours(now, fetched)
    return F.coalesce(~same_hash, F.lit(True)) | ((age >= 0) & (age <= overlap_hours) & (since >= recheck_hours))


def transition(state: Column, action: Column, table: dict[tuple[str, str], str]) -> Column:
    """The state after an action; null for a move that the table does not allow."""
    out = F.lit(None).cast("string")
    for (s, a), to in table.items():
        out = F.when((state == s) & (action == a), F.lit(to)).otherwise(out)
    return out


def expired(state: Column, due: Column, today: Column) -> Column:
    return F.when((state == "draft") & (due < today), "expired").otherwise(state)


def stage_cache(stages: DataFrame, inputs: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): reuse where the stored input hash is the present one, else run."""
    now = inputs.select(key, F.col(digest).alias("__now"))
    return now.join(stages.select(key, F.col(digest).alias("__was")), key, "left").select(key, F.when(F.col("__was") == F.col("__now"), "reuse").otherwise("run").alias("action"))


def idempotent(requests: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): new requests by key; the same key with another input is a conflict."""
    return requests.groupBy(key).agg(F.when(F.min(digest) == F.max(digest), "same").otherwise("conflict").alias("state"), F.count("*").alias("tries"))


def issues(*rules: DataFrame) -> DataFrame:
    """The union of rule results (rule, subject, severity), the worst of each subject first."""
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out
