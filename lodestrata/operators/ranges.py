"""Joins on ranges of time and offsets, and matching."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.time import micros


def windowed_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], left_day: str, right_day: str, lower: int, upper: int, block: int = 64) -> DataFrame:
    """Rows of left and right with equal `on` and lower <= right_day - left_day <= upper (days).

    An equi join on blocks of days: each right row goes to its block, each left row to the blocks
    that its window touches, so a key's long history does not meet itself in full. Columns of the
    two sides other than `on` must differ."""
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    reach = F.sequence(F.floor((number(left_day) + lower) / block), F.floor((number(left_day) + upper) / block))
    a = left.withColumn("__block", F.explode(reach))
    b = right.withColumn("__block", F.floor(number(right_day) / block))
    apart = F.datediff(F.col(right_day), F.col(left_day))
    return a.join(b, [*on, "__block"]).where(apart.between(lower, upper)).drop("__block")


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before it, null without one. One
    union and one window by key; ties at a moment go to the right row."""
    tag = F.struct(*[F.col(v) for v in values])
    pad = [c for c in left.columns if c not in on]
    l = left.select(*on, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*pad).alias("__l"), F.lit(None).cast(right.select(tag.alias("v")).schema["v"].dataType).alias("__v"))
    r = right.select(*on, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*pad).alias("v")).schema["v"].dataType).alias("__l"), tag.alias("__v"))
    w = Window.partitionBy(*on).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return both.select(*on, "__l.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def interval_label(target: DataFrame, observed: DataFrame, on: Sequence[str], start: str, end: str, o_start: str, o_end: str) -> DataFrame:
    """For each target interval [start, end): positive if an observed one lies inside, ambiguous if one
    only overlaps, else none. Column `label`."""
    inside = (F.col(o_start) >= F.col(start)) & (F.col(o_end) <= F.col(end))
    touches = (F.col(o_start) < F.col(end)) & (F.col(o_end) > F.col(start))
    pair = target.join(observed, list(on), "left")
    label = F.when(F.max(F.coalesce(inside, F.lit(False))), "positive").when(F.max(F.coalesce(touches, F.lit(False))), "ambiguous").otherwise("none")
    return pair.groupBy(*on, start, end).agg(label.alias("label"))


def covered(target: DataFrame, snapshots: DataFrame, on: Sequence[str], start: str, end: str, s_start: str, s_end: str) -> DataFrame:
    """Whether every day of [start, end] lies in some snapshot [s_start, s_end] of the same key
    (relational division): the days of the target less those that are covered."""
    days = target.select(*on, start, end, F.explode(F.sequence(F.col(start), F.col(end))).alias("__day"))
    seen = snapshots.select(*on, F.explode(F.sequence(F.col(s_start), F.col(s_end))).alias("__day")).distinct().withColumn("__in", F.lit(True))
    return days.join(seen, [*on, "__day"], "left").groupBy(*on, start, end).agg((F.count("*") == F.count("__in")).alias("covered"), F.count_if(F.col("__in").isNull()).alias("missing"))


def stabbing(points: DataFrame, scopes: DataFrame, on: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Points with the half-open scopes [start, end) of their key that hold them."""
    return points.join(scopes, list(on)).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))


def alias_matches(names: DataFrame, entities: DataFrame, name: str, entity: str, aliases: str, normal) -> DataFrame:
    """(name, entity) where the normalised name is an alias of exactly one entity."""
    keys = entities.select(entity, F.explode(aliases).alias("__a")).select(entity, normal(F.col("__a")).alias("__k")).where("__k != ''").distinct()
    hit = names.select(name, normal(F.col(name)).alias("__k")).where("__k != ''").distinct().join(keys, "__k")
    return hit.groupBy(name).agg(F.countDistinct(entity).alias("n"), F.min(entity).alias(entity)).where("n = 1").drop("n")


def kuhn(edges: list[tuple], rows: list) -> dict:
    """A maximum matching of rows to columns; rows in the order given, columns smallest first."""
    near: dict = {}
    for r, c in sorted(edges):
        near.setdefault(r, []).append(c)
    owner: dict = {}

    for first in rows:
        # A search for a path of exchanges, without recursion: each step holds a row and what it still tries.
        seen: set = set()
        path: list[tuple] = [(first, iter(near.get(first, ())), None)]
        while path:
            row, rest, _ = path[-1]
            column = next((c for c in rest if c not in seen), None)
            if column is None:
                path.pop()
                continue
            seen.add(column)
            if column in owner:
                path.append((owner[column], iter(near.get(owner[column], ())), column))
                continue
            for row, _, came_by in reversed(path):  # every row takes what it found, and frees what it had
                owner[column] = row
                column = came_by
            break
    return {r: c for c, r in owner.items()}


def matching(pairs: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """A maximum bipartite matching inside each group, rows with the fewest partners first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = list(set(zip(pdf[left].tolist(), pdf[right].tolist(), strict=True)))
        degree = pd.Series([r for r, _ in edges]).value_counts()
        found = kuhn(edges, sorted(degree.index, key=lambda r: (degree[r], r)))
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(found), left: list(found), right: list(found.values())})

    kinds = dict(pairs.dtypes)
    return pairs.select(group, left, right).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {left} {kinds[left]}, {right} {kinds[right]}")


def cluster_events(claims: DataFrame, group: Sequence[str], at: str, claim_id: str, window_days: float) -> DataFrame:
    """Claims of a group folded into events in order of arrival (at, id): a claim joins the event whose
    time is nearest within the window, the earliest made if tied, and moves it back if it is earlier;
    else it begins one. Order decides, so a group runs in one task; groups are one company's reports
    of one type. Returns group, claim id, event (the id that began it) and occurred (seconds)."""
    kinds = dict(claims.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__at", claim_id])
        made: list[list] = []
        out = []
        for when, cid in zip(pdf["__at"], pdf[claim_id], strict=True):
            near = [(abs(e[0] - when), i) for i, e in enumerate(made) if abs(e[0] - when) <= window_days * 86400]
            if near:
                e = made[min(near)[1]]
                e[0] = min(e[0], when)
            else:
                made.append(e := [when, cid])
            out.append(e[1])
        when = {e[1]: e[0] for e in made}
        return pd.DataFrame({**{g: pdf[g] for g in group}, claim_id: pdf[claim_id], "event": out, "occurred": [when[o] for o in out]})

    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), f"{claim_id} {kinds[claim_id]}", f"event {kinds[claim_id]}", "occurred double"])
    return claims.select(*group, claim_id, (micros(F.col(at)) / 1e6).alias("__at")).groupBy(*group).applyInPandas(run, schema)


def when_all(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
