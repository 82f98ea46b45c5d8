"""Operators on rows by key: latest, best, first wins, strata, streaks, upserts and changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by an order that ends in a tiebreak. One aggregation: a key's rows are
    reduced where they are read, so a hot key costs one row for each task."""
    others = [c for c in df.columns if c not in keys]
    ranked = df.withColumn("__o", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    best = ranked.groupBy(*keys).agg(F.min_by(F.struct(*others), "__o").alias("__b"))
    return best.select(*[F.col(k) if k in keys else F.col(f"__b.{k}").alias(k) for k in df.columns])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by the order columns."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__b"))
    return best.select(*[F.col(k) if k in keys else F.col(f"__b.{k}").alias(k) for k in df.columns])


def stratified_top(df: DataFrame, group: Sequence[str], stratum: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """Of each group `limit` rows: the first of each stratum, in order, then the rest in order. Adds
    `pick` (from 1)."""
    inner = Window.partitionBy(*group, *stratum).orderBy(*order)
    ranked = df.withColumn("__first", F.row_number().over(inner) > 1)
    outer = Window.partitionBy(*group).orderBy("__first", *order)
    return ranked.withColumn("pick", F.row_number().over(outer)).where(F.col("pick") <= limit).drop("__first")


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)


def trailing_streak(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, name: str = "streak") -> DataFrame:
    """How many of a key's newest rows hold `hit` without a break: the rows later than the last that
    does not. Two aggregations, no window over a key's history."""
    mark = F.struct(*order)
    last_miss = df.groupBy(*keys).agg(F.max(F.when(~F.coalesce(hit, F.lit(False)), mark)).alias("__m"))
    return df.join(last_miss, list(keys)).groupBy(*keys).agg(F.count_if(F.col("__m").isNull() | (mark > F.col("__m"))).alias(name))


def longest_streak(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, name: str = "longest") -> DataFrame:
    """The longest run of rows with `hit`, by gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(*order)
    island = df.withColumn("__i", F.sum(F.when(hit, 0).otherwise(1)).over(w)).withColumn("__h", hit.cast("int"))
    return island.groupBy(*keys, "__i").agg(F.sum("__h").alias("n")).groupBy(*keys).agg(F.max("n").alias(name))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """The last value that is not null, at or before each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """old and those rows of new whose key old has not; of new rows with one key the first."""
    fresh = best_per_key(new, keys, order).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """One row for each key of either. rules by column: keep (old if not null), replace (new if there is
    a row), fill (new unless empty), min, max, union (map: old keys win)."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    there = F.coalesce(*[F.col(f"n.{k}").isNotNull() for k in keys])

    def one(c: str, rule: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        return {
            "keep": lambda: F.coalesce(a, b),
            "replace": lambda: F.when(there, b).otherwise(a),
            "fill": lambda: F.coalesce(F.nullif(b.cast("string"), F.lit("")), a.cast("string")),
            "min": lambda: F.least(a, b),
            "max": lambda: F.greatest(a, b),
            "union": lambda: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, y))),
        }[rule]().alias(c)

    return both.select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *[one(c, r) for c, r in rules.items()])


def change_set(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, action): create, update or deactivate, by the hash of the columns; unchanged rows are out."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    o, n = old.select(key, digest.alias("__old")), new.select(key, digest.alias("__new"))
    action = F.when(F.col("__old").isNull(), "create").when(F.col("__new").isNull(), "deactivate").when(F.col("__old") != F.col("__new"), "update")
    return o.join(n, key, "full_outer").select(key, action.alias("action")).where("action is not null")


def replace_partitions(old: DataFrame, new: DataFrame, scope: Sequence[str]) -> DataFrame:
    """old without the scopes that new has, and new: delete and insert as one anti join."""
    return old.join(new.select(*scope).distinct(), list(scope), "left_anti").unionByName(new)


def dead_letters(open_: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """Open letters against this run's failures: (key, state, retries), states open and resolved."""
    f, o = failures.select(key).distinct().withColumn("__f", F.lit(True)), open_.select(key, "retries")
    state = F.when(F.col("__f"), "open").otherwise("resolved")
    return o.join(f, key, "full_outer").select(key, state.alias("state"), F.when(F.col("__f"), F.coalesce(F.col("retries") + 1, F.lit(0))).otherwise(F.col("retries")).alias("retries"))


def split_leaks(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def hash_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows by the sha256 of seed and key: the same ones whatever the partitioning."""
    return df.orderBy(F.sha2(F.concat(F.lit(seed + "|"), F.col(key).cast("string")), 256), key).limit(n)
