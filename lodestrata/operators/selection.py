"""Small, order-bound selections. They run on the driver or in one task over a bounded pool, which the
caller ranks and cuts first; a pool above the bound is an error."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POOL = 100_000


def pool(df: DataFrame, *columns: str, most: int = POOL) -> list[tuple]:
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a pool of more than {most} rows")
    return sorted(map(tuple, rows), key=repr)


def greedy_cover(items: list[tuple[object, frozenset]], n: int) -> list:
    """Up to n keys, each time the one that adds most that is not yet covered, then the smallest key."""
    chosen, covered, left = [], set(), dict(items)
    while left and len(chosen) < n:
        best = min(left, key=lambda k: (-len(left[k] - covered), k))
        if not left[best] - covered:
            break
        covered |= left.pop(best)
        chosen.append(best)
    return chosen


def greedy_cover_rows(df: DataFrame, key: str, items: str, n: int) -> list:
    """greedy_cover over rows (key, array of items) of any number: the sums stay in Spark, and only the
    row chosen in each of the n rounds comes to the driver."""
    chosen, covered = [], set()
    kind = dict(df.dtypes)[items]
    rows = df.select(key, items)
    for _ in range(n):
        seen = F.array(*[F.lit(x) for x in sorted(covered)]).cast(kind)
        new = rows.where(~F.col(key).isin(chosen)) if chosen else rows
        best = new.withColumn("gain", F.size(F.array_except(items, seen))).where("gain > 0").orderBy(F.desc("gain"), key).first()
        if best is None:
            break
        chosen.append(best[key])
        covered |= set(best[items])
    return chosen


def greedy_distinct(rows: list[tuple], n: int) -> list[tuple]:
    """Rows (group, key, owner) in order, each owner used once, n of a group at most."""
    used, count, out = set(), {}, []
    for group, key, owner in rows:
        if owner not in used and count.get(group, 0) < n:
            used.add(owner)
            count[group] = count.get(group, 0) + 1
            out.append((group, key, owner))
    return out


def quota_candidates(df: DataFrame, key: str, label: str, quotas: dict[str, int], seed: str, restarts: int = 20) -> DataFrame:
    """The (key, label) rows that quota_restarts can choose from all rows: of each label, those that
    come first, as many as its quota, in the order of some restart."""
    quota = F.element_at(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair]), F.col(label))
    rows = df.select(key, label).withColumn("quota", quota).where("quota > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    mark = F.sha2(F.concat_ws("|", F.lit(seed), F.col("k").cast("string"), F.col(key).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy("k", label).orderBy(mark))
    return rows.withColumn("r", rank).where((F.col("r") <= max(quotas.values())) & (F.col("r") <= F.col("quota"))).select(key, label).distinct()


def quota_restarts(rows: list[tuple[object, str]], quotas: dict[str, int], seed: str, restarts: int = 20) -> list:
    """Keys of (key, label) rows that fill the quotas, by the best of several seeded orders: the one
    whose sorted keys hash lowest among those that fill them all."""
    best = None
    for k in range(restarts):
        order = sorted(rows, key=lambda r: hashlib.sha256(f"{seed}|{k}|{r[0]}".encode()).digest())
        need, out = dict(quotas), []
        for key, label in order:
            if need.get(label, 0) > 0:
                need[label] -= 1
                out.append(key)
        if not any(need.values()):
            mark = (hashlib.sha256(repr(sorted(out)).encode()).hexdigest(), sorted(out))
            best = min(best or mark, mark)
    return best[1] if best else []


def exact_size_split(sizes: dict[object, int], target: int) -> list | None:
    """Groups whose sizes add up to the target (subset sum, smallest keys first); None if none do."""
    reach: dict[int, tuple | None] = {0: None}
    for key in sorted(sizes):
        for total in sorted(reach, reverse=True):
            new = total + sizes[key]
            if new <= target and new not in reach:
                reach[new] = (key, total)
    if target not in reach:
        return None
    out, at = [], target
    while reach[at]:
        key, at = reach[at]
        out.append(key)
    return sorted(out)


def group_disjoint_split(components: DataFrame, component: str, target: int) -> DataFrame:
    """(component, chosen): whole components whose sizes add up to the target."""
    sizes = components.groupBy(component).agg(F.count("*").alias("n"))
    chosen = exact_size_split({k: n for k, n in pool(sizes, component, "n")}, target) or []
    return sizes.select(component, F.col(component).isin(chosen).alias("chosen"))
