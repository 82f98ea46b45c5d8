"""Scores, lifecycles, labels and metrics over groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A further event of a type counts this share; caps of the need part and of all.
REPEAT_SHARE, NEED_CAP, TOTAL_CAP = 0.25, 32.0, 99.0
#: Days without evidence until an event is stale.
STALE_DAYS = 180


def need_score(df: DataFrame, entity: Sequence[str], kind: str, weight: Column, cap: float = NEED_CAP) -> DataFrame:
    """For each entity the sum over event types of the top weight and a quarter of the rest, capped.
    Two partial aggregations; no list of weights is built."""
    by_type = df.withColumn("__w", weight).groupBy(*entity, kind).agg(F.max("__w").alias("top"), F.sum("__w").alias("all"))
    part = F.col("top") + (F.col("all") - F.col("top")) * REPEAT_SHARE
    return by_type.groupBy(*entity).agg(F.least(F.sum(part), F.lit(cap)).alias("need"), F.count("*").alias("types"))


def role_score(types: Column) -> Column:
    return F.least(17 + types * 3, F.lit(25))


def timing_score(advertised: Column) -> Column:
    return F.when(advertised, 5).otherwise(15)


def commercial_score(commercial_types: Column, capacity: Column) -> Column:
    return F.least(commercial_types * 4 + F.when(capacity, 4).otherwise(0), F.lit(10))


def confidence_score(domains: Column, has_a: Column, has_b: Column, types: Column) -> Column:
    base = F.when((domains >= 3) & has_a, 10).when((domains >= 2) & has_b, 8).otherwise(5)
    return base + F.when((domains >= 2) & (types >= 2), 3).otherwise(0)


def total_score(*parts: Column) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + F.round(p, 1)
    return F.least(out, F.lit(TOTAL_CAP))


def lifecycle(superseded: Column, retracts: Column, contradicts: Column, days_quiet: Column, sources: Column, revisions: Column) -> Column:
    """The state of an event, the first that holds: superseded, retracted, disputed, stale, developing,
    corroborated, emerging."""
    return (
        F.when(superseded, "superseded")
        .when(retracts > 0, "retracted")
        .when(contradicts > 0, "disputed")
        .when(days_quiet > STALE_DAYS, "stale")
        .when((sources >= 2) & (revisions > 1), "developing")
        .when(sources >= 2, "corroborated")
        .otherwise("emerging")
    )


def label(positive: Column, covered: Column, contrastive: Column) -> Column:
    """positive, then negative (replayable), then contrastive, else unknown, each with its weight."""
    pair = lambda name, w: F.struct(F.lit(name).alias("label"), F.lit(w).alias("weight"))
    return F.when(positive, pair("positive", 1.0)).when(covered, pair("negative", 1.0)).when(contrastive, pair("contrastive", 0.35)).otherwise(pair("unknown", 0.0))


def ranking_metrics(scored: DataFrame, query: str, item: str, score: str, relevant: str, k: int) -> DataFrame:
    """One row: queries, top-1 and top-k accuracy, mean reciprocal rank and Brier score. The best
    relevant row's rank is the rows that stand before it, found without ranking a query's rows when
    it has no relevant one."""
    from pyspark.sql import Window

    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    ranked = scored.withColumn("__r", F.row_number().over(w))
    best = ranked.groupBy(query).agg(F.min(F.when(F.col(relevant), F.col("__r"))).alias("best"), F.sum(F.pow(F.col(score) - F.col(relevant).cast("double"), 2)).alias("sq"), F.count("*").alias("n"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return best.agg(F.count("*").alias("queries"), share(F.col("best") == 1).alias("top1"), share(F.col("best") <= k).alias("topk"), F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"), (F.sum("sq") / F.sum("n")).alias("brier"))


def macro_f1(pairs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: the mean of the classes' F1 over every class that occurs on either side."""
    n = pairs.groupBy(gold, predicted).count()
    g = n.select(F.col(gold).alias("c"), F.col("count").alias("gold"), F.lit(0).alias("pred"), F.when(F.col(gold) == F.col(predicted), F.col("count")).otherwise(0).alias("tp"))
    p = n.select(F.col(predicted).alias("c"), F.lit(0).alias("gold"), F.col("count").alias("pred"), F.lit(0).alias("tp"))
    by = g.unionByName(p).groupBy("c").agg(F.sum("gold").alias("gold"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp"))
    return by.agg(F.avg(2.0 * F.col("tp") / (F.col("gold") + F.col("pred"))).alias("macro_f1"))


def budget_admission(requests: DataFrame, account: Sequence[str], order: Sequence[str], cost: str, limit: float) -> DataFrame:
    """Requests in order, admitted while the running sum of all asked so far stays within the limit."""
    from pyspark.sql import Window

    w = Window.partitionBy(*account).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return requests.withColumn("spent", F.sum(cost).over(w)).withColumn("admitted", F.col("spent") <= limit)


def rule_prior(role: Column, recencies: Column, priors: Mapping[str, Sequence[str]]) -> Column:
    """How likely a role is by rules alone, in [0, 1): each event that names the role among its preferred
    ones adds its recency (a map by event), less for later places but a quarter at the least."""
    weights = {f"{event}|{name}": max(0.25, 1.0 - 0.15 * rank) for event, names in priors.items() for rank, name in reversed(list(enumerate(names)))}
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    each = F.transform(F.map_entries(recencies), lambda e: F.coalesce(e["value"], F.lit(0.0)) * F.coalesce(F.try_element_at(table, F.concat_ws("|", e["key"], role)), F.lit(0.0)))
    total = F.aggregate(F.coalesce(each, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    return 1 - F.exp(-F.greatest(total, F.lit(0.0)))
