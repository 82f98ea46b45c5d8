"""Components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge. Each round a node goes
    over to whichever of itself and its neighbours has the least hash (another order each round), edges
    follow their ends, and those within a node are gone; so nodes shrink by a factor each round,
    whatever their order. An edge between a node and what it went over to stays, which keeps all
    that hangs together. Rounds are compressed tables; edges are held one way and once, deleted with
    their round, and its shuffle files with them. What the rounds made of a node is read back at the
    end, with the least node of each."""
    spark = edges.sparkSession
    cur = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null"))
    steps: list[tuple[DataFrame, DataFrame]] = []
    while True:
        order = lambda c: F.xxhash64(c, F.lit(len(steps)))  # noqa: B023, E731
        near = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min_by("v", order("v")).alias("v"))
        step = written(near.select("u", F.when(order("v") < order("u"), F.col("v")).otherwise(F.col("u")).alias("c")))
        least = step.withColumn("low", F.col("u")) if not steps else step.join(steps[-1][1].select(F.col("c").alias("u"), "low"), "u")
        steps.append((step, written(least.groupBy("c").agg(F.min("low").alias("low")))))
        half = cur.join(step, "u").select(F.col("c").alias("u"), "v")
        moved = half.join(step.select(F.col("u").alias("v"), "c"), "v").where("u != c").select("u", F.col("c").alias("v"))
        new = written(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        forget(cur)
        cur = new
        del near, least, half, moved, new
        spark.sparkContext._jvm.System.gc()  # Spark deletes shuffle files only of plans that are collected
        if cur.isEmpty():
            break
    forget(cur)
    found = None
    for step, low in reversed(steps):
        if found is not None:
            low = low.join(found.select(F.col("u").alias("c"), F.col("low").alias("later")), "c", "left").select("c", F.coalesce("later", "low").alias("low"))
        found = step.join(low, "c").select("u", "low")
    return found.select(F.col("u").alias("node"), F.col("low").alias("component"))


def active_edges(decisions: DataFrame, a: str, b: str, judgement: str, revoked: str) -> DataFrame:
    """Edges whose decision is positive and not revoked: judgements stay reversible."""
    return decisions.where((F.col(judgement) == "POSITIVE") & F.col(revoked).isNull()).select(a, b)


def canonical_names(votes: DataFrame, component: str, name: str, suffixes: tuple[str, ...]) -> DataFrame:
    """The name of each component: with a legal suffix first, then most votes, then longest, then the
    first in order."""
    legal = F.lit(False)
    for s in suffixes:
        legal = legal | F.endswith(F.col(name), F.lit(s))
    counted = votes.groupBy(component, name).agg(F.count("*").alias("votes"))
    key = F.struct((~legal).alias("l"), (-F.col("votes")).alias("v"), (-F.length(name)).alias("n"), F.col(name).alias("x"))
    return counted.groupBy(component).agg(F.min_by(name, key).alias("canonical"), F.sum("votes").alias("votes"))
