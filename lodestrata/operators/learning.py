"""A small ranking model: weighted logistic regression by full-batch gradient descent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rate and rounds of the descent.
RATE, ROUNDS = 0.05, 800


def gram_ready(rows: DataFrame, features: list[str], label: str, weight: str) -> list:
    """Rows with equal features and label summed to one: what the descent needs, whatever the number of
    rows. With counts and bucketed values as features the distinct ones stay few."""
    x = F.struct(*[F.coalesce(F.col(f), F.lit(0.0)).cast("double").alias(f) for f in features])
    return rows.groupBy(x.alias("x"), F.col(label).alias("y")).agg(F.sum(weight).alias("w")).collect()


def fit_logistic(rows: DataFrame, features: list[str], label: str, weight: str, l2: float = 0.01, rate: float = RATE, rounds: int = ROUNDS, most_distinct: int = 2_000_000) -> dict[str, float]:
    """Weights by name and `intercept`. The intercept begins at the smoothed log-odds; L2 holds for the
    weights alone. Distinct weighted rows reach the driver; more than `most_distinct` of them is an
    error, not a sample (bucket the features, or use fit_distributed)."""
    n = rows.select(*features, label).distinct().limit(most_distinct + 1).count()
    if n > most_distinct:
        raise ValueError(f"more than {most_distinct} distinct rows: use fit_distributed")
    got = gram_ready(rows, features, label, weight)
    x = np.array([list(r["x"]) for r in got], float).reshape(len(got), len(features))
    y, w = np.array([float(r["y"]) for r in got]), np.array([float(r["w"]) for r in got])
    order = np.lexsort(np.column_stack([x, y, w]).T)
    x, y, w = x[order], y[order], w[order]
    total, positive = w.sum(), (w * y).sum()
    b, beta = float(np.log((positive + 1) / (total - positive + 1))), np.zeros(len(features))
    for _ in range(rounds):
        z = x @ beta + b
        p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
        e = w * (p - y) / max(total, 1e-12)
        beta, b = beta - rate * (x.T @ e + l2 * beta), b - rate * e.sum()
    return {**dict(zip(features, beta.tolist(), strict=True)), "intercept": b}


def fit_distributed(rows: DataFrame, features: list[str], label: str, weight: str, l2: float = 0.01, rate: float = RATE, rounds: int = 50) -> dict[str, float]:
    """The same descent with each round's gradient as one aggregation; only sums reach the driver."""
    w0 = rows.agg(F.sum(weight).alias("t"), F.sum(F.col(weight) * F.col(label)).alias("p")).first()
    beta, b = [0.0] * len(features), float(np.log((w0["p"] + 1) / (w0["t"] - w0["p"] + 1)))
    for _ in range(rounds):
        z = F.lit(b)
        for f, v in zip(features, beta, strict=True):
            z = z + F.col(f) * F.lit(v)
        e = F.col(weight) * (1 / (1 + F.exp(-z)) - F.col(label)) / F.lit(float(w0["t"]))
        g = rows.select(e.alias("e"), *features).agg(F.sum("e"), *[F.sum(F.col("e") * F.col(f)) for f in features]).first()
        beta, b = [v - rate * (g[i + 1] + l2 * v) for i, v in enumerate(beta)], b - rate * g[0]
    return {**dict(zip(features, beta, strict=True)), "intercept": b}


def apply_logistic(df: DataFrame, model: dict[str, float], name: str = "score") -> DataFrame:
    z = F.lit(model["intercept"])
    for f, v in model.items():
        if f != "intercept":
            z = z + F.coalesce(F.col(f), F.lit(0.0)) * F.lit(v)
    return df.withColumn(name, 1 / (1 + F.exp(-z)))


def blend(prior, learned, share: float):
    """The prior and the learned score, mixed."""
    return prior * (1 - share) + learned * share
