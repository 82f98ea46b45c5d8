"""Exact top-k inner products by no-random-access aggregation over sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Candidates and queries in a block; the shares of the lists that have been read when bounds are
#: looked at; from this share of open pairs down each open pair is read by itself.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 512
DEPTHS = (0.5, 0.7, 0.8, 0.875, 0.95, 1.0)
FEW = 1 / 16


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) for each component as double; vectors that are null, empty, or hold
    null or non-finite components, and null ids, are left out."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    held = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~F.coalesce(bad, F.lit(True)))
    return held.select("id", F.transform("x", lambda e: F.floor(e * float(scale)).cast("double")).alias("v")).distinct()


def _sorted_access(x: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None, depths=DEPTHS) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """For each query the rows of x that may be among its k best, and their scores; and how many
    (query, row) pairs are open after each look at the bounds. `floor` is a score for each query that
    its k-th best is known to reach.

    Each component is a list of the rows, sorted by value; a query with a positive weight reads it
    from the top, with a negative one from the bottom. All lists are read to the same depth. What they
    have shown of a row adds up; its score lies between that plus the worst that the rest of each list
    in which it has not come up holds, and the same plus the value last read there. A row whose upper
    bound is below the k-th lower bound cannot qualify and is read no further. The others read on; at
    the lists' end all is shown, and what has added up is the score."""
    n, d = x.shape
    k = min(k, n)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    order = np.argsort(x, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n)[:, None], (n, d)), axis=0)
    ranked = np.take_along_axis(x, order, axis=0)
    low, high = ranked[0], ranked[-1]
    shown = np.zeros((len(q), n))
    open_ = np.ones((len(q), n), bool)
    floor = np.full(len(q), -np.inf) if floor is None else floor.copy()
    left, was = [], 0
    for depth in depths:
        read = n if depth >= 1 else int(depth * n)
        if read <= was:
            continue
        front_top, front_bottom = ranked[max(n - read, 0)], ranked[read - 1]
        if open_.mean() > FEW:
            top, bottom = place >= n - read, place < read  # come up by now, from either end
            shown += up @ (x * (top & (place < n - was))).T + down @ (x * (bottom & (place >= was))).T
            lower = shown + up @ (low * ~top).T + down @ (high * ~bottom).T
            upper = shown + up @ (front_top * ~top).T + down @ (front_bottom * ~bottom).T
        else:
            lower, upper = np.full_like(shown, -np.inf), np.full_like(shown, -np.inf)
            of, row = np.nonzero(open_)
            for b in range(0, len(of), 1 << 14):
                i, j = of[b : b + (1 << 14)], row[b : b + (1 << 14)]
                at, weight, value = place[j], q[i], x[j]
                since = np.where(weight > 0, n - 1 - at, at)  # how deep each list shows the row
                shown[i, j] += (weight * value * ((since >= was) & (since < read))).sum(axis=1)
                hidden = weight * (since >= read)
                lower[i, j] = shown[i, j] + (hidden * np.where(weight > 0, low, high)).sum(axis=1)
                upper[i, j] = shown[i, j] + (hidden * np.where(weight > 0, front_top, front_bottom)).sum(axis=1)
        floor = np.maximum(floor, np.partition(np.where(open_, lower, -np.inf), n - k, axis=1)[:, n - k])
        open_ &= upper >= floor[:, None]
        was = read
        left.append(int(open_.sum()))
    return [(rows := np.flatnonzero(open_[i]), shown[i, rows]) for i in range(len(q))], left


def _block_pack(pdf: pd.DataFrame) -> pd.DataFrame:
    v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "dim": [v.shape[1]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "floors": [pdf["floor"].to_numpy(np.float64).tobytes()], "v": [v.tobytes()]})


def _blocks(rows: DataFrame, n_blocks: int) -> DataFrame:
    block = (F.pmod(F.xxhash64("v", "id"), F.lit(n_blocks))).cast("int")
    return rows.withColumn("block", block).withColumn("dim", F.size("v")).groupBy("block", "dim").applyInPandas(_block_pack, "block int, dim int, ids binary, floors binary, v binary")


def _meet(cand: DataFrame, quer: DataFrame, n_q: int, tasks: int, which, k: int) -> DataFrame:
    """(query_id, id, score) of the k best entries at least that each block of queries finds in each
    block of entries for which `which` (a condition on block and qb) holds."""
    asked = quer.select(F.col("block").alias("qb"), "dim", F.col("ids").alias("q_ids"), "floors", F.col("v").alias("q_v"))
    meet = cand.drop("floors").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).where(which).join(asked, ["qb", "dim"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                ids, q_ids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.q_ids, np.int64)
                x, q = np.frombuffer(row.v).reshape(-1, row.dim), np.frombuffer(row.q_v).reshape(-1, row.dim)
                found, _ = _sorted_access(x, q, k, np.frombuffer(row.floors))
                qs, es, ss = [], [], []
                for i, (r, s) in enumerate(found):
                    best = np.lexsort((ids[r], -s))[:k]
                    qs.append(np.full(len(best), q_ids[i]))
                    es.append(ids[r[best]])
                    ss.append(s[best])
                yield pd.DataFrame({"query_id": np.concatenate(qs), "id": np.concatenate(es), "score": np.concatenate(ss).astype(np.int64)})

    return meet.repartition(tasks, "qb", "block").mapInPandas(run, "query_id long, id long, score long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """For each query (id divisible by `every`) its k highest inner products over all other rows.

    Equal vectors are one entry with their k + 1 smallest ids, summed before anything meets, so a very
    common vector is one row however many ids it has. Entries and queries are packed into blocks of
    bounded size. A query block meets one block of entries first; the k-th score found there is a
    floor that its queries carry to the other blocks, each in a task of its own that runs the
    sorted-list aggregation and passes on k + 1 entries a query; the best of these are ranked.

    Ties go to the smaller id; a query with fewer candidates gets them all. A row that repeats (same
    id and vector) counts once; other rows with the query's id are the query's own. Vectors of
    different lengths do not meet. Scores are exact while their sums stay below 2**52.
    Returns query_id, rank (from 1), id, score (long).
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    rows = written(rows)
    # The k + 1 smallest ids of each distinct vector, found by ranks in salted groups first.
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    in_salt = Window.partitionBy("v", "salt").orderBy("id")
    few = rows.withColumn("salt", salt).withColumn("r", F.row_number().over(in_salt)).where(F.col("r") <= k + 1).select("id", "v")
    entries = written(few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids")).select("v", "ids", F.element_at("ids", 1).alias("id")))
    n = entries.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    asked = rows.where(F.col("id") % every == 0)
    n_q = max(1, -(-asked.count() // BLOCK_QUERIES))
    n_b = max(1, -(-n // BLOCK_ROWS))
    no_floor = F.lit(float("-inf")).alias("floor")
    cand = written(_blocks(entries.select("id", "v", no_floor), n_b))
    # One entry more than k, as one may be the query itself and no other.
    home = F.col("block") == F.col("qb") % n_b
    first = written(_meet(cand, _blocks(asked.select("id", "v", no_floor), n_q), n_q, n_q, home, k + 1))
    if n_b > 1:
        floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") > k)
        known = asked.join(floors, asked["id"] == floors["query_id"], "left").select("id", "v", F.coalesce(F.col("least").cast("double"), no_floor).alias("floor"))
        got = first.unionByName(_meet(cand, _blocks(known, n_q), n_q, n_b * n_q, ~home, k + 1))
    else:
        got = first
    # An entry's rank among entries bounds its ids' ranks, so k + 1 entries a query are enough.
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = got.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).select("query_id", "id", "score")
    named = best.join(entries.select("id", "ids"), "id").select("query_id", F.explode("ids").alias("id"), "score").where("id != query_id")
    return named.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
