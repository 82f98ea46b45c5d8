"""Exact dedup against history through minimal perfect hashes of digests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, forget, mixed, written

#: Distinct digests that one page holds, about; slots per key and level while a page is built.
PAGE_KEYS, SPREAD = 50_000, 2.0

_PAGE = "page int, n_slots long, levels binary, ranks binary, digests binary, ids binary, lengths binary, counts binary"
_GROUP = "digest binary, group_size long, keep_id long, in_history boolean"
#: Stands for a null id: it loses to any other.
_NO_ID = (1 << 63) - 1


def _slots(keys: np.ndarray, level: int, width: int) -> np.ndarray:
    return (mixed(keys + np.uint64((level * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))) % np.uint64(width)).astype(np.int64)


def build_page(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A minimal perfect hash over distinct 32-byte digests (rows of uint8): bit levels, where each key
    takes the first level at which no other remaining key has its bit, and for each level the number
    of bits set before it. A key's slot is the rank of its bit: 0..n-1, each once."""
    keys = digests[:, :8].copy().view(np.uint64).ravel()
    extra = digests[:, 8:16].copy().view(np.uint64).ravel()
    left, levels, level = np.arange(len(keys)), [], 0
    while len(left):
        width = max(64, int(len(left) * SPREAD))
        at = _slots(keys[left] ^ (extra[left] * np.uint64(level + 1)), level, width)
        seen = np.bincount(at, minlength=width)
        levels.append(seen == 1)
        left = left[seen[at] > 1]
        level += 1
        if level > 200:
            raise ValueError("equal 128-bit prefixes of distinct digests")
    return levels, np.concatenate([[0], np.cumsum([int(b.sum()) for b in levels])]).astype(np.int64)


def look_up(levels: list[np.ndarray], ranks: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The slot of each digest; -1 where no level has its bit. A slot of a nonmember is arbitrary, so
    callers compare the bytes that the slot holds."""
    keys = digests[:, :8].copy().view(np.uint64).ravel()
    extra = digests[:, 8:16].copy().view(np.uint64).ravel()
    out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    for level, bits in enumerate(levels):
        if not len(left):
            break
        at = _slots(keys[left] ^ (extra[left] * np.uint64(level + 1)), level, len(bits))
        hit = bits[at]
        before = np.concatenate([[0], np.cumsum(bits)])
        out[left[hit]] = ranks[level] + before[at[hit]]
        left = left[~hit]
    return out


def _as_rows(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), 32) if len(column) else np.zeros((0, 32), np.uint8)


def _pack_page(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _as_rows(pdf["digest"])
    levels, ranks = build_page(digests)
    order = np.argsort(look_up(levels, ranks, digests))
    widths = np.array([len(b) for b in levels], np.int64)
    bits = np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8)
    return pd.DataFrame(
        {
            "page": [int(pdf["page"].iloc[0])],
            "n_slots": [len(digests)],
            "levels": [widths.tobytes() + bits.tobytes()],
            "ranks": [ranks.tobytes()],
            "digests": [digests[order].tobytes()],
            "ids": [pdf["keep_id"].to_numpy(np.int64)[order].tobytes()],
            "lengths": [pdf["keep_length"].to_numpy(np.int64)[order].tobytes()],
            "counts": [pdf["n"].to_numpy(np.int64)[order].tobytes()],
        }
    )


def _unpack_levels(row) -> tuple[list[np.ndarray], np.ndarray]:
    ranks = np.frombuffer(row.ranks, np.int64)
    n = len(ranks) - 1
    widths = np.frombuffer(row.levels, np.int64, n)
    bits = np.unpackbits(np.frombuffer(row.levels, np.uint8, offset=8 * n))[: int(widths.sum())].astype(bool)
    return [bits[b - w : b] for w, b in zip(widths, np.cumsum(widths), strict=True)], ranks


def _probe(new: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
    """The groups of one page: a row for each slot, with what the new rows' digests that it holds add to
    it, and a row for each new digest that no slot holds."""
    digests = _as_rows(new["digest"])
    counts, ids, lengths = (new[c].to_numpy(np.int64) for c in ("n", "keep_id", "keep_length"))
    held, total, winner = digests[:0], counts[:0], ids[:0]
    outside = np.ones(len(new), bool)
    if len(pages):
        row = next(pages.itertuples())
        held = np.frombuffer(row.digests, np.uint8).reshape(-1, 32)
        total, winner, length = (np.frombuffer(x, np.int64).copy() for x in (row.counts, row.ids, row.lengths))
        slot = look_up(*_unpack_levels(row), digests)
        outside = slot < 0
        met = np.flatnonzero(~outside)
        outside[met] = (held[slot[met]] != digests[met]).any(axis=1)
        member = ~outside
        at = slot[member]  # digests are distinct, and so are their slots
        total[at] += counts[member]
        better = (lengths[member] > length[at]) | ((lengths[member] == length[at]) & (ids[member] < winner[at]))
        winner[at[better]] = ids[member][better]
    rows = [x.tobytes() for x in held] + [x.tobytes() for x in digests[outside]]
    old = np.arange(len(rows)) < len(held)
    return pd.DataFrame({"digest": rows, "group_size": np.concatenate([total, counts[outside]]), "keep_id": np.concatenate([winner, ids[outside]]), "in_history": old})


def digested(text_col: str) -> Column:
    """The sha256 of a text in UTF-8 after deleting all white space; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), "".join(map(chr, SPACES)), ""), 256))


def _winners(keys: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("id", "length"), F.struct("length", -F.coalesce(F.col("id"), F.lit(_NO_ID))))
    return keys.groupBy("digest").agg(F.count("*").alias("n"), best.alias("best")).select("digest", "n", F.coalesce(F.col("best.id"), F.lit(_NO_ID)).alias("keep_id"), F.col("best.length").alias("keep_length"))


def _page(n_pages: int) -> Column:
    return (F.conv(F.hex(F.substring("digest", 17, 4)), 16, 10).cast("long") % n_pages).cast("int")


def build_index(winners: DataFrame, n_pages: int) -> DataFrame:
    """Pages of minimal perfect hashes over the distinct digests of `winners`; each page is a row whose
    slots hold full digests, the winner's id and length, and the number of rows."""
    return winners.withColumn("page", _page(n_pages)).select("page", "digest", "n", "keep_id", "keep_length").groupBy("page").applyInPandas(_pack_page, _PAGE)


def exact_dedup(docs: DataFrame, historical: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, length, digest, keep_id, group_size, kept, in_history.

    Rows where `historical` holds (a condition on the columns of docs) come first: their distinct
    digests, with the best row of each, go into pages of minimal perfect hashes, written to the
    shared folder. The rest is summed by digest before any lookup, so thousands of copies are one
    probe. A probe that finds a slot compares all 32 bytes: a member adds to the slot's count and
    contends with its winner, and is gone; nonmembers stay groups of their own. So a group's rows and
    winner come from the slot, and no digest of the past is grouped with new ones. Of equal texts the row with the most code points, then the
    smallest id, stays, wherever it stood.

    Null texts count as empty. Null ids lose to any id. Of repeated rows with the winner's id and
    text, all are marked kept (they cannot be told apart). Only digests met at least
    max(1000, rows / 1000) times, 1,000 at most, are broadcast; the others meet their winner in a
    shuffle join, so that no hot digest fills one task.
    """
    length = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    keys = written(docs.select(F.col(id_col).alias("id"), F.coalesce(historical, F.lit(False)).alias("old"), length.alias("length"), digested(text_col).alias("digest")))
    past, new = _winners(keys.where("old")), _winners(keys.where("not old"))
    rows = keys.count()
    n_pages = max(1, math.ceil(rows / PAGE_KEYS))
    index = written(build_index(past, n_pages))
    probes = new.withColumn("page", _page(n_pages))
    groups = written(probes.groupBy("page").cogroup(index.groupBy("page")).applyInPandas(_probe, _GROUP))
    forget(index)
    least = max(1000, rows // 1000)
    hot = groups.where(F.col("group_size") >= least)
    cold = keys.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups, "digest")
    both = keys.join(F.broadcast(hot), "digest").unionByName(cold)
    keep_id = F.when(F.col("keep_id") == F.lit(_NO_ID), F.col("id")).otherwise(F.col("keep_id"))
    return both.select("id", "length", "digest", keep_id.alias("keep_id"), "group_size", F.col("id").eqNullSafe(keep_id).alias("kept"), "in_history")


def exact_dedup_docs(docs: DataFrame, historical: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs; edge cases as in exact_dedup."""
    dropped = exact_dedup(docs, historical, id_col, text_col).where("not kept").select(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    return docs.join(dropped, docs[id_col].eqNullSafe(dropped["__id"]) & (digested(text_col) == dropped["__digest"]), "left_anti")
