"""Histogram sort into shards of near-equal bytes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A round counts the bytes below this many candidate boundaries inside each open interval.
PROBE_BITS = 12
#: A group of equal texts is cut only where keeping it whole would put a boundary off by more than
#: this share of a shard.
CUT_SHARE = 0.02


def _u64(value: int) -> int:
    """An unsigned key as Spark's signed long, order kept."""
    return value - (1 << 63)


def _refine(keys: DataFrame, column: str, goals: dict[int, int], weight: dict[int, int], tolerance: int, whole: int, within=None) -> dict[int, tuple[int, int, int, bool]]:
    """For each goal (bytes that should lie below a splitter) the boundary found: (low, width in
    bits, bytes below low, met). Every round is one aggregation of exact byte counts between the
    probes of the open intervals, at most 2**PROBE_BITS rows for each of them."""
    open_, done = {i: (0, 64, weight.get(i, 0)) for i in goals}, {}
    unsigned = F.col(column)
    while open_:
        width = max(w for _, w, _ in open_.values())
        step = max(0, width - PROBE_BITS)
        prefixes = sorted({low >> width for low, _, _ in open_.values()}) if width < 64 else [0]
        bin_ = F.shiftrightunsigned(unsigned, step) if step else unsigned
        rows = keys if within is None else keys.where(within)
        if width < 64:
            rows = rows.where(F.shiftrightunsigned(unsigned, width).isin(prefixes))
        counted = rows.groupBy(bin_.alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        mass: dict[int, dict[int, tuple[int, int]]] = {p: {} for p in prefixes}
        for r in counted:
            at = r["bin"] & ((1 << 64) - 1)
            mass[at >> (width - step) if width < 64 else 0][at] = (r["bytes"], r["n"])
        for i, (low, _, below) in list(open_.items()):
            run, found = below, None
            for at in sorted(mass[low >> width if width < 64 else 0]):
                more, n = mass[low >> width if width < 64 else 0][at]
                if run + more > goals[i]:
                    found = (at << step, run, more, n)
                    break
                run += more
            if found is None:  # the goal is the interval's end
                end = (low + (1 << width)) if width < 64 else 1 << 64
                done[i] = (end, 0, run, True)
                del open_[i]
                continue
            at, run, more, n = found
            # One row cannot be cut: the nearer side of it is the best boundary there is. Nor is one key
            # whose nearer side is near enough.
            off = min(goals[i] - run, run + more - goals[i])
            stay = n == 1 or step == 0 and off <= whole
            if goals[i] - run <= tolerance or stay and off == goals[i] - run:
                done[i] = (at, 0, run, True)
            elif run + more - goals[i] <= tolerance or stay:
                done[i] = (at + (1 << step), 0, run + more, True)
            elif step == 0:
                done[i] = (at, 0, run, False)
            else:
                open_[i] = (at, step, run)
                continue
            del open_[i]
    return done


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs dealt into `shards` runs of the order (hash of the text, id), near equal in bytes.

    A row's size is the UTF-8 length of its text (null: 0) plus 8. Splitters are found by rounds of
    exact byte counts below candidate boundaries: 4,096 probes in every interval that holds an unmet
    splitter, until the bytes below a boundary are within `tolerance` of a shard's share. Only these
    counts reach the driver (at most shards x 4,096 rows a round, whatever the input). Equal texts
    share a hash, so a group stays in one shard unless both its ends are off a boundary's place by
    more than CUT_SHARE of a shard; then the same search over ids cuts inside the group. Rows move once, at the
    end, and slots come from ranks in cells of key ranges plus the counts of earlier cells, so no
    task holds a whole shard.

    Null ids sort first. Repeated rows each get a slot; rows equal in text and id (null ids too) have
    no order among themselves, so they stay in one shard and one cell, however many they are. With fewer rows than shards some shards stay
    empty. An empty table gives an empty result. Other columns of docs are ignored, whatever their
    names. Returns id, size, text_crc32 (of a null text: 0), key_hash, shard and slot.
    """
    empty = F.coalesce(F.col(text_col), F.lit(""))
    keys = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(empty) + 8).cast("long").alias("size"),
            F.crc32(empty.cast("binary")).alias("text_crc32"),
            F.xxhash64(empty).alias("key"),
        )
    )
    spark = docs.sparkSession
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    goals = {i: total * i // shards for i in range(1, shards)}
    slack = max(0, int(total / shards * tolerance))
    first = _refine(keys, "key", goals, {}, slack, int(total / shards * CUT_SHARE)) if total else {}
    # Splitters (key, id) as unsigned pairs; id None stands before every row of that key.
    splitters: dict[int, tuple[int, int | None]] = {i: (low, None) for i, (low, _, _, met) in first.items() if met}
    heavy: dict[int, list[int]] = {}
    for i, (low, _, _, met) in first.items():
        if not met:
            heavy.setdefault(low, []).append(i)
    shifted = keys.withColumn("sid", F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63))))
    for low, members in heavy.items():
        signed = low - (1 << 64) if low >= 1 << 63 else low
        cut = _refine(shifted, "sid", {i: goals[i] for i in members}, {i: first[i][2] for i in members}, slack, 0, F.col("key") == F.lit(signed))
        for i in members:
            splitters[i] = (low, cut[i][0])
    # Comparison of unsigned values as signed longs: flip the top bit on both sides.
    ukey = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    uid = F.col("sid").bitwiseXOR(F.lit(-(1 << 63)))
    shard = F.lit(0)
    for low, cut in splitters.values():
        if low >= 1 << 64:
            continue
        past = ukey >= F.lit(_u64(low))
        if cut is not None:
            past = (ukey > F.lit(_u64(low))) | ((ukey == F.lit(_u64(low))) & (uid >= F.lit(_u64(cut)) if cut < 1 << 64 else F.lit(False)))
        shard = shard + past.cast("int")
    signed_heavy = [low - (1 << 64) if low >= 1 << 63 else low for low in heavy]
    cell = F.shiftrightunsigned("key", 64 - PROBE_BITS)
    inner = F.lit(0).cast("long")
    if signed_heavy:
        # A heavy key's rows leave its cell for cells of their own, by id.
        span = shifted.where(F.col("key").isin(signed_heavy)).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        lo, hi = span["lo"] or 0, span["hi"] or 0
        part = F.floor((F.coalesce(F.col("id"), F.lit(lo)) - F.lit(lo)) / F.lit((hi - lo) // (1 << PROBE_BITS) + 1)) + 1
        inner = F.when(F.col("key").isin(signed_heavy), part).otherwise(0).cast("long")
    placed = shifted.select("id", "size", "text_crc32", "key", shard.cast("int").alias("shard"), cell.alias("cell"), inner.alias("inner"))
    counts = placed.groupBy("shard", "cell", "inner").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell", "inner").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", "inner", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "cell", "inner").orderBy("key", F.col("id").asc_nulls_first(), "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.join(offsets, ["shard", "cell", "inner"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.col("key").alias("key_hash"), "shard", (F.col("rank") + F.col("offset")).cast("long").alias("slot")
    )
