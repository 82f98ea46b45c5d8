"""MinHash near-dedup: bottom-k sketches of one hash function, inverted lists, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import Words, blocks, forget, lean, mixed, small_batches, written

#: Words in a shingle; the Jaccard similarity from which texts are linked, as a fraction.
SHINGLE, SIMILAR = 5, (75, 100)
#: Hash values that a sketch retains, and of these, how many two linked texts share at the least: six
#: standard deviations below SIMILAR x SKETCH (a link at the limit falls below with a chance of 6e-9).
SKETCH = 96
SHARED = math.floor(SKETCH * SIMILAR[0] / SIMILAR[1] - 6 * math.sqrt(SKETCH * 0.75 * 0.25))
#: A value that so many texts hold, or a MOST_HOT-th of all values, is hot; hot ones are looked for in a
#: SAMPLED-th of the texts, as they decide on nothing but the order of rarity and how lists are dealt.
HOT, MOST_HOT, SAMPLED = 20_000, 1_000_000, 16
#: Bits of the filter that picks the texts to read again, at most.
FILTER_BITS = 1 << 27
#: A list links its members to one pivot, in so many rounds at most, while the full comparison of the
#: lists would look at more than so many pairs for each of their rows (at first, while large groups
#: of copies are still apart, and later); members that meet in one block.
STAR_ROUNDS, FULL_PAIRS, BLOCK = 4, (8, 1000), 500

_COEFFICIENTS = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles (A-Z lower-cased)."""
    words = Words(texts, lower=True)
    h = words.hashes() if len(words.begin) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled += h[k : k + len(rolled)] * _COEFFICIENTS[k]
    rolled = mixed(rolled)
    for b, e in zip(words.first[:-1], words.first[1:], strict=True):
        if e - b >= SHINGLE:
            x = np.sort(rolled[b : e - SHINGLE + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif e > b:  # fewer words: the whole sequence is one shingle, of its own kind
            yield mixed(np.array([(h[b:e] * _COEFFICIENTS[: e - b]).sum(dtype=np.uint64) + np.uint64(e - b)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _lists_of(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), set_key (a 128-bit digest of the whole set), sketch (the SKETCH smallest
    hashes, as signed longs in unsigned order)."""

    def run(batches):
        for whole in batches:
            for b in blocks(whole, "text", 2 << 20):
                sets = list(shingle_sets(b.column("text")))
                key = [np.array([(s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64), mixed(s + _COEFFICIENTS[0]).sum(dtype=np.uint64)], np.uint64).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), _lists_of([s[:SKETCH] for s in sets])], ["id", "n", "set_key", "sketch"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "id long, n long, set_key binary, sketch array<long>")


def _shared(sets: DataFrame, column: str) -> DataFrame:
    """(value, id, n, df) for every value of `column` (sets of hashes) that another row has too. A
    value is counted where its rows meet. The lists of hot values would fill a task; those few (about
    2 x MOST_HOT at most) are told by a sample of the texts, met by broadcast and dealt over many
    tasks. Their df is what the sample says: it serves but to order values by rarity, alike for all."""
    post = sets.select("id", "n", F.explode(column).alias("value"))
    total = sets.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]
    least = max(HOT, total // MOST_HOT)
    sample = F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0
    hot = written(post.where(sample).groupBy("value").agg((F.count("*") * SAMPLED).alias("told")).where(F.col("told") >= max(2, least // 2)))
    dealt = post.join(F.broadcast(hot), "value", "left").withColumn("salt", F.when(F.col("told").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("told") / HOT))))
    return dealt.withColumn("df", F.coalesce("told", F.count("*").over(Window.partitionBy("value", "salt")))).where("df > 1").select("value", "id", "n", "df")


def _lists(sets: DataFrame, column: str, size: int | None) -> DataFrame:
    """The inverted lists of the values of whole sets, or of sketches of `size` of their values: (value,
    id, n, s, r). s is how many of a text's values any other text has; below what a link needs the
    text has no link. Its lists are its rarest shared values, r-th in rarity, as many as a linked text
    must share one of (prefix filtering). Sketches show a whole intersection only where the largest
    text that can be linked, of n x 100 / 75 shingles, fits a sketch too."""
    by_text = Window.partitionBy("id")
    need = F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1])
    if size:
        need = F.when(F.col("n") * SIMILAR[1] <= size * SIMILAR[0], need).otherwise(F.least(need, F.lit(SHARED)))
    ranked = _shared(sets, column).withColumn("s", F.count("*").over(by_text)).withColumn("r", F.row_number().over(by_text.orderBy("df", "value")).cast("long"))
    return ranked.where((F.col("s") >= need) & (F.col("r") <= F.col("s") - need + 1)).select("value", "id", "n", "s", "r")


def _met(lists: DataFrame) -> DataFrame:
    """The rows of lists that have several."""
    lists = written(lists)
    several = lists.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value")
    out = written(lists.join(several, "value", "left_semi"))
    forget(lists)
    return out


def _may_link(n1, s1, r1, n2, s2, r2):
    """Whether two texts that meet in a list of whole sets can be linked and this be the first value, in
    the order of rarity, that both have: sizes within the similarity, and as many shared values left
    in both as a link needs. Every linked pair passes in the list of its first value."""
    least, most = F.least(n1, n2), F.greatest(n1, n2)
    need = F.ceil((n1 + n2) * SIMILAR[0] / (SIMILAR[0] + SIMILAR[1]))
    return (least * SIMILAR[1] >= most * SIMILAR[0]) & (F.least(s1 - r1, s2 - r2) + 1 >= need)


def _id_filter(wanted: DataFrame):
    """A test of an array of ids: true for every wanted one, false for most others. A bit table of
    bounded size, 16 bits an id where that fits, so it can be broadcast whatever there is to find."""
    n = wanted.count()
    bits = min(FILTER_BITS, 1 << max(16, (16 * n).bit_length()))

    def place(ids: np.ndarray) -> np.ndarray:
        return mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(bits)

    def mark(batches):
        for b in batches:
            at = place(b.column("id").to_numpy(zero_copy_only=False))
            word, mask = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["word", "mask"])

    rows = wanted.select("id").mapInArrow(lean(mark), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    marks = rows.toArrow()  # bits / 64 rows at most
    table = np.zeros(bits >> 6, np.int64)
    table[marks.column("word").to_numpy()] = marks.column("mask").to_numpy()
    held = wanted.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def test(ids: np.ndarray) -> np.ndarray:
        at = place(ids)
        return ((held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)

    return test


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, s): the whole sets of the wanted ids. Texts stay where they are while the table is read
    again; what the bit filter lets through besides leaves in a join of the sets."""
    test = _id_filter(wanted)

    def sets(batches):
        for whole in batches:
            on = test(whole.column("id").to_numpy(zero_copy_only=False))
            for b in blocks(whole.filter(pa.array(on)), "text"):
                found = list(shingle_sets(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in found], pa.int64()), _lists_of(found)], ["id", "n", "s"])

    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null").mapInArrow(lean(sets), "id long, n long, s array<long>")
    return written(read.join(wanted, "id", "left_semi").dropDuplicates(["id"]))


def _overlap(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """The places, in the sorted union of two sets, of what both hold; and the union's size."""
    union = np.sort(np.concatenate([x, y]))
    twice = np.flatnonzero(union[1:] == union[:-1])
    return twice - np.arange(len(twice)), len(union) - len(twice)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (sorted unsigned hashes) are similar. Of the SKETCH smallest values of their
    union, which their sketches tell, SHARED at least must be in both; then the whole sets decide."""
    if min(len(x), len(y)) * SIMILAR[1] < max(len(x), len(y)) * SIMILAR[0]:
        return False
    if max(len(x), len(y)) > SKETCH and int((_overlap(x[:SKETCH], y[:SKETCH])[0] < SKETCH).sum()) < SHARED:
        return False
    both, union = _overlap(x, y)
    return SIMILAR[1] * len(both) >= SIMILAR[0] * union


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (a, b) that the union-sketch estimate lets pass and the full sets confirm; each pair meets
    its two sets in two joins."""

    def check(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            fx, fy = (c.values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (x, y))
            ox, oy = x.offsets.to_numpy(), y.offsets.to_numpy()
            mask = pa.array([linked(fx[ox[i] : ox[i + 1]], fy[oy[i] : oy[i + 1]]) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    both = pairs.join(full.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(full.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(lean(check), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in an edge (a, b): the smallest id reachable. Rounds of large-star
    and small-star, written between, until nothing changes; ids with few neighbours each round."""
    cur = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi")
    # Two rounds with equal edges: their number, and a sum and an exclusive or of their hashes.
    same = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("lo", "hi")).alias("x"), F.sum(F.xxhash64("hi", "lo").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))
    now = None
    while True:
        # Large star: each node's greater neighbours hang on its least neighbour (itself included).
        near = cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        # Small star: each node and its smaller neighbours hang on the least of them.
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_least, "hi")
        new = small.select("m", F.col("lo").alias("x")).unionByName(small_least.select("m", F.col("hi").alias("x"))).where("m < x").select(F.col("m").alias("lo"), F.col("x").alias("hi")).distinct()
        seen = Observation()
        old, cur = cur, written(new.observe(seen, *same))
        if now:
            forget(old)
        was, now = now, tuple(seen.get.values())
        if was == now:
            break
    return cur.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(cur.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def _links(lists: DataFrame, full: DataFrame) -> DataFrame | None:
    """(id, component) of all texts that have a link; None without any."""
    links = comp = None
    for k in range(STAR_ROUNDS + 1):
        # A member's component so far; a list asks nothing of members that are together already.
        marked = lists.withColumn("c", F.col("id")) if comp is None else lists.join(comp, "id", "left").select("value", "id", "n", "s", "r", F.coalesce("component", "id").alias("c"))
        # The pivot: first the member with the largest share of values in common with others, which is
        # the least edited of a group of copies; then members picked by a hash.
        rank = F.struct(-F.col("s") / F.col("n"), F.col("id")) if k == 0 else F.struct(F.xxhash64("c", F.lit(k)), F.xxhash64("id", F.lit(k)))
        size = Observation()
        # By component first: the pairs of a list that are still apart are all but those inside one.
        parts = marked.groupBy("value", "c").agg(F.count("*").alias("m"), F.min_by(F.struct("id", "n", "s", "r", "c"), rank).alias("p"), F.min(rank).alias("rank"))
        grouped = parts.groupBy("value").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m").cast("double")).alias("inside"), F.min_by("p", "rank").alias("p")).where("parts > 1").drop("parts")
        apart = (F.col("m") * F.col("m").cast("double") - F.col("inside")) / 2
        open_lists = written(grouped.observe(size, F.coalesce(F.sum("m"), F.lit(0)).alias("rows"), F.coalesce(F.sum(apart), F.lit(0)).alias("pairs")))
        rows, pairs = size.get["rows"], size.get["pairs"]
        if not rows:
            forget(open_lists)
            break
        last = k == STAR_ROUNDS or pairs <= FULL_PAIRS[min(k, 1)] * rows
        if not last:
            fits = _may_link(F.col("n"), F.col("s"), F.col("r"), F.col("p.n"), F.col("p.s"), F.col("p.r"))
            offers = marked.join(open_lists, "value").where((F.col("c") != F.col("p.c")) & fits).select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
        else:
            # A long list falls into blocks, and each two of them (and each one with itself) meet in a
            # group of their own, so no task holds a whole list.
            blocks_of = F.ceil(F.col("m") / BLOCK).cast("int")
            blocked = marked.join(open_lists.select("value", "m"), "value").withColumn("i", F.pmod(F.xxhash64("id"), blocks_of).cast("int"))
            left = blocked.withColumn("j", F.explode(F.sequence(F.lit(0), blocks_of - 1))).select("value", F.least("i", "j").alias("g"), F.greatest("i", "j").alias("h"), "i", "id", "n", "s", "r", "c")
            other = left.select("value", "g", "h", *[F.col(x).alias(f"{x}2") for x in ("i", "id", "n", "s", "r", "c")])
            fits = _may_link(F.col("n"), F.col("s"), F.col("r"), F.col("n2"), F.col("s2"), F.col("r2"))
            once = (F.col("g") == F.col("h")) | (F.col("i") != F.col("i2"))
            offers = left.join(other, ["value", "g", "h"]).where((F.col("id") < F.col("id2")) & once & (F.col("c") != F.col("c2")) & fits).select(F.col("id").alias("a"), F.col("id2").alias("b"))
        found = _verified(offers.distinct(), full)
        forget(open_lists)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            comp = written(components(links))
        if last:
            break
    return comp


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, class_id (the smallest id with the same shingle
    set), component_id (the smallest id reachable over links), kept (id = component_id).

    Links join texts whose shingle sets have 100 x intersection >= 75 x union. Texts with equal sets
    are first collapsed to a class, so copies meet nothing but their own sums. Each class keeps a
    bottom-k sketch; a text with too few values in common with any other has no link, and of the rest
    the rarest shared values go into inverted lists. The texts that these leave are read again, and
    lists are made anew from their whole sets. For some rounds each list offers links of its members
    to one pivot (another each round, so a list's offers grow with its rows); offers go past the
    union-sketch estimate, then full sets confirm them, and members of one component are not offered
    again. What is then left between different components of a list, and can be linked by sizes and
    places in the lists, is compared in full, in blocks, whatever the list's length: no cap.

    Sets are of 64-bit hashes of shingles, classes of 128-bit digests of sets. A sketch misses a link
    that stands at the limit with a chance of about 6e-9, and none of texts of 72 shingles or fewer.

    Null, empty and blank texts have an empty set and are linked with nothing. Fewer than five words
    are one shingle. Repeated rows (an id twice) share a class if their texts agree; an id whose rows
    differ in text is not supported as a key and gets one row each. Ids must be integers; a row with
    a null id is linked with nothing, has null class and component, and is kept. Other columns are
    ignored.
    """
    rows = written(sketched(docs, id_col, text_col))
    classes = written(rows.where("n > 0 and id is not null").groupBy("set_key", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min_by("sketch", "id").alias("sketch")))
    met = _met(_lists(classes, "sketch", SKETCH))
    candidates = written(met.select("id").distinct())
    full = _full_sets(docs, candidates, id_col, text_col)
    forget(met, candidates)
    # The texts that may have a link are few; their lists are made anew from their whole sets.
    lists = _met(_lists(full, "s", None))
    comp = _links(lists, full)
    forget(lists, full)
    named = classes.select("set_key", "n", F.col("id").alias("class_id"), "copies")
    if comp is None:
        named = named.withColumn("component", F.col("class_id"))
    else:
        named = named.join(comp.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    # Classes of many copies are few (at most 1,000 by their size) and broadcast, lest one fill a task.
    hot = F.col("copies") >= max(1000, rows.count() // 1000)
    keyed = rows.select("id", "n", "set_key")
    plain = ["set_key", "n", "class_id", "component"]
    if classes.where(hot).isEmpty():
        met = keyed.join(named.select(plain), ["set_key", "n"], "left")
    else:
        large = F.broadcast(written(named.where(hot).select(plain)))
        met = keyed.join(large, ["set_key", "n"], "left_anti").join(named.where(~hot).select(plain), ["set_key", "n"], "left").unionByName(keyed.join(large, ["set_key", "n"]))
    of = lambda name: F.when(F.col("id").isNotNull(), F.coalesce(name, "id"))
    return met.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), of("class_id").alias("class_id"), of("component").alias("component_id"), F.col("id").eqNullSafe(of("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one document of each component, with the columns of docs. Rows with
    a null id stay; an id that occurs again stays once or not at all as its component decides."""
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
