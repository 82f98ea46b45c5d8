"""Token-id files by Re-Pair grammar compression, with random access by document."""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, blocks, kept, lean, scratch, small_batches
from .wordcache import UnitEncoder

#: The id that ends each document. Ids in a shard, about; how often a pair must occur in it to become
#: a rule.
END, SHARD_IDS, LEAST_COUNT = 1, 1 << 20, 64
#: Pairs are counted in so many buckets, as a power of two, at most.
_BUCKET_BITS = 20
_FAR = np.int32(2**31 - 1)


def _units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, with a last comma or full stop after a letter apart (the tokenizer's pattern parts them
    there too), so that fewer are distinct; and each text's first."""
    data, begin, end = words.data, words.begin, words.end
    if not len(begin):
        return begin, end, words.first
    last, prior, lead = data[end - 1], data[np.maximum(end - 2, 0)], data[np.maximum(end - 3, 0)]
    letter = ((prior | 32) >= 97) & ((prior | 32) <= 122) & (prior < 128) & (end - begin >= 2)
    letter |= (lead == 0xC3) & (prior >= 0x80) & (prior != 0x97) & (prior != 0xB7) & (end - begin >= 3)
    cut = ((last == 44) | (last == 46)) & letter
    count = np.concatenate([[0], np.cumsum(1 + cut)])
    b, e = np.repeat(begin, 1 + cut), np.repeat(end, 1 + cut)
    second = count[1:][cut] - 1
    b[second] = e[second] - 1
    e[second - 1] -= 1
    return b, e, count[words.first]


class WordEncoder(UnitEncoder):
    """Ids of whole texts through the tokenizers library, one call for each distinct word.

    The tokenizer's own splitting never joins what stands on both sides of ASCII white space (its
    normaliser maps white space to a space, its pattern has no piece with white space, and no letter
    composes with a space), so the ids of a text are those of its words, one after another. Its special
    tokens hold no white space either; where a text spells one out, the library makes it that token,
    and so does this."""

    end = END

    def __init__(self, path: str):
        super().__init__(most=1_200_000)  # about 200 MB
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # Words of small ASCII letters need no normalising, and each is one piece.
        self.letters.normalizer, self.letters.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        for t in (self.tokenizer, self.letters):
            t.model._resize_cache(0)  # every word comes once
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The worker's encoder for a file; later tasks in the same worker find its words learnt."""
        return kept("repair", path, lambda: cls(path))

    def _units(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _units(words)

    def _ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word. A word of letters alone is one piece of the tokenizer's pattern, so many of
        them go to a call, parted at the ids that end words: ASCII ones past the normaliser, others
        through it."""
        words = [u.decode("utf-8", "replace") for u in units]
        letters = np.fromiter(map(bytes.isalpha, units), bool, len(units))  # ASCII letters alone
        joined = np.fromiter(map(str.isalpha, words), bool, len(units)) & ~letters
        single, parts = np.flatnonzero(~letters & ~joined), []
        for tokenizer, which, fold in ((self.letters, np.flatnonzero(letters), str.lower), (self.tokenizer, np.flatnonzero(joined), str)):
            runs = [which[k : k + 128] for k in range(0, len(which), 128)]
            flat, size = self._encoded(tokenizer, [fold(" ".join([words[i] for i in r.tolist()])) for r in runs])
            ends = self.ends_word[flat]
            size = np.repeat(np.arange(len(runs)), size)
            whole = np.bincount(size[ends], minlength=len(runs)) == [len(r) for r in runs]
            single = np.concatenate([single, *[r for r, ok in zip(runs, whole, strict=True) if not ok]])
            flat, ends = (flat, ends) if whole.all() else (flat[whole[size]], ends[whole[size]])
            parts.append((np.concatenate([single[:0], *[r for r, ok in zip(runs, whole, strict=True) if ok]]), flat, np.diff(np.flatnonzero(ends), prepend=-1)))
        parts.append((single, *self._encoded(self.tokenizer, [words[i] for i in single.tolist()])))
        ids, size = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.argsort(np.concatenate([p[0] for p in parts]))
        at, length = (np.cumsum(size) - size)[order], size[order]
        past = np.cumsum(length)
        return ids[np.repeat(at - (past - length), length) + np.arange(len(ids))], length

    @staticmethod
    def _encoded(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and each text's number."""
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum())), size


def compress(ids: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """A Re-Pair grammar of one shard: `symbols` (ids, then nonterminals from `base` on), `sizes` in
    symbols by document, `rules` (pairs) and `lengths` (ids each rule expands to).

    A round counts the pairs of neighbours inside documents, and replaces by nonterminals those that
    occur LEAST_COUNT times or more: all such pairs at once, where two overlap the more frequent one
    first. Rounds go on until no pair is frequent, or none of those that are can be taken half as often.
    A pair that waits for the one in its bucket comes in when a round takes nothing. After the first
    round only places are counted that can be of a frequent pair: those left over of pairs that were,
    and those beside a new nonterminal."""
    seq, base, total = ids.astype(np.uint32), int(ids.max(initial=0)) + 1, len(ids)
    rules, lengths, n, waiting = [], [], base, False
    ends = np.zeros(total + 1, bool)  # the last symbol of each document
    ends[np.cumsum(sizes) - 1] = True
    # Symbols are linked, so a round touches but the places that it looks at.
    after, before, alive = np.arange(1, total + 2), np.arange(-1, total), np.ones(total, bool)
    look = np.zeros(total + 1, bool)
    cand, here = np.flatnonzero(~ends[:-1]), np.full(total + 2, _FAR, np.int32)  # the rank of the pair that begins at i
    while len(cand):
        bits = min(_BUCKET_BITS, max(8, len(cand).bit_length() + 1))
        left, right = seq[cand], seq[after[cand]]
        bucket = ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.int64)
        sel = (np.bincount(bucket, minlength=1 << bits) >= LEAST_COUNT)[bucket]
        often, in_ = cand[sel], bucket[sel]
        if not len(often):
            break
        # One pair stands for a bucket; another that falls into it waits for a later round.
        pairs = left[sel].astype(np.uint64) << np.uint64(32) | right[sel]
        stands = np.zeros(1 << bits, np.uint64)
        if waiting:  # the most frequent pair of each bucket
            known, first, times = np.unique(pairs, return_index=True, return_counts=True)
            by_count = np.argsort(times, kind="stable")
            stands[in_[first[by_count]]] = known[by_count]
        else:
            stands[in_] = pairs
        same = stands[in_] == pairs
        place, in_ = often[same], in_[same]
        count = np.bincount(in_, minlength=1 << bits)
        heavy = np.flatnonzero(count >= LEAST_COUNT)
        heavy = heavy[np.lexsort((stands[heavy], -count[heavy]))]
        by_rank, far = stands[heavy], len(heavy)
        rank = np.full(1 << bits, _FAR, np.int32)
        rank[heavy] = np.arange(far)
        mine = rank[in_]
        here[place] = mine
        # A pair is taken where it ranks before both neighbours; in a run of one pair, every second.
        take = (mine < _FAR) & (mine <= here[before[place]]) & (mine <= here[after[place]])
        here[place] = _FAR
        at, mine = place[take], mine[take]
        linked = after[at[:-1]] == at[1:]
        if linked.any():
            fresh = np.concatenate([[True], ~linked])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            even = (np.arange(len(at)) - start) % 2 == 0
            at, mine = at[even], mine[even]
        good = np.bincount(mine, minlength=far) >= LEAST_COUNT // 2
        at, mine = at[good[mine]], mine[good[mine]]
        if not len(at):
            if waiting:
                break
            waiting = True
            continue
        waiting = False
        name = (np.cumsum(good) - 1 + n).astype(np.uint32)
        for p in by_rank[good].tolist():
            a, b = p >> 32, p & 0xFFFFFFFF
            rules.append((a, b))
            lengths.append((1 if a < base else lengths[a - base]) + (1 if b < base else lengths[b - base]))
        n += int(good.sum())
        gone = after[at]
        seq[at], ends[at], alive[gone] = name[mine], ends[gone], False
        after[at] = after[gone]
        before[after[at]] = at
        for near in (often[alive[often]], at, before[at]):
            look[near] = True
        look[-1] = False  # what stands before the first
        cand = np.flatnonzero(look)
        look[cand] = False
        cand = cand[~ends[cand]]
    last = np.flatnonzero(ends[:-1][alive])
    width = np.uint16 if n <= 1 << 16 else np.uint32
    return {"symbols": seq[alive].astype(width), "sizes": np.diff(last, prepend=-1).astype(np.uint32), "rules": np.array(rules, np.uint32).reshape(-1, 2), "lengths": np.array(lengths, np.uint32), "base": base}


def openings(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each symbol expands to: ids, and by symbol where its ids begin and how many they are. Rules
    refer to earlier symbols only, so one pass over them fills the table."""
    size = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])
    at = np.cumsum(size) - size
    ids = np.empty(int(size.sum()), np.uint32)
    ids[:base] = np.arange(base)
    starts, sizes = at.tolist(), size.tolist()
    for k, (a, b) in enumerate(rules.tolist(), base):
        x, m = starts[k], sizes[a]
        ids[x : x + m] = ids[starts[a] : starts[a] + m]
        ids[x + m : x + sizes[k]] = ids[starts[b] : starts[b] + sizes[b]]
    return ids, at, size


def expand(symbols: np.ndarray, opened: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a run of symbols."""
    ids, at, size = opened
    n = size[symbols]
    ends = np.cumsum(n)
    return ids[np.repeat(at[symbols] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


_SHARD = "part int, seq int, n_ids long, base int, n_symbols int, ids binary, sizes binary, symbols binary, rules binary, lengths binary"
_FIELDS = [x.split()[0] for x in _SHARD.split(", ")]


def _pack(part: int, seq: int, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    g = compress(ids, sizes)
    present = np.array([d is not None for d in doc_ids])
    keys = np.array([d or 0 for d in doc_ids], np.int64)
    values = [part, seq, len(ids), g["base"], len(g["symbols"]), np.packbits(present).tobytes() + keys.tobytes(), g["sizes"].tobytes(), g["symbols"].tobytes(), g["rules"].tobytes(), g["lengths"].tobytes()]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], _FIELDS)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Token-id files of docs at `path`, in ascending order of id (null ids first): a Parquet file for
    each id range, a row for each shard of about SHARD_IDS ids. Shards hold whole documents. A range
    is sorted on disk if it must be; a task holds one shard at a time. Null texts count as empty, so
    each row has END at the least; repeated rows are written each."""
    small_batches(docs.sparkSession, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = WordEncoder.of(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, runs, sizes, held = [], [], [], 0
        for whole in batches:
            for b in blocks(whole, "text"):
                ids, size = encoder.encode(b.column("text"))
                doc_ids += b.column("id").to_pylist()
                runs.append(ids)
                sizes.append(size)
                held += len(ids)
                if held >= SHARD_IDS:
                    yield _pack(part, seq, doc_ids, np.concatenate(runs), np.concatenate(sizes))
                    doc_ids, runs, sizes, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield _pack(part, seq, doc_ids, np.concatenate(runs), np.concatenate(sizes))

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    ordered.mapInArrow(lean(run, "repair"), _SHARD).write.option("compression", "zstd").parquet(path)


def shard_starts(spark, path: str) -> DataFrame:
    """(part, seq, start): ids in all shards before. Sums within a part, then over the parts."""
    shards = spark.read.schema(_SHARD).parquet(path).select("part", "seq", "n_ids")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    return shards.select("part", "seq", inside.alias("inside")).join(parts, "part").select("part", "seq", (F.col("first") + F.col("inside")).alias("start"))


def read_token_files(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens and
    ids (little-endian unsigned 32-bit, END included)."""
    return _read(spark, path, "ids binary", lambda part: part.tobytes(), pa.binary())


def _read(spark, path: str, field: str, make, kind) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
                nulls = -(-len(sizes) // 8)
                present = np.unpackbits(np.frombuffer(row["ids"], np.uint8, nulls))[: len(sizes)].astype(bool)
                keys = np.frombuffer(row["ids"], np.int64, offset=nulls)
                symbols = np.frombuffer(row["symbols"], np.uint16 if len(row["symbols"]) == 2 * row["n_symbols"] else np.uint32)
                rules, lengths = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2), np.frombuffer(row["lengths"], np.uint32)
                opened = openings(rules, lengths, row["base"])
                ends = np.cumsum(np.add.reduceat(opened[2][symbols], np.concatenate([[0], np.cumsum(sizes)[:-1]])))
                flat = expand(symbols, opened)
                begin = np.concatenate([[0], ends[:-1]])
                for k in range(0, len(sizes), 256):
                    span = range(k, min(k + 256, len(sizes)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(keys[i]) if present[i] else None for i in span], pa.int64()),
                            pa.array((begin[k : span.stop] + row["start"]).astype(np.int64)),
                            pa.array((ends - begin)[k : span.stop].astype(np.int64)),
                            pa.array([make(flat[begin[i] : ends[i]]) for i in span], kind),
                        ],
                        ["doc_id", "start", "n_tokens", field.split()[0]],
                    )

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    shards = spark.read.schema(_SHARD).parquet(path).join(shard_starts(spark, path), ["part", "seq"])
    return shards.mapInArrow(lean(run), f"doc_id long, start long, n_tokens long, {field}")


def read_checksums(spark, path: str) -> DataFrame:
    """As read_token_files, with the crc32 of the ids in their place."""
    return _read(spark, path, "ids_crc32 long", lambda part: zlib.crc32(part.tobytes()), pa.int64())


def read_document(shard: dict, k: int) -> np.ndarray:
    """The ids of document k of one shard (a row of the files), without expanding its neighbours."""
    sizes = np.frombuffer(shard["sizes"], np.uint32).astype(np.int64)
    symbols = np.frombuffer(shard["symbols"], np.uint16 if len(shard["symbols"]) == 2 * shard["n_symbols"] else np.uint32)
    first = int(sizes[:k].sum())
    rules, lengths = np.frombuffer(shard["rules"], np.uint32).reshape(-1, 2), np.frombuffer(shard["lengths"], np.uint32)
    return expand(symbols[first : first + int(sizes[k])], openings(rules, lengths, shard["base"]))


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """write_token_files into a new shared folder; returns the folder."""
    path = scratch(docs.sparkSession)
    write_token_files(docs, path, tokenizer, id_col, text_col)
    return path
