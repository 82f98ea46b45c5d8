"""Byte-level BPE by merge replay over the corpus's distinct pieces, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, forget, kept, lean, small_batches, written
from .wordcache import UnitEncoder

#: The code points with the White_Space property.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: First bytes of multi-byte white space in UTF-8, and ASCII controls near it.
_WHITE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each id of a rank file (lines of base64 and rank)."""
    with open(path, "rb") as f:
        table = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [table.get(i, b"") for i in range(max(table) + 1)]


#: Pieces of more bytes are replayed by linked positions, others in waves over arrays.
LONG_PIECE = 1024
#: Units of the corpus that its table has, at most, and bytes of each.
TABLE_UNITS, TABLE_BYTES = 1 << 17, 64
#: Bits of the table of pairs, and the bits that an id takes in a pair's key.
_TABLE_BITS, _ID_BITS = 20, 20
_NONE = np.int32(2**31 - 1)


class Replay:
    """Merges over the distinct pieces of a corpus (or a part of it) at once.

    An inverted index holds the places of each pair of neighbours that some merge joins, kept as the
    pair's rank at the place of its left token. Merges go in rank order: a wave takes, in every
    piece, the places of the lowest rank that the piece still has, and gives new entries to nothing
    but the pairs beside the tokens it joined. Pieces share no token, so each one sees the merges in
    the same order as in a pass over all ranks. A piece in which a wave that joined several places
    opened a merge of lower rank, and any very long piece, goes through `linked`, one place at a time."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.single = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int32)
        halves = [(self.rank.get(t[:k], -1), self.rank.get(t[k:], -1), i) for i, t in enumerate(tokens) for k in range(1, len(t))]
        left, right, joined = (np.array(x, np.int64) for x in zip(*halves, strict=True)) if halves else (np.zeros(0, np.int64),) * 3
        both = (left >= 0) & (right >= 0)
        self.keys, self.ranks = np.full(1 << _TABLE_BITS, -1, np.int64), np.full(1 << _TABLE_BITS, _NONE, np.int32)
        key, rank = left[both] << _ID_BITS | right[both], joined[both].astype(np.int32)
        if len(key) > 1 << (_TABLE_BITS - 1) or len(tokens) > 1 << _ID_BITS:
            raise ValueError("too many merges for the table of pairs")
        at = self._slot(key)
        while len(key):  # of keys that meet, one stays and the others go on
            free = self.keys[at] < 0
            self.keys[at[free]] = key[free]
            sits = self.keys[at] == key
            self.ranks[at[sits]] = rank[sits]
            key, rank, at = key[~sits], rank[~sits], (at[~sits] + 1) & ((1 << _TABLE_BITS) - 1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank (which is the id) that joins each pair; _NONE without a merge."""
        key = left.astype(np.int64) << _ID_BITS | right
        at = self._slot(key)
        out, held = self.ranks[at], self.keys[at]
        far = np.flatnonzero((held != key) & (held >= 0))
        out[held != key] = _NONE
        while len(far):
            at = (at[far] if len(at) != len(far) else at) + 1 & ((1 << _TABLE_BITS) - 1)
            held = self.keys[at]
            out[far[held == key[far]]] = self.ranks[at[held == key[far]]]
            on = (held != key[far]) & (held >= 0)
            far, at = far[on], at[on]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and each piece's number: the piece's own id if it has
        one, else what the merges leave."""
        odd: dict[int, list[int]] = {}
        raw = []
        for i, piece in enumerate(pieces):
            if (whole := self.rank.get(piece)) is not None:
                odd[i] = [whole]
            elif len(piece) > LONG_PIECE:
                odd[i] = self.linked(piece)
            else:
                raw.append(i)
        names = np.array(raw, np.int64)
        size = np.fromiter((len(pieces[i]) for i in raw), np.int64, len(raw))
        token = self.single[np.frombuffer(b"".join(pieces[i] for i in raw), np.uint8)]
        word = np.repeat(names, size)
        done, back = [], set()
        rank = np.full(len(token), _NONE, np.int32)
        if len(token) > 1:
            near = np.flatnonzero(word[1:] == word[:-1])
            rank[near] = self.joined(token[near], token[near + 1])
        while len(token):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.append(start, len(word)))
            low = np.minimum.reduceat(rank, start)
            live = low < _NONE
            if not live.all():  # pieces without a merge left are done
                on = np.repeat(live, count)
                done.append((token[~on], word[~on]))
                token, word, rank, low, count = token[on], word[on], rank[on], low[live], count[live]
                if not len(token):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, count))
            if len(hit) > len(low):  # of places that overlap, every second from the left
                fresh = np.concatenate([[True], np.diff(hit) > 1])
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            made = rank[hit]
            if len(hit) > len(low):  # what would stand beside a place before the next one is joined
                beside = np.flatnonzero((np.diff(hit) == 2) & (word[hit[:-1]] == word[hit[1:]]))
                opens = self.joined(made[beside], token[hit[beside] + 2]) < made[beside]
                back.update(word[hit[beside[opens]]].tolist())
            token[hit] = made
            keep = np.ones(len(token), bool)
            keep[hit + 1] = False
            token, word, rank = token[keep], word[keep], rank[keep]
            at = hit - np.arange(len(hit))  # where the joined tokens stand now
            end = np.append(word[1:] != word[:-1], True)
            right = at[~end[at]]
            rank[at] = _NONE
            rank[right] = self.joined(token[right], token[right + 1])
            left = at[(at > 0) & ~end[at - 1]] - 1
            rank[left] = self.joined(token[left], token[left + 1])
            if len(hit) > len(low):
                several = word[at[1:][word[at[1:]] == word[at[:-1]]]]
                if len(several):
                    lower = np.minimum(rank[at], np.where((at > 0) & ~end[at - 1], rank[at - 1], _NONE)) < made
                    back.update(np.intersect1d(several, word[at[lower]]).tolist())
        for i in back:
            odd[i] = self.linked(pieces[i])
        token, word = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if back:
            on = ~np.isin(word, np.array(sorted(back)))
            token, word = token[on], word[on]
        if odd:
            token = np.concatenate([token, np.fromiter((x for ids in odd.values() for x in ids), np.int32)])
            word = np.concatenate([word, np.repeat(np.fromiter(odd, np.int64, len(odd)), [len(ids) for ids in odd.values()])])
        order = np.argsort(word, kind="stable")
        return token[order], np.bincount(word, minlength=len(pieces))

    def linked(self, piece: bytes) -> list[int]:
        """The ids of one piece: an index from rank to places, linked neighbours, and the leftmost place of
        the lowest rank first."""
        token: list[int] = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(token)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        tokens, ranks = self.tokens, self.rank
        rank_of = lambda a: ranks.get(tokens[token[a]] + tokens[token[right[a]]], -1)
        first = self.joined(np.array(token[:-1], np.int32), np.array(token[1:], np.int32)).tolist()
        due = [(r, at) for at, r in enumerate(first) if r < _NONE]
        heapq.heapify(due)
        while due:
            rank, at = heapq.heappop(due)
            if token[at] < 0 or right[at] < 0 or rank_of(at) != rank:
                continue  # joined otherwise meanwhile
            nxt = right[at]
            token[at], token[nxt], right[at] = rank, -1, right[nxt]
            if right[nxt] >= 0:
                left[right[nxt]] = at
            for place in (at, left[at]):
                if place >= 0 and right[place] >= 0 and (r := rank_of(place)) >= 0:
                    heapq.heappush(due, (r, place))
        return [t for t in token if t >= 0]


class ByteEncoder(UnitEncoder):
    """Ids of whole texts. Texts are cut where a match of the pattern begins whatever stands before:
    before a space that a visible character follows, before a comma or full stop after a letter, and
    around one line feed between visible characters. What lies between cuts matches alone."""

    name, table = None, None

    def __init__(self, tokens: list[bytes], pattern: str):
        super().__init__()
        import regex

        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.replay = Replay(tokens)
        size = np.array([len(t) for t in tokens], np.int64)
        self.bytes, self.byte_size, self.byte_at = np.frombuffer(b"".join(tokens), np.uint8), size, np.cumsum(size) - size

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteEncoder:
        """The worker's encoder; later tasks find its pieces learnt."""
        return kept("bpe", (path, pattern), lambda: cls(read_ranks(path), pattern))

    def given(self, name: str, table: pa.Table) -> None:
        """Starts from a corpus's table of units and ids, here and whenever the encoder forgets."""
        if self.name != name:
            self.name, self.table = name, table
            self._clear()

    def _clear(self) -> None:
        super()._clear()
        if self.table is not None:
            ids = [np.frombuffer(x, "<u4") for x in self.table.column("ids").to_pylist()]
            self._enter(self.table.column("unit").to_pylist(), np.concatenate([*ids, np.zeros(0, np.uint32)]), np.array([len(x) for x in ids], np.int64))

    @staticmethod
    def _units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, at = words.data, words.at
        follows = (data > 0x20) & (data != 0x7F)
        for lead in _WHITE_LEADS:
            follows &= data != lead
        head = np.zeros(len(data), bool)
        if len(data):
            head[:-1] = (data[:-1] == 0x20) & follows[1:]
            seen = (data > 0x20) & (data < 0x7F)
            letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            line = data == 0x0A
            head[1:] |= (letter[:-1] & ((data[1:] == 44) | (data[1:] == 46))) | (line[1:] & seen[:-1])
            head[2:] |= seen[:-2] & line[1:-1] & follows[2:]
            head[at[:-1][at[:-1] < at[1:]]] = True
        begin = np.flatnonzero(head)
        first = np.searchsorted(begin, at)
        return begin, np.append(begin[1:], len(data)).astype(np.int64) if len(begin) else begin, first

    def _ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = self.pattern.findall
        found = [split(u.decode("utf-8", "replace")) for u in units]
        number = np.fromiter(map(len, found), np.int64, len(found))
        pieces: dict[str, int] = {}
        of = np.fromiter((pieces.setdefault(p, len(pieces)) for p in itertools.chain.from_iterable(found)), np.int64, int(number.sum()))
        ids, size = self.replay.encode([p.encode() for p in pieces])
        at = np.cumsum(size) - size
        length = np.add.reduceat(size[of], np.cumsum(number) - number) if len(of) else number
        ends = np.cumsum(size[of])
        return ids[np.repeat(at[of] - (ends - size[of]), size[of]) + np.arange(int(ends[-1]) if len(ends) else 0)], length

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and where each id's bytes end."""
        size = self.byte_size[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.byte_at[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def corpus_table(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> pa.Table:
    """(unit, ids) of the units that occur most in all texts, TABLE_UNITS at most: all those that
    occur at least as often as the least power of two that leaves so many. Units are counted over the
    whole corpus, the chosen ones are replayed together, each once, by the executors."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text"):
                words = Words(b.column("text"))
                begin, end, _ = ByteEncoder._units(words)
                short = end - begin <= TABLE_BYTES
                if len(begin):
                    coded = words.units(begin, end).filter(pa.array(short)).dictionary_encode()
                    times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                    yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(times.astype(np.int64))], ["unit", "n"])

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.of(path, pattern)
        for b in batches:
            ids, size = encoder._ids(b.column("unit").to_pylist())
            raw, ends = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(size) * 4]).tolist()
            yield pa.RecordBatch.from_arrays([b.column("unit"), pa.array([raw[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["unit", "ids"])

    small_batches(docs.sparkSession, 4096)
    units = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(counted, "bpe"), "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1")
    units = written(units.withColumn("power", F.floor(F.log2("n")).cast("int")))
    least, held = 64, 0
    for r in sorted(units.groupBy("power").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["power"]):
        if held + r["n"] > TABLE_UNITS:
            break
        least, held = r["power"], held + r["n"]
    small_batches(docs.sparkSession, 1 << 15)
    table = units.where(F.col("power") >= least).select("unit").mapInArrow(lean(replayed, "bpe"), "unit binary, ids binary").toArrow()
    small_batches(docs.sparkSession, 4096)
    forget(units)
    return table


def _per_text(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, fields: str, make) -> DataFrame:
    small_batches(docs.sparkSession, 4096)
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    held, name = docs.sparkSession.sparkContext.broadcast(corpus_table(docs, path, pattern, text_col)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.of(path, pattern)
        encoder.given(name, held.value)
        for whole in batches:
            for b in blocks(whole, "text"):
                ids, sizes = encoder.encode(b.column("text"))
                yield make(encoder, b.column("id"), ids, np.concatenate([[0], np.cumsum(sizes)]))

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run, "bpe"), f"id {kind}, {fields}")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) of every whole text by the ranks in the file at `path`, each match of
    `pattern` separately. The corpus's most frequent units are replayed once, in a table of bounded
    size that is broadcast. Texts then stream through in blocks of 4 MB; a block's other units, which
    are rare, are replayed together there, and a worker keeps what it has met (bounded), so no text
    moves. Null counts as empty, empty texts have no ids, repeated rows each give a row, null ids pass."""

    def make(encoder, ids_col, ids, ends):
        return pa.RecordBatch.from_arrays([ids_col, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["id", "ids"])

    return _per_text(docs, path, pattern, id_col, text_col, "ids array<int>", make)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """id and text (binary: the decoded bytes) of rows from encode()."""
    kind = dict(encoded.dtypes)["id"]

    def run(batches):
        encoder = ByteEncoder.of(path, pattern)
        for b in batches:
            lists = b.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])])
            data, ends = encoder.decode(flat)
            stop = np.concatenate([[0], ends])[cuts]
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([raw[x:y] for x, y in zip(stop[:-1], stop[1:], strict=True)], pa.binary())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(lean(run, "bpe"), f"id {kind}, text binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and the sha256 of the ids (little-endian unsigned 32-bit) and of the bytes that
    they decode to, made where the text is read: neither ids nor texts move."""

    def make(encoder, ids_col, ids, ends):
        data, stop = encoder.decode(ids)
        stop = np.concatenate([[0], stop])[ends]
        raw, plain = ids.astype("<u4").tobytes(), data.tobytes()
        hashes = lambda buf, cut: pa.array([hashlib.sha256(buf[x:y]).hexdigest() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([ids_col, pa.array(np.diff(ends).astype(np.int64)), hashes(raw, ends * 4), hashes(plain, stop)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _per_text(docs, path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make).withColumnRenamed("id", id_col)
