"""Secret scans: fixed patterns, and strings that zstandard cannot shorten beside their surroundings."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, lean, small_batches

#: The base patterns, in the order in which kinds are listed, and the least length of
#: what they find (assign: of group 2; access and hex: of the match).
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Words that make a context sensitive, in either case.
CONTEXT = ("password", "passwd", "secret", "token", "apikey", "api_key", "credential", "private", "bearer", "authorization", "signature", "access_key", "accesskey", "passphrase", "pwd", "session")
#: A candidate has this many characters; it is sensitive with a context word this near before it;
#: it is reported if its marginal size is at least NOVEL_BYTES and NOVEL_SHARE of what a random string
#: of its length and alphabet has: its length, or what coded literals take, with a table of TABLE_BYTES.
CANDIDATE = r"[A-Za-z0-9+/_=\-]{16,}"
NEAR, AROUND, NOVEL_BYTES, NOVEL_SHARE, TABLE_BYTES = 64, 512, 12, 0.7, 16
#: Identifier parts that ordinary code and prose are made of; a primer for the compressor.
IDENTIFIERS = " ".join(
    "get set is has new old user name value index count size length type data file path list map key id url http https www com org net html json xml text string number "
    "config option default error message result response request client server service handler manager factory builder context session token secret password private public "
    "class function return import from export const static void int long float double bool true false null none self this the and that with for not are was were have been "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 00000000 11111111 12345678 xxxxxxxx XXXXXXXX ________ -------- ========".split()
)

_COMPILED = [(kind, re.compile(p, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)), group, least) for kind, p, group, least in BASE]
_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)" + BASE[0][1][BASE[0][1].index(")") + 1 :], re.ASCII)
_CONTEXT = re.compile("|".join(CONTEXT), re.ASCII | re.IGNORECASE)
_CANDIDATE = re.compile(CANDIDATE, re.ASCII)
_HEX = re.compile(r"[0-9A-F]+|[0-9a-f]+")
_KINDS = [(10, re.compile("[0-9]")), (26, re.compile("[A-Z]")), (26, re.compile("[a-z]")), (5, re.compile(r"[+/_=\-]"))]
#: One pass of a linear-time matcher over a batch finds the texts worth a closer look.
_ANY = "(?i:" + "|".join(CONTEXT) + ")|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind."""
    found = []
    for kind, pattern, _, least in _COMPILED:
        if kind == "assign":
            found += [(m.start(), m.end(), kind) for m in _ASSIGN.finditer(text) if len(m[1]) >= least]
        else:
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    return found


def marginal_bytes(before: bytes, candidate: bytes, after: bytes = b"") -> int:
    """Bytes that the candidate adds to a zstandard frame primed with the identifier dictionary and
    the surroundings: size with it less size without it."""
    import zstandard

    primer = zstandard.ZstdCompressionDict(IDENTIFIERS.encode() + b" " + after + b" " + before, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False)
    return len(press.compress(before + candidate)) - len(press.compress(before))


def random_bytes(candidate: str) -> float:
    """About the bytes that zstandard needs for a random string of the candidate's length and alphabet
    (the kinds of characters it has; letters up to f of one case alone, with digits, are hex digits)."""
    if _HEX.fullmatch(candidate):
        alphabet = 16
    else:
        alphabet = sum(n for n, p in _KINDS if p.search(candidate))
    return min(len(candidate), len(candidate) * math.log2(alphabet) / 8 + TABLE_BYTES)


def _without(text: str, begin: int, end: int, spans: list[tuple[int, int]]) -> bytes:
    """text[begin:end] with a space for each of the spans (in order, disjoint) or part of one."""
    k = bisect.bisect_right(spans, begin, key=lambda s: s[1])
    out, at = [], begin
    while k < len(spans) and spans[k][0] < end:
        out.append(text[at : max(at, spans[k][0])])
        at, k = spans[k][1], k + 1
    return " ".join([*out, text[at:end]]).encode()


def _joined(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e, _ in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def novel_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates in a sensitive context that the compressor cannot derive from what stands around
    them. What a base span holds is reported already. Other strings of a candidate's form are left
    out of the surroundings unless they stand before and are reported as novel: so of a secret that
    stands again the first place is reported, and what repeats that place is derived from it."""
    words = [m.end() for m in _CONTEXT.finditer(text)]
    if not words:
        return []
    runs = list(_CANDIDATE.finditer(text))
    shut = [m.span() for m in runs]  # what candidates may not be derived from
    held = _joined(taken)
    found, k, gone = [], 0, 0
    for at, m in enumerate(runs):
        while k + 1 < len(words) and words[k + 1] <= m.start():
            k += 1
        if not 0 <= m.start() - words[k] <= NEAR:
            continue
        i = bisect.bisect_right(held, m.start(), key=lambda s: s[1])  # the first that ends behind its start
        if i < len(held) and held[i][0] < m.end():
            continue
        raw = m[0].encode()
        size = marginal_bytes(_without(text, max(0, m.start() - AROUND), m.start(), shut), raw, _without(text, m.end(), min(len(text), m.end() + AROUND), shut))
        if size >= NOVEL_BYTES and size >= NOVEL_SHARE * random_bytes(m[0]):
            found.append((m.start(), m.end(), "novel"))
            shut.pop(at - gone)
            gone += 1
    return found


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id and spans, an array of (kind, start, end) in code points, end
    exclusive, ordered by start and then by kind as listed (assign, access, hex, novel).

    Whole texts are read in blocks; one linear-time match for each text decides whether the patterns
    run over it at all; in a text, candidates and spans are met in order, so that very many of them cost
    no more than their number. Null and empty texts have no spans, repeated rows each give a row, null ids
    pass. Nothing is shuffled, so hot sources and copies do no harm."""
    small_batches(docs.sparkSession)
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    order = {k: i for i, k in enumerate([b[0] for b in BASE] + ["novel"])}
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text"):
                look = pc.fill_null(pc.match_substring_regex(b.column("text"), _ANY), False).to_pylist()
                out = []
                for i, near in enumerate(look):
                    if not near:
                        out.append([])
                        continue
                    text = b.column("text")[i].as_py()
                    spans = base_spans(text)
                    spans += novel_spans(text, spans)
                    out.append([{"kind": k, "start": s, "end": e} for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]]))])
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(item))], ["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
