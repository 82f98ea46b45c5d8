"""Queries on whole tables: ids that former filters left out take part. Against brute force on small fixtures."""

import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph, policy, selection, similar
from lodestrata.operators.shared import base
from lodestrata.plans import catalog, rest


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def by_hand(edges):
    part = {}
    for a, b in edges:
        joined = part.get(a, {a}) | part.get(b, {b})
        part.update(dict.fromkeys(joined, joined))
    return {n: min(g) for n, g in part.items()}


def test_documents_beyond_the_first(spark, folder):
    line = "one tion. two heit!\n"
    d = folder(documents=([(5000, line * 120)], "doc_id long, text string"), customer=([(7000,)], "c_custkey long"))
    windows = catalog.QUERIES["str9_chunk_windows"](spark, d).orderBy("unit").collect()
    text = line * 120
    assert [(r["start"], r["text"]) for r in windows] == [(i, text[i : i + 1000]) for i in range(0, len(text) - 100, 900)]
    assert [tuple(r) for r in catalog.QUERIES["ext9_units"](spark, d).collect()] == [(5000, 360, len(text))]
    assert [tuple(r) for r in catalog.QUERIES["ext1_priority_events"](spark, d).collect()] == [(5000, 0, 2)]
    assert catalog.QUERIES["dt6_monthly_cutoffs"](spark, d).count() == 3


def test_all_suppliers(spark, folder):
    d = folder(lineitem=([(900, k) for k in range(4)] + [(901, k) for k in range(2, 6)], "l_suppkey long, l_partkey long"))
    assert [tuple(r) for r in catalog.QUERIES["agg26_coefficients"](spark, d).collect()] == [(900, 901, round(2 / 6, 8), 0.5)]


def test_whole_items_ground(spark, folder):
    item = "a passage that is longer than forty characters, of one item"
    docs = [(1, f"x {item} y"), (2, item[:45]), (3, "short and tiny"), (4, None)]
    d = folder(benchmark=([(99, item), (100, "tiny"), (101, "")], "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    want = {(i, k) for i, q in ((99, item), (100, "tiny"), (101, "")) for k, t in docs if t and q in t}
    assert {(r["item_id"], r["doc_id"]) for r in catalog.QUERIES["ext22_grounding"](spark, d).collect()} == want


def test_all_edges(spark, folder):
    edges = [(10, 1), (11, 1), (11, 2), (20, 4), (21, 5)]
    cases = [(k, k % 4) for k in (1, 2, 3, 4, 6, 1000000, 1000001, 1000002)]
    d = folder(lineitem=([(a, b, 7.0) for a, b in edges], "l_orderkey long, l_partkey long, l_quantity double"), customer=(cases, "c_custkey long, c_nationkey int"))
    assert {r["node"]: r["component"] for r in catalog.QUERIES["gr1_components"](spark, d).collect()} == by_hand(edges)
    want = {k: min(c for c, n in cases if n == m) for k, m in cases}
    assert {r["node"]: r["component"] for r in catalog.QUERIES["gr4_shared_company_cases"](spark, d).collect()} == want


def test_all_customers_split(spark, folder):
    keys = [1, 18, 2000, 2017, 2034, 3001]
    d = folder(customer=([(k,) for k in keys], "c_custkey long"))
    got = {r["component"]: r["chosen"] for r in catalog.QUERIES["top13_exact_size_split"](spark, d).collect()}
    size = {min(g): len(g) for m in range(17) if (g := [k for k in keys if k % 17 == m])}
    assert set(got) == set(size) and sum(size[k] for k, on in got.items() if on) == len(keys) // 2


def test_greedy_pick_over_all_rows(spark, folder):
    rng = random.Random(3)
    rows = [(k, rng.choice("AB"), float(rng.randrange(60)), k % 6 if k > 40 else 0) for k in range(1, 500)]
    d = folder(customer=(rows, "c_custkey long, c_mktsegment string, c_acctbal double, c_nationkey int"))
    used, want = set(), []
    for g in "AB":
        taken = 0
        for k, _, _, n in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])):
            if taken < 3 and n not in used:
                used.add(n)
                taken += 1
                want.append((g, k, n))
    assert [tuple(r) for r in catalog.QUERIES["top7_greedy_pick"](spark, d).collect()] == want


def test_all_suppliers_cover(spark, folder):
    rows = [(k, (k * k) % 97 + j) for k in range(1, 40) for j in range(k % 7)]
    d = folder(lineitem=(rows, "l_suppkey long, l_partkey long"))
    sets = {}
    for k, p in rows:
        sets.setdefault(k, set()).add(p % 60)
    want = selection.greedy_cover(sorted((k, frozenset(s)) for k, s in sets.items()), 5)
    assert [r["l_suppkey"] for r in catalog.QUERIES["top11_greedy_coverage"](spark, d).orderBy("place").collect()] == want


def test_more_suppliers_than_a_pool(spark, folder, monkeypatch):
    monkeypatch.setattr(selection, "POOL", 3)
    d = folder(lineitem=([(k, 0) for k in range(1, 9)] + [(9, 1), (9, 2)], "l_suppkey long, l_partkey long"))
    assert [r["l_suppkey"] for r in catalog.QUERIES["top11_greedy_coverage"](spark, d).orderBy("place").collect()] == [9, 1]


def test_all_customers_fill_quotas(spark, folder):
    rows = [(k, ("BUILDING", "MACHINERY", "HOUSEHOLD", "OTHER")[k % 4]) for k in range(350, 900)]
    d = folder(customer=(rows, "c_custkey long, c_mktsegment string"))
    got = [r["c_custkey"] for r in catalog.QUERIES["top12_quota_restarts"](spark, d).collect()]
    assert got == selection.quota_restarts(rows, {"BUILDING": 5, "MACHINERY": 4, "HOUSEHOLD": 3}, "v2") and max(got) >= 400


def near_by_hand(texts, block):
    """Pairs by the reference's rule: length ratio, then Jaccard of 7-shingles of 0.85 at the least."""
    squeezed = {k: "".join(t.split()).lower() for k, t in texts.items()}
    sets = {k: {x[i : i + 7] for i in range(max(1, len(x) - 6))} for k, x in squeezed.items() if x}
    out = {}
    for a in sets:
        for b in sets:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if a < b and 0.75 <= len(squeezed[a]) / len(squeezed[b]) <= 1.34 and j >= 0.85 and block(a, b):
                out[a, b] = round(j, 6)
    return out


def near_texts():
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**5)}" for _ in range(900)]
    long = " ".join(words)
    edited = " ".join([*words[:880], "quite", "other", "words", "here"])
    same_head = " ".join([*words[:6], *(f"z{rng.randrange(10**5)}" for _ in range(890))])
    return {1: long, 2: edited, 3: same_head, 4: "tiny text", 5: "Tiny  Text", 6: "w " * 800, 7: "w " * 1600, 8: "w " * 820, 9: ""}


def near_folder(folder, texts):
    return folder(documents=([(k, t, len(t)) for k, t in texts.items()], "doc_id long, text string, n_chars long"))


def test_near_duplicates_of_every_length(spark, folder):
    texts = near_texts()
    want = near_by_hand(texts, lambda a, b: True)
    assert (1, 2) in want and (4, 5) in want and (6, 7) not in want and len(texts[1]) > 1500
    got = catalog.QUERIES["join21_near_duplicates"](spark, near_folder(folder, texts)).collect()
    assert {(r["a"], r["b"]): r["jaccard"] for r in got} == want


def test_blocked_pairs_are_verified(spark, folder):
    texts = near_texts()
    want = near_by_hand(texts, lambda a, b: texts[a][:20] == texts[b][:20])
    d = near_folder(folder, texts)
    got = catalog.QUERIES["join22_blocked_prefix"](spark, d).collect()
    assert texts[1][:20] == texts[3][:20] and (1, 3) not in want and {(r["a"], r["b"]): r["jaccard"] for r in got} == want


def test_copies_meet_their_class_alone(spark, folder):
    texts = {k: ("one text of many  copies " * 3 if k % 2 else "One text of many copies " * 3) for k in range(1, 31)} | {40: "one text of many copies " * 3 + "x"}
    d = near_folder(folder, texts)
    got = {(r["a"], r["b"]): r["jaccard"] for r in catalog.QUERIES["join21_near_duplicates"](spark, d).collect()}
    want = near_by_hand(texts, lambda a, b: a == 1)
    assert (1, 40) in want and got == want and len(got) == 30


def test_copies_meet_their_class_of_one_opening(spark, folder):
    texts = {k: ("one text of many  copies " * 3 if k % 2 else "One text of many copies " * 3) for k in range(1, 31)} | {40: "one text of many  copies " * 3 + "x"}
    got = catalog.QUERIES["join22_blocked_prefix"](spark, near_folder(folder, texts)).collect()
    assert {(r["a"], r["b"]) for r in got} == {(1, k) for k in range(3, 31, 2)} | {(2, k) for k in range(4, 31, 2)} | {(1, 40)}


def test_large_components_are_compared_in_blocks(spark, folder, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(similar, "WIDE", 16)
    words = [f"w{k * k}" for k in range(120)]
    texts = {k: " ".join([*words[: 2 * k], f"edit{k}", *words[2 * k :]]) for k in range(1, 15)}
    got = catalog.QUERIES["join21_near_duplicates"](spark, near_folder(folder, texts)).collect()
    want = near_by_hand(texts, lambda a, b: True)
    assert len(want) == 91 and len(got) == 91 and {(r["a"], r["b"]): r["jaccard"] for r in got} == want


def test_texts_of_like_words_do_not_hang_together(spark, folder, monkeypatch):
    nodes, components = [], similar.components

    def seen(edges, a, b):
        nodes.extend(r[0] for r in edges.select(a).union(edges.select(b)).distinct().collect())
        return components(edges, a, b)

    monkeypatch.setattr(similar, "components", seen)
    rng = random.Random(11)
    words = [f"word{k}" for k in range(36)]
    texts = {k: " ".join(rng.sample(words, 24)) for k in range(150)}
    texts |= {150 + k: " ".join([*texts[k].split()[:-1], "other"]) for k in range(5)}
    got = catalog.QUERIES["join21_near_duplicates"](spark, near_folder(folder, texts)).collect()
    want = near_by_hand(texts, lambda a, b: True)
    assert want and {(r["a"], r["b"]): r["jaccard"] for r in got} == want
    assert {x for pair in want for x in pair} <= set(nodes) and len(set(nodes)) < 30


def test_long_lists_meet_in_blocks(spark, folder, monkeypatch):
    monkeypatch.setattr(similar, "LIST_TEXTS", 3)
    words = [f"w{k * k}" for k in range(120)]
    texts = {k: " ".join([*words[: 2 * k], f"edit{k}", *words[2 * k :]]) for k in range(1, 15)}
    got = catalog.QUERIES["join21_near_duplicates"](spark, near_folder(folder, texts)).collect()
    want = near_by_hand(texts, lambda a, b: True)
    assert len(want) == 91 and {(r["a"], r["b"]): r["jaccard"] for r in got} == want


def test_sketches_part_no_link():
    rng, fewest = np.random.default_rng(3), similar.fewest_bins(0.85)
    for size in [1, 2, 7, 20, 60, 150, 400, 1_000, 5_000] * 40:
        differ = int(size * 0.15 / 1.85)  # of each side, so that 85 % of the union is shared
        pool = np.unique(rng.integers(0, 2**64, 2 * size, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[: size - differ], pool[size : size + differ]]))
        x, y = similar.sketch_of(a), similar.sketch_of(b)
        assert np.count_nonzero((x == y) & (x != 0)) >= fewest[np.count_nonzero(x | y)]
        assert list(similar.list_edges(np.array([2, 2]), np.zeros(2, bool), np.zeros(2), np.array([len(a), len(b)]), np.stack([x, y]), 0.85, fewest)) == [0, 0]
    assert 150 < fewest[240] < 160 and fewest[10] == 0


def test_lists_are_joined_in_pieces(monkeypatch):
    monkeypatch.setattr(similar, "LIST_PAIRS", 4)
    one, two = np.arange(1, 241).astype(np.uint8), np.arange(240, 0, -1).astype(np.uint8)
    sketches = np.stack([one, two, one, two, one, one, two, two])
    size = np.array([100, 100, 90, 100, 80, 100, 100, 100])
    ends = np.array([5, 5, 5, 5, 5, 8, 8, 8])
    to = similar.list_edges(ends, np.zeros(8, bool), np.zeros(8), size, sketches, 0.85, similar.fewest_bins(0.85))
    assert list(to) == [0, 1, 0, 1, 0, 5, 6, 6]  # 100 and 80 hang together by 90
    apart = similar.list_edges(ends, np.ones(8, bool), np.array([0, 0, 0, 1, 1, 0, 0, 1]), size, sketches, 0.85, similar.fewest_bins(0.85))
    assert list(apart) == [0, 1, 2, 1, 2, 5, 6, 6]


def shuffled(spark):
    """Bytes that tasks have written to shuffle files so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorList(False).head().totalShuffleWrite()


def test_texts_that_meet_none_do_not_move(spark, folder):
    rng = random.Random(8)
    texts = {k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000)) for k in range(400)}
    texts[400] = texts[7][:-3] + "end"
    d, before = near_folder(folder, texts), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where tables are large
    try:
        got = catalog.QUERIES["join22_blocked_prefix"](spark, d).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = shuffled(spark) - before
    assert [(r["a"], r["b"]) for r in got] == [(7, 400)] and moved < sum(map(len, texts.values())) / 4


def test_the_filter_of_ids_loses_none(spark):
    df, wanted = spark.range(-50_000, 50_000).withColumnRenamed("id", "key"), [-50_000, -1, 0, 1, 77, *range(1000, 40_000, 40), 49_999]
    got = {r["key"] for r in similar.maybe_in(df, "key", spark.createDataFrame([(k,) for k in wanted], "id long"), len(wanted)).collect()}
    assert got >= set(wanted) and len(got) < 100_000 / 16 + len(wanted)
    assert similar.maybe_in(df, "key", spark.createDataFrame([], "id long"), 0).count() == 0


def test_each_two_blocks_meet_once(spark):
    rows = [(b * 100 + i, b, i) for b in range(1, 8) for i in range(b)]
    texts = spark.createDataFrame(rows, "id long, blocks int, i int")
    found = []
    for first in range(0, 4, 2):
        part = [tuple(r) for r in similar.met_blocks(texts, first, 2).select("id", "i", "g", "h").collect()]
        assert max(Counter(x[0] for x in part).values()) <= 4
        found += part
    groups = {}
    for x, i, g, h in found:
        groups.setdefault((x // 100, g, h), []).append(i)
    assert all(sorted(i) == sorted({g, h}) for (_, g, h), i in groups.items())
    assert sorted((b, *sorted(x)) for b, *x in groups) == [(b, i, j) for b in range(1, 8) for i in range(b) for j in range(i, b)]


def test_reports_are_bounded(spark, folder):
    rows = [(k % 2, f"Customer {k}") for k in range(100)]
    d = folder(customer=(rows, "c_nationkey int, c_name string"))
    packed = rest._reports(spark.read.parquet(f"{d}/customer.parquet"), 7).collect()
    assert max(r["value"].count("company") for r in packed) <= 7 and sum(r["value"].count("company") for r in packed) == 100
    got = catalog.QUERIES["src4_report_versions"](spark, d).collect()
    assert sorted(tuple(r) for r in got) == sorted((n, 1 + n, c) for n, c in rows)


def test_an_account_of_many_requests_is_one_pass(spark):
    # A fold that copies what it has seen at each step takes minutes here.
    rows = spark.range(200_000).selectExpr("'a' as g", "id as at", "id div 2 as op", "if(id < 199000, 40L, id % 6 + 1) as points", "id % 3 = 0 as paid")
    began = time.time()
    got = {r["op"]: r["state"] for r in policy.budget_ledger(rows, ["g"], F.col("at"), "op", "points", "paid", 30).where("state != 'refused'").collect()}
    took = time.time() - began
    used, want = 0, {}
    for k in range(199_000, 200_000):
        if k // 2 not in want and used + k % 6 + 1 <= 30:
            used += k % 6 + 1
            want[k // 2] = "spent" if k % 3 == 0 else "reserved"
    assert got == want and took < 30


def test_ledger_requests_without_values(spark):
    rows = [("a", 1, None, 5, True), ("a", 2, "x", None, False), ("a", 3, "x", 30, True), ("a", 4, "x", 0, True), ("a", 5, None, 40, True), (None, 1, "y", 31, None), (None, 2, "y", 30, None)]
    df = spark.createDataFrame(rows, "g string, at int, op string, points int, paid boolean")
    got = policy.budget_ledger(df, ["g"], F.col("at"), "op", "points", "paid", 30).collect()
    want = [("a", None, 5, "spent"), ("a", "x", None, "reserved"), ("a", "x", 30, "spent"), ("a", "x", 0, "refused"), ("a", None, 40, "refused"), (None, "y", 31, "refused"), (None, "y", 30, "reserved")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_components_leave_no_edges_behind(spark):
    rng = random.Random(4)
    edges = [(0, k) for k in range(1, 3000)] + [(rng.randrange(3000), rng.randrange(3000)) for _ in range(20_000)] + [(k, k + 1) for k in range(5000, 5300)] + [(9000, 9000)]
    at = Path(base(spark).removeprefix("file://"))
    held = {p for p in at.rglob("*") if p.is_file()}
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    left = sum(p.stat().st_size for p in at.rglob("*") if p.is_file() and p not in held)
    want = dict.fromkeys(range(3000), 0) | dict.fromkeys(range(5000, 5301), 5000) | {9000: 9000}
    assert {r["node"]: r["component"] for r in got.collect()} == want and left < 8 * len(edges)
