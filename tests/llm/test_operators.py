"""Each training-data query against brute force, and every operator on awkward tables."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

import corpus_pipeline
from lodestrata.llm import bpe, exact_dedup, mixing, near_dup, queries, repair, secrets, sharding, topk, toxicity, url_filter
from lodestrata.llm.common import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, key string, id string, `__size` int, slot int, component_id long, score double"
LONG = "lorem ipsum dolor sit amet " * 9000


def table(rows):
    """Documents with extra columns whose names the operators use themselves."""
    return [(i, t, "en", s, len(t or ""), 7, 7, "k", "x", 7, 7, 7, 0.5) for i, t, s in rows]


AWKWARD = table(
    [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "One two three four five six", "b"), (5, "one TWO three four five six", None), (5, "one TWO three four five six", None), (6, "one two three four five seven", "b"), (7, "a", "b"), (8, "a", "a"), (9, LONG, "a"), (10, LONG + "x", "a"), (11, "naïve 日本語 🙂\u00a0x", "ü"), (None, "no id", "a")]
)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.oracles()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_sharding(spark, sf_dir, documents):
    got = queries.op1_sharding(spark, sf_dir).toPandas()
    size = {i: len((t or "").encode()) + 8 for i, t in zip(documents.doc_id, documents.text)}
    assert dict(zip(got.doc_id, got["size"])) == size and len(got) == len(documents)
    assert dict(zip(got.doc_id, got.text_crc32)) == {i: zlib.crc32((t or "").encode()) for i, t in zip(documents.doc_id, documents.text)}
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert set(got.shard) <= set(range(24))
    total = got.groupby("shard")["size"].sum()
    assert (abs(total - total.sum() / 24) <= 2 * got["size"].max()).all()


def test_sharding_cuts_a_heavy_group_by_id(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    got = sharding.histogram_shards(rows, 8).toPandas()
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 8 and total.max() - total.min() <= 0.02 * total.mean() + 64
    assert all(sorted(p.slot) == list(range(len(p))) for _, p in got.groupby("shard"))


def test_sharding_awkward(awkward, nothing):
    got = sharding.histogram_shards(awkward, 24).toPandas()
    assert len(got) == len(AWKWARD) and set(got.columns) == {"doc_id", "size", "text_crc32", "key_hash", "shard", "slot"}
    assert all(sorted(p.slot) == list(range(len(p))) for _, p in got.groupby("shard"))
    assert sharding.histogram_shards(nothing, 24).count() == 0


def test_token_files(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = queries.op2_token_files(spark, sf_dir).orderBy("doc_id").collect()
    at = 0
    for r, (i, t) in zip(got, sorted(zip(documents.doc_id, documents.text)), strict=True):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_awkward(spark, awkward, nothing):
    path = repair.token_files(awkward, vocabulary("word_bpe_49k.json"))
    got = repair.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 11]
    assert [r["n_tokens"] for r in got[1:4]] == [1, 1, 1]
    shard = spark.read.parquet(path).orderBy("part", "seq").first().asDict()
    assert repair.read_document(shard, 4).tobytes() == bytes(got[4]["ids"])
    assert repair.read_token_files(spark, repair.token_files(nothing, vocabulary("word_bpe_49k.json"))).count() == 0


def test_secrets(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.op3_secrets(spark, sf_dir).collect()}
    patterns = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    for i, t in zip(documents.doc_id, documents.text):
        spans = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p, g, least) in enumerate(patterns) for m in re.finditer(p, t or "", re.ASCII) if len(m[g]) >= least]
        text = ",".join(s for _, _, s in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for _, _, s in spans) for k in ("assign", "access", "hex")]


def test_secrets_awkward(spark, awkward, nothing):
    assert secrets.secret_spans(awkward).where("size(spans) > 0").count() == 0
    assert secrets.secret_spans(awkward).count() == len(AWKWARD) and secrets.secret_spans(nothing).count() == 0
    odd = spark.createDataFrame([(1, "é🙂 password=abcdef1 ☃ token='zzzzzzz'")], "doc_id long, text string")
    assert [(s["kind"], s["start"], s["end"]) for s in secrets.secret_spans(odd).first()["spans"]] == [("assign", 3, 19), ("assign", 22, 36)]


def test_topk_awkward(spark):
    v = [0.5, -0.25]
    rows = [(0, v), (0, v), (1, v), (2, v), (50, [1.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [-1.0, 1.0]), (None, v)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["id"], r["score"]) for r in got] == [(0, 1, 1, 20480), (0, 2, 2, 20480), (0, 3, 50, 16384), (0, 4, 9, -49152), (50, 1, 0, 16384), (50, 2, 1, 16384), (50, 3, 2, 16384), (50, 4, 9, 0)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_topk_with_a_very_common_vector(spark):
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.rand(1), F.rand(2))).cast("array<float>").alias("embedding")).cache()
    got = topk.top_k(rows).toPandas()
    data = rows.toPandas()
    x, ids = np.floor(np.stack(data.embedding).astype(float) * 256), data.vec_id.to_numpy()
    for q, part in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert part.sort_values("rank")[["id", "score"]].to_numpy().tolist() == [[ids[i], s[i]] for i in best]


def test_mixing(spark, sf_dir, documents):
    got = queries.op5_mixing(spark, sf_dir).toPandas()
    size = {i: len(words(t)) for i, t in zip(documents.doc_id, documents.text)}
    assert dict(zip(got.doc_id, got["size"])) == size
    source = dict(zip(documents.doc_id, documents.source))
    by = got.assign(source=got.doc_id.map(source)).groupby("source")
    sizes = by["size"].sum()
    weight = dict(zip(sorted(sizes.index), [5, 2, 1] * len(sizes)))
    target, free = {}, set(sizes.index)
    while True:  # reshare until none is above
        rest = 1.5 * sizes.sum() - sum(target.values())
        over = {s for s in free if rest * weight[s] / sum(weight[f] for f in free) > 2 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    for s, part in by:
        assert abs(part.target.iloc[0] - target[s]) < 1e-6 * max(1, target[s])
        assert abs(part.taken.sum() - target[s]) <= part["size"].max() / 2 + 1e-6
    assert (got.taken <= 2 * got["size"]).all()


def test_mixing_awkward(awkward, nothing):
    placed = mixing.curriculum(awkward)
    assert placed.count() == len(AWKWARD) and mixing.curriculum(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns
    assert mixed.count() == placed.agg(F.sum("copies")).first()[0]
    at = [x for r in mixing.positions(placed).collect() for x in r["positions"]]
    assert len(at) == mixed.count() and all(0 <= x <= 1 for x in at)


@pytest.mark.parametrize("doc_id", (None, 7))
def test_mixing_rows_of_one_id(spark, doc_id):
    rows = [(doc_id, " ".join(["w"] * (1 + i % 7) + [str(i)]), f"s{i % 3}") for i in range(2000)]
    got = mixing.positions(mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string"))).toPandas()
    for _, part in got.groupby("source"):
        taken = (part["size"] * part.positions.map(len)).sum()
        assert abs(taken - part.target.iloc[0]) <= 8 and taken > 0


def test_the_mix_is_sorted_by_position(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    placed = mixing.positions(mixing.curriculum(rows)).select("id", F.explode("positions").alias("at")).collect()
    mixed = [r["doc_id"] for r in mixing.mix(rows, partitions=3).collect()]
    assert mixed == [r["id"] for r in sorted(placed, key=lambda r: (r["at"], r["id"]))]


def test_the_query_reads_the_training_order(spark, sf_dir, monkeypatch):
    whole = queries.op5_mixing(spark, sf_dir).toPandas()
    ordered = mixing.ordered
    monkeypatch.setattr(mixing, "ordered", lambda copies, partitions=None: ordered(copies, partitions).where("position < 0.5"))
    half = queries.op5_mixing(spark, sf_dir).toPandas()
    assert len(half) == len(whole) and 0 < half.taken.sum() < whole.taken.sum() and not half.position.max() >= 0.5


def test_curriculum_follows_the_schedule(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    placed = mixing.positions(mixing.curriculum(rows)).withColumn("position", F.explode("positions")).toPandas()
    early = placed[placed.position < 0.5].groupby("source").size() / placed.groupby("source").size()
    assert early["s0"] == pytest.approx(0.5 + 0.5 / 4, abs=0.02) and early["s1"] == pytest.approx(0.5, abs=0.02) and early["s2"] == pytest.approx(0.5 - 0.5 / 4, abs=0.02)


def test_exact_dedup_awkward(awkward, nothing):
    got = exact_dedup.exact_dedup(awkward, F.col("doc_id") < 6).toPandas()
    assert len(got) == len(AWKWARD)
    by = got[got.id.notna()].set_index("id")
    assert by.loc[1, "keep_id"] == 3 == by.loc[2, "keep_id"]  # the most code points of the empty ones
    assert by.loc[7, "keep_id"] == 7 == by.loc[8, "keep_id"] and by.loc[8, "group_size"] == 2
    assert got[got.id.isna()].kept.all()
    assert exact_dedup.exact_dedup(nothing, F.col("doc_id") < 6).count() == 0
    assert exact_dedup.exact_dedup_docs(awkward, F.col("doc_id") < 6).columns == awkward.columns


def test_history_changes_no_result(awkward):
    sides = [F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0]
    got = [sorted(map(repr, exact_dedup.exact_dedup(awkward, s).select("id", "keep_id", "group_size", "kept").collect())) for s in sides]
    assert got[0] == got[1] == got[2]


def test_lookups_decide_what_joins_history(spark, monkeypatch):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 60).cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(rows, F.col("doc_id") < 100)
    assert got.where("kept").count() == 60 and got.where("in_history").count() == 200 and got.count() == 200
    new = pd.DataFrame({"page": 0, "digest": [bytes([k]) * 32 for k in (1, 2)], "n": [1, 1], "keep_id": [9, 8], "keep_length": [1, 1]})
    page = exact_dedup._pack_page(pd.DataFrame({"page": 0, "digest": [bytes([k]) * 32 for k in (2, 3)], "n": [5, 6], "keep_id": [4, 5], "keep_length": [1, 1]}))
    size = lambda: sorted(zip(g.digest.str[0], g.group_size, g.keep_id, g.in_history))
    g = exact_dedup._probe(new, page)
    assert size() == [(1, 1, 9, False), (2, 6, 4, True), (3, 6, 5, True)]
    monkeypatch.setattr(exact_dedup, "look_up", lambda levels, ranks, digests: np.full(len(digests), -1, np.int64))
    g = exact_dedup._probe(new, page)
    assert size() == [(1, 1, 9, False), (2, 1, 8, False), (2, 5, 4, True), (3, 6, 5, True)]  # a repeat would stay


def test_byte_bpe(spark, sf_dir, documents):
    import tiktoken

    tokens = bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
    got = {r["doc_id"]: r for r in queries.op7_byte_bpe(spark, sf_dir).collect()}
    for i, t in zip(documents.doc_id, documents.text):
        ids = np.array(plain.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_byte_bpe_awkward(awkward, nothing):
    where = queries.bpe_inputs()
    back = bpe.decode(bpe.encode(awkward, *where), *where).collect()
    assert collections.Counter(bytes(r["text"]) for r in back) == collections.Counter((r[1] or "").encode() for r in AWKWARD)
    assert bpe.digests(nothing, *where).count() == 0


def test_toxicity_query(spark, sf_dir, documents):
    got = queries.op8_toxicity(spark, sf_dir).toPandas()
    assert len(got) == len(documents)
    assert dict(zip(got.doc_id, got.held_out)) == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in documents.doc_id}
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxicity_held_out(spark):
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/labels.parquet").toPandas().set_index("doc_id").toxic
    got = queries.op8_toxicity(spark, root).where("held_out").toPandas()
    got = got[got.doc_id.isin(labels.index)]
    y = got.doc_id.map(labels).to_numpy()
    assert ((got.predicted == 1) & (y == 1)).sum() >= 0.75 * (y == 1).sum()
    assert ((got.predicted == 1) & (y == 0)).sum() <= 0.01 * (y == 0).sum()


def test_toxicity_never_reads_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, None, None), (4, 1, 1), (4, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for marks in (labels, none):
        for docs in (awkward, nothing):
            kept = toxicity.drop_toxic(docs, marks)
            assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert toxicity.score(awkward, toxicity.train(awkward, labels)).count() == len(AWKWARD)


def components_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    index = collections.defaultdict(list)
    for i, s in sets.items():
        for v in s:
            index[v].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = collections.Counter(j for v in s for j in index[v] if j < i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check_components(got, want):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup(spark, sf_dir, documents):
    check_components(queries.op9_near_dedup(spark, sf_dir).collect(), components_by_hand(zip(documents.doc_id, documents.text)))


def test_near_dedup_large_group(spark):
    """Copies with few and many edits, exact copies, a passage that all share, and texts longer than a sketch."""
    import random

    rng = random.Random(11)
    base, long, passage = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (120, 900, 60))
    rows = []
    for i in range(260):
        w = list(base if i % 2 else long)
        for _ in range(rng.choice((0, 1, 2, 4, 8, 16)) * (1 if i % 2 else 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(300 + i, " ".join([f"p{i}x{k}" for k in range(10 + i % 40)] + passage)) for i in range(120)]
    rows += [(500 + i, rows[1][1].upper()) for i in range(40)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = components_by_hand(rows)
    assert len({c for _, c in want.values()}) > 30
    check_components(got, want)


def test_near_dedup_of_texts_about_the_size_of_a_sketch(spark):
    """Texts of 60 to 128 shingles within ones a third longer: the longer one's sketch holds a part of the shared ones."""
    import random

    rng, rows = random.Random(3), []
    for k in range(400):
        n = rng.randrange(60, 129)
        m = rng.randrange(n * 120 // 100, n * 100 // 75 + 1)
        w = [f"t{k}x{rng.randrange(10**9)}" for _ in range(m + 4)]
        rows += [(2 * k, " ".join(w[: n + 4])), (2 * k + 1, " ".join(w))]
    want = components_by_hand(rows)
    assert len({c for _, c in want.values()}) == 400
    check_components(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), want)


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    """A chain of edits in which no pivot reaches all, with few members to a block, and hot values."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "FULL_PAIRS", (0, 1000))
    monkeypatch.setattr(near_dup, "HOT", 40)
    rows = [(i, " ".join([f"t{k}" for k in range(60)] + [f"u{k}" for k in range(i, i + 40)])) for i in range(0, 300, 3)]
    rows += [(1000 + i, " ".join([f"t{k}" for k in range(60)] + [f"x{i}y{k}" for k in range(5 + i % 40)])) for i in range(90)]
    want = components_by_hand(rows)
    assert 5 < len({c for _, c in want.values()}) < 150
    check_components(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), want)


def test_near_dedup_awkward(awkward, nothing):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(awkward).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[5] == (2, 4) and got[7] == (1, 7) == got[8][:1] + (7,)
    assert got[6] == (2, 6) and got[10][1] == 9 and got[None] == (1, None)
    assert near_dup.near_duplicates(awkward).count() == len(AWKWARD)
    assert near_dup.near_duplicates(nothing).count() == 0
    assert near_dup.drop_near_duplicates(awkward).columns == awkward.columns


def test_url_rules(spark):
    cases = {
        "https://a.com/en/1": ("a.com", "/en/1", "com/en/", "block"),
        "HTTP://WWW.Example.COM/en/7x?q#f": ("www.example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "http://x.net/de": ("x.net", "/de", None, "allow"),
        "http://x.org?es/": ("x.org", "", None, "allow"),
        "x.org/es/1": ("", "", None, "allow"),
        "a://b://c.org/es/": ("b:", "//c.org/es/", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, labels).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == list(cases.values())
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_block(spark):
    rows = [(i, f"https://{'spam' if i % 4 == 0 else 'good'}.info/{'casino' if i % 4 == 0 else 'news'}/{i}") for i in range(400)]
    pages = spark.createDataFrame([*rows, (1000, "https://spam.info/casino/x"), (1001, "https://good.info/news/y")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labels).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(400))
    assert got[1000] == "block" and got[1001] == "allow"


def test_chance_makes_no_rule(spark):
    import random

    rng = random.Random(9)
    for n in (58, 700):
        rows = [([f"path={rng.randrange(12)}", f"key={rng.randrange(12)}", f"host1={rng.randrange(12)}"], rng.random() < 0.45) for _ in range(n)]
        assert url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).count() == 0


def test_urls_of_very_many_keys(spark):
    query = "&".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}=1" for i in range(200))
    rows = [(i, f"https://{'spam' if i % 4 == 0 else 'good'}.info/x/{i}?{query}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = url_filter.judge(spark.createDataFrame([*rows, (1000, "https://a.info/" + "p/" * 50_000)], "page_id long, url string"), labels).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {i: "block" if i % 4 == 0 else "allow" for i in range(400)} | {1000: "allow"}


def test_a_rule_of_the_least_telling_tokens(spark):
    # x and y tell nothing alone and all together; eleven others each miss one good row.
    rows = []
    for i in range(200):
        x, y = i % 2 == 0, i // 2 % 2 == 0
        rows.append(([f"g{j:02}" for j in range(11) if i != 4 * j + 1] + ["x"] * x + ["y"] * y, x == y))
    got = {tuple(r["antecedent"]): r["confidence"] for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()}
    assert got[("x", "y")] == 1.0


def test_keys_that_stand_together_are_one_item(spark):
    keys = [f"key={k:02}" for k in range(40)]
    rows = [([*keys, "x"] if i % 2 else ["x"] if i % 3 else ["z"], i % 2 == 1 and i % 20 > 1) for i in range(200)]
    got = {tuple(r["antecedent"]) for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()}
    assert got == {(k,) for k in keys}


def test_mined_rules_by_hand(spark):
    import itertools

    rows = [(i, ["a", "b"] if i % 3 else ["a", "c"], i % 3 == 0 and i % 2 == 0) for i in range(60)] + [(i, ["b", "d"], True) for i in range(60, 75)]
    df = spark.createDataFrame(rows, "i int, tokens array<string>, bad boolean").select("tokens", "bad")
    got = {tuple(r["antecedent"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in url_filter.mine(df, 0.05, 0.5, 1, 0.0).collect()}
    n, found = len(rows), {}
    for k in (1, 2):
        for c in itertools.combinations("abcd", k):
            hold = [bad for _, t, bad in rows if set(c) <= set(t)]
            if hold and sum(hold) / n >= 0.05 and sum(hold) / len(hold) >= 0.5:
                found[c] = (round(sum(hold) / len(hold), 9), round(sum(hold) / n, 9))
    want = {c: v for c, v in found.items() if not any(set(p) < set(c) and found[p][0] >= v[0] for p in found)}
    assert got == want


def test_pipeline(spark, sf_dir, documents):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.toPandas()
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        after = docs.toPandas()
        assert list(after.columns) == columns, name
        if name == "exact_dedup":
            assert len(after) == before.text.map(lambda t: "".join(words(t))).nunique()
        if name == "near_dedup":
            want = components_by_hand(zip(before.doc_id, before.text))
            assert sorted(after.doc_id) == sorted(i for i, (_, c) in want.items() if i == c)
            kept = after
    taken = docs.groupBy("doc_id").count().toPandas()
    assert set(taken.doc_id) <= set(kept.doc_id) and taken["count"].max() <= 2
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in docs.collect())


@pytest.mark.parametrize("rows", ["awkward", "nothing"])
def test_pipeline_stages_awkward(spark, request, tmp_path, rows):
    docs = request.getfixturevalue(rows)
    spark.createDataFrame([(4, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "byte_bpe" or out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert (docs.count() > 0) == (rows == "awkward")
