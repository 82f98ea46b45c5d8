"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, crc_bucket, forget, lean, mixed, small_batches, trim, written

#: Hashed features; most positives and most unlabelled texts that the fit reads (bounded samples, by
#: md5 of the id); predicted is score >= THRESHOLD.
FEATURES, MOST_POSITIVE, MOST_UNLABELLED, THRESHOLD = 1 << 18, 8_000, 24_000, 0.3
#: A word gives itself and its first 4 and 5 bytes as features.
PREFIXES = (4, 5)
#: Only features of at least this count and share of the positives, and this many times likelier in
#: them than in clean texts, get a weight: single texts' chance words cannot be learned by heart.
LEAST_COUNT, LEAST_SHARE, LIFT = 3, 0.02, 2.5
#: Bytes of text whose features are made at once.
BLOCK = 1 << 20
STEPS, RATE, DECAY, BATCH = 700, 0.5, 1e-6, 384


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, in order: lower-cased words without edge punctuation, and
    their prefixes, hashed. White space and ASCII letters alone are folded."""
    words = Words(texts, lower=True)
    begin, end = words.begin.copy(), words.end.copy()
    data = words.data
    plain = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    for _ in range(2):  # up to two marks on either side
        on = end - begin > 1
        begin[on] += ~plain[begin[on]]
        on = end - begin > 1
        end[on] -= ~plain[end[on] - 1]
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    found = [(owner, words.hashes(begin, end))]
    for n in PREFIXES:
        long = end - begin > n
        found.append((owner[long], mixed(words.hashes(begin[long], begin[long] + n) + np.uint64(n))))
    of = np.concatenate([o for o, _ in found]).astype(np.uint64)
    key = np.concatenate([h for _, h in found]) % np.uint64(FEATURES)
    both = np.unique(of * np.uint64(FEATURES) + key)
    return (both // np.uint64(FEATURES)).astype(np.int64), (both % np.uint64(FEATURES)).astype(np.int64)


def fit_nnpu(positive: list[tuple[np.ndarray, int]], unlabelled: list[tuple[np.ndarray, int]], prior: float, width: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear classifier on `width` binary features (a text: those that may
    have a weight, and the number of all), fitted with the non-negative
    risk estimator: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), logistic loss. A step whose
    negative part falls below zero goes up that part alone, as it has begun to overfit. Adagrad."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(width), 0.0
    g2, b2 = np.full(width, 1e-4), 1e-4
    if not positive or not unlabelled:
        return w, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    b = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))

    def scores(docs):
        flat = np.concatenate([d for d, _ in docs]) if len(docs) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(docs)), [len(d) for d, _ in docs])
        scale = 1.0 / np.sqrt(np.maximum([n for _, n in docs], 1))
        return flat, of, scale, np.bincount(of, w[flat], len(docs)) * scale + b

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, z)
    for _ in range(STEPS):
        up = [unlabelled[i] for i in rng.integers(0, len(unlabelled), min(BATCH, len(unlabelled)))]
        pp = [positive[i] for i in rng.integers(0, len(positive), min(BATCH // 4, len(positive)))]
        pf, po, ps, pz = scores(pp)
        uf, uo, us, uz = scores(up)
        negative = loss(uz).mean() - prior * loss(pz).mean()
        gu, gp_neg = sigmoid(uz) / len(up), -prior * sigmoid(pz) / len(pp)
        if negative >= 0:
            gp = -prior * sigmoid(-pz) / len(pp) + gp_neg
        else:
            gu, gp = -gu, -gp_neg
        g = np.bincount(pf, (gp * ps)[po], width) + np.bincount(uf, (gu * us)[uo], width) + DECAY * w
        gb = gp.sum() + gu.sum()
        g2 += g * g
        b2 += gb * gb
        w -= RATE * g / np.sqrt(g2)
        b -= 0.1 * RATE * gb / np.sqrt(b2)
    return w, b


def margins(model: tuple[np.ndarray, float], docs: list[tuple[np.ndarray, int]]) -> np.ndarray:
    return np.array([model[0][d].sum() / max(1, n) ** 0.5 + model[1] for d, n in docs])


def telling(p: np.ndarray, u: np.ndarray, n_positive: int, n_unlabelled: int, prior: float) -> np.ndarray:
    """Which features may have a weight, from the number of positive and of unlabelled texts that have
    each. Unlabelled texts hold positives by the prior; what they hold besides is the clean texts'
    share, so the lift that is asked does not depend on the prior."""
    in_p, least = (p + 0.5) / (n_positive + 1), 0.5 / (n_unlabelled + 1)
    in_clean = np.maximum((u + 0.5) / (n_unlabelled + 1) - prior * in_p, least) / (1 - prior)
    return (p >= max(LEAST_COUNT, LEAST_SHARE * n_positive)) & (in_p > LIFT * in_clean)


def fit_calibrated(positive: list[tuple[np.ndarray, int]], unlabelled: list[tuple[np.ndarray, int]], prior: float, width: int) -> tuple[np.ndarray, float]:
    """fit_nnpu, moved and stretched so that a score of THRESHOLD is the margin at which
    recall**2 / P(predicted positive) is highest. That needs no negatives: both factors are measured
    on every fourth text, scored by a model that has not seen it."""
    turn = lambda docs, keep: [d for i, d in enumerate(docs) if (i % 4 == 3) != keep]
    model = fit_nnpu(positive, unlabelled, prior, width)
    if len(positive) < 8 or len(unlabelled) < 8:
        return model
    trial = fit_nnpu(turn(positive, True), turn(unlabelled, True), prior, width)
    p, u = np.sort(margins(trial, turn(positive, False))), np.sort(margins(trial, turn(unlabelled, False)))
    both = np.sort(np.concatenate([p, u]))
    cuts = (both[1:] + both[:-1]) / 2
    recall = 1 - np.searchsorted(p, cuts) / len(p)
    predicted = np.maximum(1 - np.searchsorted(u, cuts) / len(u), 0.5 / len(u))
    gain = recall**2 / predicted
    top = cuts[gain >= gain.max() * 0.999]
    cut = float((top.min() + top.max()) / 2) if len(top) else float(np.median(u))
    stretch = 4.0 / max(1e-3, float(np.median(p) - np.median(u)))
    return model[0] * stretch, (model[1] - cut) * stretch + float(np.log(THRESHOLD / (1 - THRESHOLD)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """A model from confirmed positives and unlabelled texts of the training part, which is where
    crc32(id) mod 4 is not 2. Labels of 0 serve only for the class prior: the positive share of
    labelled rows. Reads MOST_POSITIVE positives and MOST_UNLABELLED other texts at most, the first by
    md5 of the id, each whole; of an id that has several rows, one. Executors count in how many of
    these texts each feature is; the driver gets those counts (FEATURES at most) and then, of each
    text, the features that may have a weight, numbered densely."""
    part = crc_bucket("id", 4) != 2
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(part & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    n, n_pos = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0))).first()
    prior = min(0.9, max(n_pos / n if n else 0.01, 1e-3))
    order = F.md5(F.col("id").cast("string").cast("binary"))
    chosen_pos = marks.where("y > 0").orderBy(order).limit(MOST_POSITIVE).select("id", F.lit(True).alias("pos"))
    ids = docs.select(F.col(id_col).alias("id")).where(part).join(marks.where("y > 0"), "id", "left_anti")
    # Unlabelled texts stand for the whole mixture, so the positives' share is drawn from all rows.
    drawn = ids.distinct().orderBy(order).limit(MOST_UNLABELLED).select("id", F.lit(False).alias("pos"))
    chosen = F.broadcast(chosen_pos.unionByName(drawn))
    small_batches(docs.sparkSession)

    def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks(whole, "text", BLOCK):
                of, key = features(b.column("text"))
                cuts = np.searchsorted(of, np.arange(b.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("pos"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(key.astype(np.int32)))], ["id", "pos", "keys"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "pos", "text").mapInArrow(lean(to_features), "id long, pos boolean, keys array<int>")
    texts = written(picked.groupBy("id", "pos").agg(F.min("keys").alias("keys")))
    sizes = {r["pos"]: r["n"] for r in texts.groupBy("pos").agg(F.count("*").alias("n")).collect()}
    n_positive, n_drawn = sizes.get(True, 0), sizes.get(False, 0)
    # The mixture gets its share of positives, the first by id.
    share = min(n_positive, int(round(n_drawn * prior / (1 - prior))))
    last = texts.where("pos").select("id").orderBy("id").limit(share).agg(F.max("id")).first()[0] if share else None
    mixed_in = ~F.col("pos") | (F.col("id") <= F.lit(last).cast("long") if share else F.lit(False))
    told = texts.select("pos", mixed_in.alias("mix"), F.explode("keys").alias("key")).groupBy("key").agg(F.sum(F.col("pos").cast("int")).alias("p"), F.sum(F.col("mix").cast("int")).alias("u")).toArrow()
    p, u = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    p[told.column("key").to_numpy()], u[told.column("key").to_numpy()] = told.column("p").to_numpy(), told.column("u").to_numpy()
    on = np.flatnonzero(telling(p, u, n_positive, n_drawn + share, prior)) if n_positive else np.zeros(0, np.int64)
    number = np.full(FEATURES, -1, np.int32)
    number[on] = np.arange(len(on))
    held = docs.sparkSession.sparkContext.broadcast(number)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.list_value_length(b.column("keys")).to_numpy()
            mapped = held.value[b.column("keys").flatten().to_numpy()]
            told = mapped >= 0
            ends = np.cumsum(np.bincount(np.repeat(np.arange(len(size)), size)[told], minlength=len(size)))
            kept = np.split(mapped[told], ends[:-1]) if len(size) else []
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("pos"), b.column("mix"), pa.array(size.astype(np.int32)), pa.array([k.tobytes() for k in kept], pa.binary())], ["id", "pos", "mix", "n", "keys"])

    small = texts.select("id", "pos", mixed_in.alias("mix"), "keys").mapInArrow(lean(narrowed), "id long, pos boolean, mix boolean, n int, keys binary").toArrow().sort_by("id").to_pylist()
    forget(texts)
    rows = [(r["pos"], r["mix"], (np.frombuffer(r["keys"], np.int32), r["n"])) for r in small]
    mixture = [d for pos, _, d in rows if not pos] + [d for pos, mix, d in rows if pos and mix]
    w, b = fit_calibrated([d for pos, _, d in rows if pos], mixture, prior, max(1, len(on)))
    weights = np.zeros(FEATURES)
    weights[on] = w[: len(on)]
    del small, rows, mixture
    trim()  # the driver lives on
    return weights, b


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id and score in [0, 1] of the whole text. Null and empty texts have no features and score
    by the intercept alone; each repeated row is scored; null ids pass through."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), float(model[1])))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = held.value
        for whole in batches:
            for part in blocks(whole, "text", BLOCK):
                of, key = features(part.column("text"))
                n = np.bincount(of, minlength=part.num_rows)
                z = np.bincount(of, w[key], part.num_rows) / np.sqrt(np.maximum(n, 1)) + b
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["id", "score"])

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(apply), f"id {kind}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below THRESHOLD, with the columns of docs. The rejected ids, few,
    leave by an anti join; a repeated id goes if any of its rows is rejected; null ids stay."""
    bad = score(docs, train(docs, labels, id_col, text_col), id_col, text_col).where(F.col("score") >= THRESHOLD).select(F.col("id").alias("__id")).distinct()
    return docs.join(bad, docs[id_col] == bad["__id"], "left_anti")
