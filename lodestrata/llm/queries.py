"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, mixing, near_dup, repair, secrets, sharding, topk, toxicity, url_filter
from .common import crc_bucket, vocabulary, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_inputs() -> tuple[str, str]:
    """The rank file, and the pattern that belongs to it."""
    import public_tokenizers

    return vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def in_history(docs: DataFrame, id_col: str = "doc_id") -> object:
    """The older half: ids up to the middle of their range. Which half is which changes no result."""
    span = docs.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    return F.col(id_col) <= F.lit(((span["lo"] or 0) + (span["hi"] or 0)) // 2)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.histogram_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = repair.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return repair.read_checksums(spark, path)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(F.col("id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix's training order is written without its texts; taken adds up the copies that stand in it,
    and position is the first one's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    placed = written(mixing.positions(mixing.curriculum(docs)).select(F.monotonically_increasing_id().alias("key"), "id", "size", "source_size", "target", "positions"))
    order = written(mixing.ordered(placed.select("key", "id", "size", F.explode("positions").alias("position"))))
    met = order.groupBy("key").agg(F.sum("size").alias("taken"), F.min("position").alias("position"))
    out = placed.join(met, "key", "left")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "position")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = exact_dedup.exact_dedup(docs, in_history(docs))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *bpe_inputs())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), (crc_bucket("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_docs(docs, in_history(docs))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def stage_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, *bpe_inputs())


def run_stages(spark: SparkSession, stages, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each stage's result is a table of its own, which the next one reads."""
    for _, stage in stages[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return stages[-1][1](spark, docs, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_token_files, op3_secrets, op4_topk, op5_mixing, op6_exact_dedup, op7_byte_bpe, op8_toxicity, op9_near_dedup, op10_url_filter)}


@functools.cache
def oracles() -> dict[str, str]:
    return {
        "op4_topk": """
with x as (select distinct vec_id, list_transform(embedding, lambda e: floor(e::double * 256)) as v
           from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
      from x q join x c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
        "op5_mixing": r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as h from documents),
src as (select source, sum(size)::bigint as source_size from sized group by source),
turns as (select *, row_number() over (order by source nulls last) - 1 as turn from src),
w as (select *, [5.0::double, 2.0::double, 1.0::double][(turn % 3 + 1)::int] as weight,
             [0.5::double, 0.0::double, -0.5::double][(turn % 3 + 1)::int] as tilt, source_size * 2.0::double as cap from turns),
lv as (select *, (sum(source_size) over () * 1.5::double
          - coalesce(sum(cap) over (order by cap / weight, turn rows between unbounded preceding and 1 preceding), 0.0))
          / sum(weight) over (order by cap / weight, turn rows between current row and unbounded following) as level from w),
met as (select level as lvl from lv where level <= cap / weight order by cap / weight, turn limit 1),
goal as (select source, source_size, tilt, least(cap, coalesce((select lvl from met) * weight, cap)) as target from lv),
placed as (select *, coalesce(sum(size) over (partition by source order by h rows between unbounded preceding and 1 preceding), 0)::double
                     + size::double / 2::double as middle from sized),
counted as (select p.doc_id, p.size, g.source_size, g.target, g.tilt, g.tilt + 1::double as b, least(1::double, p.middle / g.target) as share,
                   case when p.size > 0 then least(greatest(floor((g.target - p.middle) / g.source_size) + 1, 0), 2) else 0 end as copies
            from placed p join goal g on p.source is not distinct from g.source)
select doc_id, size, source_size, target, (size * copies)::bigint as taken,
       case when copies > 0 then case when tilt = 0 then share
            else (b - sqrt(greatest(0::double, b * b - 4::double * tilt * share))) / (2::double * tilt) end end as position
from counted""",
        "op6_exact_dedup": r"""
with k as (select doc_id, length(coalesce(text, '')) as n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over g as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id is not distinct from first_value(doc_id) over g as kept, text_sha256
from k window g as (partition by text_sha256 order by n desc, doc_id)""",
    }
