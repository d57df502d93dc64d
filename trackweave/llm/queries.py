"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import ann, langid, line_dedup, mixing, packing, quality, sharding, simhash, toxicity, vector_dedup
from trackweave.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.length("text").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors.where("vec_id % 50 = 0"), vectors)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Links of operator 2 by brute force, groups by following them.
_LINKS = """with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
l as materialized (select a.vec_id as a, b.vec_id as b from v a, v b where a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, other) as (select vec_id, vec_id from v union select r.id, l.b from r join l on r.other = l.a)
select id as vec_id, (select count(*) from l where l.a = id) as n_links, min(other) as component_id, id = min(other) as kept from r group by id"""


#: Sizes and water-filled targets of operator 4: caps of the sources of least cap / weight first.
_TARGETS = """with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) as n from d group by source),
w as (select *, (n - 1) % 3 + 1 as weight, cast(3 * source_size as double) as cap, sum(source_size) over () as whole from s),
r as (select *, coalesce(sum(cap) over (order by cap / weight, n rows between unbounded preceding and 1 preceding), 0) as below, sum(weight) over (order by cap / weight, n rows between current row and unbounded following) as rest from w),
l as (select *, (whole - below) / rest as level, cap / weight <= (whole - below) / rest as capped from r),
t as (select source, source_size, case when capped then cap else weight * (max(case when not capped then level end) over ()) end as target from l)
select d.doc_id, cast(d.size as bigint) as size, t.source_size, round(t.target, 6) as target from d join t on d.source is not distinct from t.source"""


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of operator 4: sizes and targets, without the rounding into copies."""
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


#: Words of operator 8 and bytes of operator 9, a row a document.
_WORDS = "select doc_id, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as words from documents"
_BYTES = "select doc_id, cast(coalesce(strlen(text), 0) + 16 as bigint) as size from documents"
#: Operator 7 by brute force, over vectors that have a direction.
_NEAREST = """with v as materialized (select vec_id, cast(embedding as double[]) as e from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as query_id, b.vec_id, list_cosine_similarity(a.e, b.e) as score from v a, v b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, rank, vec_id, round(score, 6) as score from (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from p) where rank <= 5"""


def packing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of operator 8: every word of a document is packed once."""
    return packing.pack(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.sum("words").alias("words"))


def sharding_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of operator 9: every document is in a shard, with its size."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents")).select("doc_id", "size")


def nearest_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 with scores rounded, to hold against brute force where nothing is missed."""
    return op7_nearest(spark, sf_dir).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality, op2_embedding_dedup, op3_language, op4_mixing, op5_simhash,
        op6_line_dedup, op7_nearest, op8_packing, op9_sharding, op10_toxicity, mixing_targets,
        packing_words, sharding_sizes, nearest_rounded,
    )}


def oracle_sql() -> dict[str, str]:
    """SQL of what it can express; hashes that it lacks, models and greedy choices are tested
    against brute force instead."""
    return {"op2_embedding_dedup": _LINKS, "mixing_targets": _TARGETS, "packing_words": _WORDS, "sharding_sizes": _BYTES, "nearest_rounded": _NEAREST}
