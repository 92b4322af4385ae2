"""Fusion of a dense and a sparse ranked list for each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quarry import config as C


def min_max(score: Column, *keys: str) -> Column:
    """Scaled to 0..1 within each list; 1 if all are equal, 0 for what is no number."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    return F.when(~finite, 0.0).when(high <= low, 1.0).otherwise((score - low) / (high - low))


def first_ranks(ranked: DataFrame, name: str) -> DataFrame:
    """``(question_id, chunk_id, <name>)``: an id's first rank; empty ids hold their place but have none."""
    kept = ranked.where(F.col("chunk_id").isNotNull() & (F.col("chunk_id").cast("string") != ""))
    return kept.groupBy("question_id", "chunk_id").agg(F.min("rank").alias(name))


def counted(both: DataFrame, seen: Observation | None) -> DataFrame:
    """Count the rows of each channel, those of both, and all, while the fusion runs."""
    if seen is None:
        return both
    d, s = F.col("dense_rank"), F.col("sparse_rank")
    return both.observe(seen, F.count(d).alias("dense"), F.count(s).alias("sparse"), F.count(F.when(d.isNotNull() & s.isNotNull(), 1)).alias("overlap"), F.count(F.lit(1)).alias("fused"))


def reciprocal_rank(dense: DataFrame, sparse: DataFrame, weights: DataFrame, k: int = C.RRF_K, seen: Observation | None = None) -> DataFrame:
    """``(question_id, chunk_id, dense_rank, sparse_rank, score, rank)``: w_d/(k+r_d) + w_b/(k+r_b), best
    first, ties by id in Unicode collation. ``weights`` has ``question_id, rrf_dense_weight,
    rrf_bm25_weight``."""
    both = first_ranks(dense, "dense_rank").join(first_ranks(sparse, "sparse_rank"), ["question_id", "chunk_id"], "full_outer")
    part = lambda w, r: F.coalesce(F.col(w) / (k + F.col(r)), F.lit(0.0))
    met = counted(both, seen).join(weights.select("question_id", "rrf_dense_weight", "rrf_bm25_weight"), "question_id")
    scored = met.withColumn("score", part("rrf_dense_weight", "dense_rank") + part("rrf_bm25_weight", "sparse_rank"))
    name = F.collate(F.col("chunk_id").cast("string"), "UNICODE")
    best = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), name)
    return scored.select("question_id", "chunk_id", "dense_rank", "sparse_rank", "score", F.row_number().over(best).alias("rank"))


def fuse_rrf(dense: DataFrame, sparse: DataFrame, weights: DataFrame, top_k: int = C.DEFAULT_TOP_K, k: int = C.RRF_K, seen: Observation | None = None) -> DataFrame:
    """Reciprocal rank fusion, cut to ``top_k`` and only then scaled to 0..1."""
    best = reciprocal_rank(dense, sparse, weights, k, seen).where(F.col("rank") <= top_k)
    return best.withColumn("score", min_max(F.col("score"), "question_id")).withColumn("fusion", F.lit("rrf"))


def fuse_weighted(dense: DataFrame, sparse: DataFrame, weights: DataFrame, top_k: int = C.DEFAULT_TOP_K, seen: Observation | None = None) -> DataFrame:
    """Weighted sum of both lists' scaled scores; a chunk in one list gets that side only. Ties go to the
    dense list's order, then to the sparse list's. ``weights`` has ``question_id, semantic_weight,
    lexical_weight``."""
    d = dense.withColumn("d", min_max(F.col("score"), "question_id")).select("question_id", "chunk_id", F.col("rank").alias("dense_rank"), "d")
    s = sparse.withColumn("s", min_max(F.col("score"), "question_id")).select("question_id", "chunk_id", F.col("rank").alias("sparse_rank"), "s")
    both = counted(d.join(s, ["question_id", "chunk_id"], "full_outer"), seen).join(weights.select("question_id", "semantic_weight", "lexical_weight"), "question_id")
    score = F.coalesce(F.col("d") * F.col("semantic_weight"), F.lit(0.0)) + F.coalesce(F.col("s") * F.col("lexical_weight"), F.lit(0.0))
    best = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), F.asc_nulls_last("dense_rank"), "sparse_rank")
    out = both.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    return out.select("question_id", "chunk_id", "dense_rank", "sparse_rank", "score", "rank", F.lit("weighted").alias("fusion"))


def jaccard(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """``(question_id, jaccard)`` of the two lists' ids, for questions with any; 0 where both are empty."""
    ids = lambda df, c: df.groupBy("question_id").agg(F.collect_set("chunk_id").alias(c))
    both = ids(dense, "d").join(ids(sparse, "s"), "question_id", "full_outer")
    shared = F.coalesce(F.size(F.array_intersect("d", "s")), F.lit(0))
    union = F.coalesce(F.size("d"), F.lit(0)) + F.coalesce(F.size("s"), F.lit(0))
    shared = F.when(F.col("d").isNull() | F.col("s").isNull(), 0).otherwise(shared)
    return both.select("question_id", F.when(union == 0, 0.0).otherwise(shared / (union - shared)).alias("jaccard"))
