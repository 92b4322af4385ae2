"""Hybrid retrieval for a batch of questions: both channels, fusion, payload of the hits only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry import config as C
from quarry.operators import classify, dense, fusion, lexical, sparse


def hybrid(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, k: int = C.DEFAULT_TOP_K, cfg: C.Config = C.Config(), repo: bool = False, whitelist: DataFrame | None = None, index: sparse.Index | None = None, dense_search=dense.top_k, sparse_search=sparse.bm25, seen: Observation | None = None) -> DataFrame:
    """``(question_id, rank, chunk_id, score, fusion)`` with the chunk's payload columns.

    ``chunks``: ``chunk_id, [repo_id,] file_path, content, chunk_type, chunk_name, start_line``; ``vectors``:
    ``chunk_id, embedding[, repo_id]``; ``questions``: ``question_id, question, vector[, repo_id]``. An empty
    whitelist finds nothing, none at all restricts nothing. ``index`` is the chunks' stored full-text index; without
    one their contents are indexed for this query. Scores come first; payload is joined
    after the cut, so that only hits carry text. ``seen`` gets the channels' counts when the result is worked out."""
    asked = classify.classify(questions, k, cfg)
    d = dense_search(vectors, asked, "dense_depth", repo_col="repo_id" if repo else None, whitelist=whitelist)
    if cfg.sparse_mode == "full_table":
        s = lexical.scan(chunks, asked, "lexical_depth", repo, whitelist)
    else:
        s = sparse.to_lexical(sparse_search(index or sparse.Index.of(chunks), asked, F.col("tokens"), "bm25_depth", repo=repo, whitelist=whitelist))
    if cfg.fusion == "rrf":
        best = fusion.fuse_rrf(d, s, asked, k, cfg.rrf_k, seen)
    else:
        best = fusion.fuse_weighted(d, s, asked, k, seen)
    payload = chunks.select("chunk_id", "file_path", "content", "chunk_type", "chunk_name")
    return best.join(payload, "chunk_id").select("question_id", "rank", "chunk_id", "score", "fusion", "file_path", "content", "chunk_type", "chunk_name")


def references(results: DataFrame) -> DataFrame:
    """``(question_id, references array<struct<chunk_id, file_path, snippet, score>>)`` in rank order, from the
    results alone."""
    item = F.struct("rank", F.struct("chunk_id", "file_path", F.col("content").alias("snippet"), "score").alias("reference"))
    return results.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("r")).select("question_id", F.col("r.reference").alias("references"))


def with_sources(results: DataFrame, files: DataFrame) -> DataFrame:
    """Results with the source file of their path (``source``, null if none); the first file by path
    wins among those that normalize alike."""
    from quarry.functions.text import normalize_path

    own = files.select(normalize_path(F.col("path")).alias("key"), "path", F.col("content").alias("source"))
    first = own.groupBy("key").agg(F.min_by("source", "path").alias("source"))
    return results.withColumn("key", normalize_path(F.col("file_path"))).join(first, "key", "left").drop("key")
