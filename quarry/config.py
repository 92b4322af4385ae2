"""Typed configuration: parsed once from a mapping, passed explicitly, never read from module state.

Invalid values fall back to the defaults."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

# Defaults and tuning constants of the retrieval rules.
CHUNK_MAX_LENGTH = 1500
CHUNK_OVERLAP = 200
DEFAULT_TOP_K = 5
MAX_CONTEXT_TOKENS = 8000
RRF_K = 60
RRF_EXPLAIN_BM25_WEIGHT = 0.35
RRF_WEIGHT_MAX = 2.0
DENSE_NL_MULT, DENSE_PL_MULT, SPARSE_PL_MULT = 1.08, 0.94, 1.15
NUDGE, SEMANTIC_MIN, SEMANTIC_MAX, LEXICAL_MIN, LEXICAL_MAX = 0.08, 0.22, 0.88, 0.12, 0.78
RRF_NL_DENSE, RRF_NL_BM25, RRF_PL_DENSE, RRF_PL_BM25 = 1.1, 0.88, 0.92, 1.14
REPO_MAX_SIZE_MB = 200
EMBED_BATCH, INFER_BATCH, EMBED_DIMENSION = 2048, 16, 768


def _number(value: str | None) -> float | None:
    try:
        x = float(value.strip()) if value is not None and value.strip() else math.nan
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def positive_int(value: str | None, default: int | None) -> int | None:
    x = _number(value)
    return math.floor(x) if x is not None and x > 0 else default


def clamped_float(value: str | None, default: float, low: float, high: float) -> float:
    x = _number(value)
    return x if x is not None and low <= x <= high else default


def flag(value: str | None, default: bool) -> bool:
    v = (value or "").strip().lower()
    return True if v in ("1", "true", "yes", "on") else False if v in ("0", "false", "no", "off") else default


def choice(value: str | None, options: tuple[str, ...], default: str) -> str:
    v = (value or "").strip().lower()
    return v if v in options else default


@dataclass(frozen=True)
class Config:
    chunk_max_length: int = CHUNK_MAX_LENGTH
    chunk_overlap: int = CHUNK_OVERLAP
    top_k: int = DEFAULT_TOP_K
    max_context_tokens: int = MAX_CONTEXT_TOKENS
    index_import_summary: bool = False
    bm25_top_n: int = 4 * DEFAULT_TOP_K
    sparse_mode: str = "fts"  # or full_table
    fusion: str = "weighted"  # or rrf
    dense_top_n: int | None = None
    rrf_k: int = RRF_K
    rrf_explain_bm25_weight: float = RRF_EXPLAIN_BM25_WEIGHT
    query_modality: str = "auto"  # or force_nl, force_pl
    embedding_model: str = "hashing"
    embedding_dimension: int | None = None

    @staticmethod
    def parse(env: Mapping[str, str]) -> Config:
        get = env.get
        return Config(
            positive_int(get("CHUNK_MAX_LENGTH"), CHUNK_MAX_LENGTH),
            positive_int(get("CHUNK_OVERLAP"), CHUNK_OVERLAP),
            positive_int(get("DEFAULT_TOP_K"), DEFAULT_TOP_K),
            positive_int(get("MAX_CONTEXT_TOKENS"), MAX_CONTEXT_TOKENS),
            flag(get("INDEX_IMPORT_SUMMARY"), False),
            positive_int(get("RETRIEVAL_BM25_TOP_N"), 4 * DEFAULT_TOP_K),
            "full_table" if get("RETRIEVAL_SPARSE_MODE") == "full_table" else "fts",
            choice(get("RETRIEVAL_FUSION"), ("rrf",), "weighted"),
            positive_int(get("RETRIEVAL_DENSE_TOP_N"), None),
            positive_int(get("RETRIEVAL_RRF_K"), RRF_K),
            clamped_float(get("RETRIEVAL_RRF_EXPLAIN_BM25_WEIGHT"), RRF_EXPLAIN_BM25_WEIGHT, 0, RRF_WEIGHT_MAX),
            choice(get("RETRIEVAL_QUERY_MODALITY"), ("force_nl", "force_pl"), "auto"),
            canonical_model_id(get("EMBEDDING_MODEL")),
            positive_int(get("EMBEDDING_DIMENSION"), None),
        )


def canonical_model_id(spec: str | None) -> str:
    """``local:owner/name`` stays so, an absolute path becomes ``file:path``, others are hub ids."""
    v = (spec or "").strip()
    if not v:
        return "hashing"
    if v.startswith("local:"):
        return "local:" + v[6:].strip("/")
    return f"file:{v}" if v.startswith("/") else v
