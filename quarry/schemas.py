"""Tables of the store: schemas, domains of their enumerations, and validation before a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 6
TABLES = {
    "repos": "id string, path string, type string, status string, file_count long, chunk_count long, created_at timestamp, updated_at timestamp, embedding_model_id string, embedding_dimension int",
    "files": "repo_id string, path string, content string",
    "chunks": "id string, repo_id string, file_path string, content string, chunk_type string, chunk_name string, start_line int, end_line int, created_at timestamp",
    "embeddings": "id string, chunk_id string, repo_id string, embedding array<float>, model string, created_at timestamp",
    "segments": "repo_id string, segment long, term string, df long, total long, docs binary, tfs binary, positions binary, tops binary, head binary",
    "chat_history": "id string, repo_id string, seq long, role string, content string, references_json string, created_at timestamp",
}
#: What tables are partitioned by, the repository first.
PARTITIONS = {"repos": ("id",), "segments": ("repo_id", "segment")} | {name: ("repo_id",) for name in ("files", "chunks", "embeddings", "chat_history")}
KEYS = {"repos": "id", "chunks": "id", "embeddings": "chunk_id", "chat_history": "id"}
DOMAINS = {("repos", "type"): ("local", "git"), ("repos", "status"): ("idle", "loaded", "indexing", "indexed", "failed"), ("chunks", "chunk_type"): ("function", "class", "generic")}


def columns(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name].split(", ")]


def broken(name: str) -> Column:
    """Whether a row breaks a domain or has no key or partition."""
    bad = F.lit(False)
    for (table, column), values in DOMAINS.items():
        if table == name:
            bad = bad | ~F.coalesce(F.col(column).isin(*values), F.lit(False))
    for c in {*PARTITIONS[name], *([KEYS[name]] if name in KEYS else [])}:
        bad = bad | F.col(c).isNull()
    return bad


def violations(name: str, rows: DataFrame) -> DataFrame:
    """Rows that break a domain, have no key or share it with another."""
    found = rows.where(broken(name)).select(F.lit(name).alias("table"))
    if name in KEYS:
        found = found.unionByName(rows.groupBy(KEYS[name]).count().where("count > 1").select(F.lit(name).alias("table")))
    return found
