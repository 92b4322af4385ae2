"""Scans of the store's tables, with the orders that callers rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunks_of(chunks: DataFrame, repo_id: str) -> DataFrame:
    """A repository's chunks by path, start line and id; null lines are 0."""
    rows = chunks.where(F.col("repo_id") == repo_id)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("start_line", "end_line")})
    return rows.orderBy("file_path", "start_line", "id")


def list_repos(repos: DataFrame) -> DataFrame:
    """Newest first, then by id, descending."""
    return repos.orderBy(F.desc("created_at"), F.desc("id"))


def by_readiness(repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repositories that can be asked, and the others."""
    ready = F.coalesce(F.col("status") == "indexed", F.lit(False))
    return repos.where(ready), repos.where(~ready)


def polled(shown: DataFrame, polled: DataFrame) -> DataFrame:
    """``(id, shown, now, changed)``: repositories as shown, with the status that a poll of some of them brought."""
    now = F.coalesce("polled", "status")
    met = shown.join(polled.select("id", F.col("status").alias("polled")), "id", "left")
    return met.select("id", F.col("status").alias("shown"), now.alias("now"), (now != F.col("status")).alias("changed"))


def history_of(history: DataFrame, repo_id: str) -> DataFrame:
    """A repository's messages, oldest first."""
    return history.where(F.col("repo_id") == repo_id).orderBy("created_at", "seq")


def lookup(rows: DataFrame, **keys: str) -> DataFrame:
    """The first row with these values, if any."""
    for c, v in keys.items():
        rows = rows.where(F.col(c) == v)
    return rows.limit(1)
