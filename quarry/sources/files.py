"""File sources: source trees and question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.trees import SourceTree, TooLarge  # noqa: F401


def tree(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """``(path, length, content)`` of a source tree, see :class:`quarry.sources.trees.SourceTree`."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(**{k: str(v) for k, v in options.items()}).load(root)


def tree_size(spark: SparkSession, root: str) -> DataFrame:
    """``(bytes, files)`` of everything below ``root``; contents are not read."""
    return tree(spark, root, prune=False, content=False).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def source_files(spark: SparkSession, root: str, repo_id: str, most_mb: int | None = None, git: bool = False) -> DataFrame:
    """``(repo_id, path, content)`` of the source files below ``root``, or, with ``git``, of a shallow clone of that
    repository, which is gone when it has been read. With ``most_mb`` a larger tree is an error."""
    if most_mb is not None and not git and tree_size(spark, root).first()["bytes"] > most_mb << 20:
        raise TooLarge(f"1001: more than {most_mb} MB")
    found = tree(spark, root, git=git, limit_bytes=(most_mb or 0) << 20)
    return found.select(F.lit(repo_id).alias("repo_id"), "path", "content")


def question_set(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(question_id, category, question, expected_files, expected_keywords)`` of a JSON question file, or of a folder of
    files with such an object in each of their ``lines``."""
    item = "struct<id: string, category: string, question: string, expectedFiles: array<string>, expectedKeywords: array<string>>"
    rows = spark.read.schema(f"questions array<{item}>").option("multiLine", not lines).json(path)
    q = rows.select(F.explode("questions").alias("q"))
    return q.select(F.col("q.id").alias("question_id"), "q.category", "q.question", F.col("q.expectedFiles").alias("expected_files"), F.col("q.expectedKeywords").alias("expected_keywords"))
