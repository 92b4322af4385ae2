"""A training corpus from the documents table, in five stages.

Each stage works on all that the one before kept; its result is written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, table
from quarry.llm.langid import keep_identified
from quarry.llm.packing import pack_documents
from quarry.llm.simhash import similar_groups
from quarry.llm.tiling import keep_clean
from quarry.llm.windows import drop_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those that cost far more than texts in any learned language, go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in 0.8 or more of their five-word shingles the one of the smallest id stays.
    Rows of one id are one document; a row without an id stays."""
    groups = similar_groups(docs, width=5, similarity=0.8)
    gone = cut(groups.where("doc_id <> component_id").select("doc_id").distinct())
    # the ids grow with the table: a merge join at every size
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of repeated passages of 50 or more words the first stays, the words of the others go; a document of which
    nothing is left goes too. Texts that lose nothing stay as they are; a null one becomes empty."""
    rest = [c for c in docs.columns if c != "text"]
    found = drop_repeats(docs, window=50, carry=rest, verbatim=True, keep_first=True)
    left = found.where("n_removed = 0 or n_removed < n_words")
    out = left.select(*(F.col(f"row.{c}").alias(c) for c in rest), F.col("kept").alias("text"))
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Code lengths, min-hash, tiles and packing are beyond SQL; tests hold the stages against brute force on
#: hand-made documents.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
