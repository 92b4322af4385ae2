"""The queries of the corpus operators, each over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, licenses, runs, suffixes, trie, windows
from quarry.llm.common import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"), width=4, radius=4)


@query
def op6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.windows import drop_repeats

    out = drop_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op9_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


ORACLES["op9_chats"] = chat.SQL


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.licenses import scan, tree_path

    docs = table(spark, sf_dir, "documents")
    path = tree_path(*(F.col(c) for c in ("doc_id", "source", "lang", "text")))
    return scan(docs.select(path.alias("path"), "text"))


ORACLES["op4_licenses"] = licenses.SQL


@query
def op2_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.tiling import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tokens", "n_tiled", "coverage")


@query
def op3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query
def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.audio import describe, store

    return describe(cut(store(table(spark, sf_dir, "documents"))))


@query
def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.suffixes import drop_substrings

    out = drop_substrings(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import score

    return score(table(spark, sf_dir, "documents"))


ORACLES["op6_windows"] = windows.SQL
ORACLES["op10_suffixes"] = suffixes.SQL


@query
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return runs.digests(runs.periodic_runs(docs.select("doc_id", runs.with_loops(F.col("doc_id"), F.col("text")).alias("text"))))


ORACLES["op11_runs"] = runs.SQL


@query
def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), family=100)


ORACLES["op12_trie"] = trie.SQL


@query
def op13_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.histogram import pack_by_lengths

    return pack_by_lengths(table(spark, sf_dir, "documents"))
