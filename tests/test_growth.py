"""Work and memory that grow no faster than the tables: each of these failed before its finding was mended."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from testdata import SF

from quarry.functions import text as T
from quarry.operators import sparse
from quarry.plans import catalog, surface  # noqa: F401


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sources_are_dealt_to_all_cores(spark):
    """a table of one file's one block was one task."""
    assert catalog.QUERIES["chunk_sources"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_match_tokens_are_found_once(spark):
    """the pattern was run again for each token of a text."""
    df = spark.createDataFrame([("Beta alpha BETA gamma Alpha beta",), ("，",), (None,)], "q string")
    out = df.select(T.and_match(F.col("q")).alias("m"))
    assert optimized(out).count("regexp_extract_all") == 1
    assert [r.m for r in out.collect()] == ['"Beta" "alpha" "gamma"', None, None]


def test_budgets_are_packed_in_one_pass(spark):
    """each budget read, shuffled and measured all documents again."""
    assert optimized(catalog.QUERIES["context_budgets"](spark, SF)).count("Relation") == 1


def test_files_of_hits_only_are_summarized(spark, tmp_path):
    """each question met every file of its repository, and the imports of all of them were summarized."""
    from quarry.api import Engine

    e, repo = surface._filled_engine(spark, SF)
    assert e.build_index(repo)["code"] == 0
    asked = catalog.read(spark, SF, "benchmark").select(F.col("item_id").alias("question_id"), F.lit(repo).alias("repo_id"), F.col("text").alias("question"))
    plan = optimized(e.ask(asked)["data"])
    assert re.search(r"Join LeftSemi, .*\bkey#\d+ = key#\d+", plan), plan
    assert isinstance(e, Engine)


def test_segments_are_bounded_in_terms(spark):
    """F3, F4, F7, F8, F9, F12: 256 long chunks went into a segment at once, whatever their number of terms."""
    docs = spark.range(64).select(F.col("id").alias("chunk_id"), F.expr("array_join(transform(sequence(1, 4000), x -> concat('w', x % 50)), ' ')").alias("content")).coalesce(1)
    heads = sparse.Index.of(docs).rows.where("term = ''")
    assert max(r["total"] for r in heads.select("total").collect()) <= (1 << 16) + 4000
    assert sparse.SEGMENT_TERMS <= 1 << 20
    assert int(str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).removesuffix("b")) == sparse.BATCH_BYTES


def test_postings_come_in_arrays_over_many_terms(spark):
    """every term of a segment was a batch of its own."""
    docs = spark.createDataFrame([(1, "a b c a"), (2, "c d e f"), (3, "")], "chunk_id long, content string").coalesce(1)
    index = sparse.Index.of(docs)
    rows = pa.Table.from_batches(index.rows.toArrow().to_batches()).combine_chunks().to_batches()[0]
    segment = rows.filter(pc.not_equal(rows.column("term"), sparse.HEAD))
    made = sparse._posted(segment, pa.array([1, 2, 3], pa.int64()), pa.nulls(3, pa.string()), np.array([4, 4, 0], np.int32))
    assert made.num_rows == 7
    got = sorted((r.term, r.chunk_id, r.length, tuple(r.positions)) for r in index.postings().collect())
    assert got == [("a", 1, 4, (0, 3)), ("b", 1, 4, (1,)), ("c", 1, 4, (2,)), ("c", 2, 4, (0,)), ("d", 2, 4, (1,)), ("e", 2, 4, (2,)), ("f", 2, 4, (3,))]


def test_questions_that_ask_the_same_are_looked_up_once(spark, monkeypatch):
    """every 4,096 questions were a pass over the index, also where all asked the same few things."""
    docs = spark.range(30).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", F.concat(F.lit("w"), (F.col("id") % 3).cast("string")), F.lit("x")).alias("content"))
    asked = spark.range(40).select(F.col("id").alias("question_id"), F.array(F.concat(F.lit("w"), (F.col("id") % 4).cast("string"))).alias("tokens"), (F.col("id") % 2 + 1).cast("int").alias("depth"))
    index = sparse.Index.of(docs)
    every = [sorted(map(tuple, sparse.bm25(index, asked, F.col("tokens"), most).collect())) for most in (5, "depth")]
    monkeypatch.setattr(sparse, "BLOCK", 8)
    few = [sparse.bm25(index, asked, F.col("tokens"), most) for most in (5, "depth")]
    assert [sorted(map(tuple, df.collect())) for df in few] == every
    assert optimized(few[0]).count("MapInArrow") <= 2  # the index's own and one pass
