"""Helpers shared by the corpus operators: table access, lineage cuts, word rules."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where tests and single machines keep cut lineage when the cluster names no folder.
LOCAL_SHARED = Path("/tmp/quarry-shared")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else a local one (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_SHARED.as_uri()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and
    survives a lost executor. The table's folder is a fresh one each time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def settle(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose results are stored: nothing refers to them now."""
    gc.collect()
    spark._jvm.System.gc()


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 64) -> None:
    """From now on send at most so many rows to a Python worker at once: rows here are whole texts or
    blobs, and the buffers of the default of ten thousand of them may outgrow an executor."""
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, str(rows))


def wide_batches(spark: SparkSession, rows: int = 8192) -> None:
    """From now on send more rows at once: for steps over words, keys or links, run before the next
    step over texts."""
    spark.conf.set(_BATCH, str(rows))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``(doc_id bigint, text binary[, row struct])`` of the documents; a null text is empty. Only
    these columns are read, so columns of any other name can't clash with an operator's own;
    those in ``carry`` travel in ``row``."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
        *([F.struct(*carry).alias("row")] if carry else []),
    )


def keep_rows(docs: DataFrame, text_col: str, judge: Callable[[], Callable[[list[bytes | None]], list[bool]]]) -> DataFrame:
    """The rows whose text the judge keeps, all columns as they are, in one narrow pass. ``judge`` is
    called once in each task."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = judge()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield part.filter(pa.array(keeps(part.column(at).cast(pa.binary()).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def n_blocks(data: DataFrame, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` the texts make; grows with the input."""
    total = data.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def fold(col: Column, remainder_of: int) -> Column:
    """crc32 of the id as text, modulo: the fold of a document."""
    return F.crc32(col.cast("string").cast("binary")) % remainder_of


def sample_texts(rows: DataFrame, budget: int) -> list[bytes]:
    """Of ``(doc_id, text binary)`` the texts of the smallest hashes until ``budget`` bytes are reached, the
    last one cut there: the same ones however the table is dealt, at least one if there is any."""
    n, total = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if not n:
        return []
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 40))
    # several times the budget, and some dozens of texts at least: in these it is found, whatever the table's size
    wide = min(1.0, max(4.0 * budget / max(1, total or 0), 64.0 / n)) * (1 << 40)
    few = rows.select(draw.alias("draw"), F.substring("text", 1, budget).alias("text")).where(F.col("draw") < int(wide))
    before = F.sum(F.octet_length("text")).over(Window.orderBy("draw", "text").rowsBetween(Window.unboundedPreceding, -1))
    out, left = [], budget
    for r in few.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < budget).orderBy("draw", "text").collect():
        out.append(bytes(r["text"])[:left])
        left -= len(out[-1])
    return out


def signed(x: int) -> int:
    """A 64-bit pattern as a signed long."""
    return x - (1 << 64) if x >> 63 else x
