"""Blocks of documents that ask about keys and get answers.

A block is a few megabytes of whole documents. Operators whose unit is a window of text have
far more keys than documents; instead of a row for each window, a block sends its distinct
keys as sorted, delta-coded blobs, one to each bucket that it has keys in, and gets a bit for
each of them back. A key that a third of all documents hold is then one entry a block, and
blobs are never more than the windows themselves. Block bodies are stored compressed, once,
with the asks, in the shared folder; a lost executor repeats its part of a stage only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 2_000_000


def _give_back() -> None:
    """Have the C library return large arrays to the system once they are freed, so that a worker that
    goes on to the next stage doesn't hold the memory of the last."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


_give_back()

_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(data: bytes) -> bytes:
    return _zip.compress(data)


def unsqueeze(data: bytes) -> bytes:
    return _unzip.decompress(data)


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values: deltas, split into byte planes, compressed."""
    deltas = np.diff(values, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(unsqueeze(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_bits(bits: np.ndarray) -> bytes:
    return squeeze(np.packbits(bits).tobytes())


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unsqueeze(blob), np.uint8))[:n].astype(bool)


def body(head: pa.RecordBatch, docs: list[bytes]) -> tuple[bytes, bytes]:
    """A block's ids and carried columns, and its texts, as two blobs."""
    sink = pa.BufferOutputStream()
    whole = head.append_column("bytes", pa.array([len(x) for x in docs], pa.int64()))
    with pa.ipc.new_stream(sink, whole.schema) as out:
        out.write_batch(whole)
    return squeeze(sink.getvalue().to_pybytes()), squeeze(b"".join(docs))


def unbody(head: bytes, data: bytes) -> tuple[pa.RecordBatch, list[bytes]]:
    batch = pa.ipc.open_stream(unsqueeze(head)).read_next_batch()
    text, at, docs = unsqueeze(data), 0, []
    for n in batch.column("bytes").to_pylist():
        docs.append(text[at : at + n])
        at += n
    return batch.drop_columns(["bytes"]), docs


def blocks_of(batches: Iterator[pa.RecordBatch], limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive documents of up to ``limit`` bytes in all: the columns but ``text``, and the texts."""
    held: list[pa.RecordBatch] = []
    docs: list[bytes] = []
    size = 0

    def block() -> tuple[pa.RecordBatch, list[bytes]]:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0], docs

    for batch in batches:
        head, first = batch.drop_columns(["text"]), 0
        for k, text in enumerate(batch.column("text")):
            data = text.as_py()
            if docs and size + len(data) > limit:
                if k > first:
                    held.append(head.slice(first, k - first))
                yield block()
                held, docs, size, first = [], [], 0, k
            docs.append(data)
            size += len(data)
        if batch.num_rows > first:
            held.append(head.slice(first))
    if docs:
        yield block()


def n_buckets(size: int, unit: int) -> int:
    """How many buckets so much is dealt into: of ``unit`` each, of up to eight times as much in large tables, so that a
    block's blob for a bucket keeps holding several keys."""
    return max(1, -(-size // int(unit * min(8.0, max(1.0, (size / unit / 4096) ** 0.5)))))


#: Rows between blocks and buckets. kind 0 is a block's body (data: texts, more: ids), kind 1 an
#: ask or answer (bucket, n keys, data, more).
ROWS = "kind int, block long, bucket long, n long, data binary, more binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("more", pa.binary())])


def rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, x, strict=True)) for x in found], SCHEMA)


def fresh_block() -> int:
    """An id that no other block has; the blocks are stored before anything reads them."""
    return int(np.random.default_rng().integers(0, 1 << 62))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Runs of rows with the same key, of rows that come sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
            if held and held[-1][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def stored(found: DataFrame) -> Callable[[int], DataFrame]:
    """Write rows to the shared folder, apart by kind, and read one kind back: so each kind is read by
    those who need it, and can be deleted alone."""
    spark = found.sparkSession
    path = f"{shared_dir(spark)}/kinds-{fresh_block():x}"
    found.write.partitionBy("kind").option("compression", "uncompressed").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    schema, names = found.schema, found.columns

    def kind(k: int) -> DataFrame:
        own = f"{path}/kind={k}"
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(own)):
            out = spark.read.schema(schema).option("basePath", path).parquet(own).select(*names)
        else:
            out = spark.createDataFrame([], schema)
        out._cut_path = own
        return out

    return kind


def answered(asks: DataFrame, judge: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """Bring the asks of each bucket together and return what ``judge`` makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "bucket"):
            yield rows(judge(group))

    return asks.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, ROWS)


def per_block(bodies: DataFrame, answers: DataFrame, work: Callable[[list[dict], dict], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """Bring each block's body and the answers to it together: ``work(answers, body)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "block"):
            assert group[-1]["kind"] == 0, "a block without a body"
            yield from work(group[:-1], group[-1])

    both = bodies.unionByName(answers)
    return both.repartition("block").sortWithinPartitions("block", F.desc("kind"), "bucket").mapInArrow(run, out)


def judge_repeats(group: list[dict]) -> list[tuple]:
    """Which keys of each ask occur more than once in all: in several asks, or marked as repeated
    within one (``more``)."""
    keys = [unpack(r["data"]) for r in group]
    every = np.concatenate(keys)
    own = np.concatenate([unpack_bits(r["more"], r["n"]) for r in group])
    order = np.sort(every)
    again = np.unique(np.concatenate([order[1:][order[1:] == order[:-1]], every[own]]))
    del every, order, own
    out = []
    for r, k in zip(group, keys, strict=True):
        if len(again):
            at = np.minimum(np.searchsorted(again, k), len(again) - 1)
            hit = again[at] == k
        else:
            hit = np.zeros(len(k), bool)
        out.append((1, r["block"], r["bucket"], r["n"], pack_bits(hit), b""))
    return out
