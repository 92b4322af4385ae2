"""Incremental work with Structured Streaming: index files as they come and change; stage timings of events."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quarry import config as C
from quarry.functions import text as T
from quarry.operators import chunking, sparse
from quarry.operators.store import Store

FILES = "repo_id string, path string, version long, content string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Latest(StatefulProcessor):
    """For each path the latest version seen. What comes out are changes: a path's new content, null where the file is gone,
    and whether there was one before. An older version, or the content that is there, changes nothing."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "version long, digest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            for version, content in zip(part["version"], part["content"], strict=True):
                there = isinstance(content, str)
                digest = hashlib.sha256(content.encode()).hexdigest() if there else ""
                if best is None or (version, digest) > best[:2]:
                    best = int(version), digest, content if there else None
        version, digest, content = best
        old = self.seen.get() if self.seen.exists() else None
        if old is not None and (version <= old[0] or digest == old[1]):
            if version > old[0]:
                self.seen.update((version, digest))
            return
        self.seen.update((version, digest))
        before = old is not None and old[1] != ""
        if content is not None or before:
            yield pd.DataFrame({"repo_id": [key[0]], "path": [key[1]], "content": pd.Series([content], dtype=object), "replaced": [before]})

    def close(self) -> None:
        pass


def changes(files: DataFrame) -> DataFrame:
    """``(repo_id, path, content, replaced)``: what a stream of ``(repo_id, path, version, content)`` changes, by keyed state."""
    keyed = files.where("repo_id is not null and path is not null").withColumn("version", F.coalesce("version", F.lit(0))).groupBy("repo_id", "path")
    return keyed.transformWithStateInPandas(Latest(), "repo_id string, path string, content string, replaced boolean", "Update", "none")


def apply_changes(store: Store, batch: DataFrame, cfg: C.Config = C.Config(), name: str = "") -> dict[str, int]:
    """Changed files' chunks take the place of those of the same paths; the full-text segments of the touched repositories
    follow. Applied twice it leaves the same. Returns chunks and segment rows written."""
    batch = batch.persist()
    try:
        repos = [r[0] for r in batch.select("repo_id").distinct().collect()]  # those that changed
        paths = batch.select("repo_id", F.col("path").alias("file_path"))
        new = chunking.chunk_files(batch.where("content is not null").select("repo_id", "path", "content"), cfg)
        new = new.drop("import_summary").withColumn("created_at", F.current_timestamp())
        touched = store.read("chunks").where(F.col("repo_id").isin(repos))
        whole = touched.join(paths, ["repo_id", "file_path"], "left_anti").select(*touched.columns).unionByName(new.select(*touched.columns)).persist()
        left = {r[0]: r[1] for r in whole.groupBy("repo_id").count().collect()}
        body = T.index_body(F.col("file_path"), F.lit(None).cast("string"), F.col("chunk_type"), F.col("chunk_name"), F.col("content"))
        rows = whole.withColumnRenamed("id", "chunk_id").repartition("repo_id").sortWithinPartitions("repo_id", "chunk_id")
        for repo in repos:
            store.drop("segments", repo)
        out = {"segment_rows": store.append("segments", sparse.Index.by_repository(rows, body, name).rows)}
        for repo in set(repos) - set(left):
            store.drop("chunks", repo)
        out["chunks"] = store.overwrite("chunks", whole)  # last: what was read may be gone now
        whole.unpersist()
        return out
    finally:
        batch.unpersist()


def index_files(spark: SparkSession, source: str, target: str, checkpoint: str, cfg: C.Config = C.Config()) -> StreamingQuery:
    """Keep chunks and segments (tables of a store at ``target``) up to date with Parquet files tables ``(repo_id, path, version,
    content)`` that arrive under ``source``: all there is now. A path that comes again is replaced, one that comes with null
    content is gone."""
    files = spark.readStream.schema(FILES).parquet(source)
    held = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # of this query alone
    try:
        write = lambda batch, n: apply_changes(Store(batch.sparkSession, target), batch, cfg, f"batch {n}")
        return changes(files).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, held)


def event_stages(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(event_type, start, n, total, mean, worst)`` of event values in tumbling windows; works on a stream
    (late events are dropped after the watermark) and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.max("value").alias("worst"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", "total", "mean", "worst")
