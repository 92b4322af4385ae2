"""The engine's service surface: repositories, indexing, questions and history over one store.

Methods return ``{"code", "message", "data"}``; data are plain values or DataFrames. Embedder and
answerer are callables given by the caller; without a model, a hashing embedder stands in."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry import config as C
from quarry import schemas
from quarry.functions import text as T
from quarry.functions.imports import summary
from quarry.operators import chunking, context, dense, evaluate, retrieve, sparse, store
from quarry.operators.embed import Embedder, Model, embed_rows
from quarry.sources import files, tables

# Codes and their messages.
CODES = {0: "ok", 1001: "repository could not be loaded", 1002: "repository exists already", 1003: "no such repository", 1004: "repository is being indexed", 2001: "index is not built", 2002: "index exists already", 3001: "no relevant code", 4001: "embedding failed", 4002: "answering failed", 4003: "embedding model differs from the index", 5000: "internal error"}
#: Files of one repository's messages before they become one.
MESSAGE_FILES = 32


class Failed(Exception):
    def __init__(self, code: int, detail: str = ""):
        super().__init__(f"{code}: {CODES[code]}{': ' * bool(detail)}{detail}")
        self.code = code


def envelope(call: Callable[[], object]) -> dict:
    try:
        return {"code": 0, "message": CODES[0], "data": call()}
    except Failed as e:
        return {"code": e.code, "message": CODES[e.code], "data": None}


def hashing_embedder(dimension: int = 64) -> Embedder:
    """Unit vectors of hashed words: equal texts have equal vectors, texts with words in common are near."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest())
                out[k, h % dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return embed


def add_documents(vectors: DataFrame, rows: DataFrame, body: str, embedder: Embedder | Model) -> DataFrame:
    """The vectors table ``(chunk_id, repo_id, embedding)`` with those of ``rows`` (``chunk_id, repo_id``, a text column
    ``body``) added; the same chunk's are replaced."""
    return store.add_vectors(vectors, embed_rows(rows, body, embedder).select("chunk_id", "repo_id", "embedding"))


def embed_and_persist(rows: DataFrame, body: str, embedder: Embedder | Model, path: str, batch: int = C.EMBED_BATCH) -> None:
    """Vectors of ``chunk_id, repo_id`` rows as JSON lines, a directory for each repository."""
    embed_rows(rows, body, embedder, batch).select("chunk_id", "repo_id", "embedding").write.mode("overwrite").partitionBy("repo_id").json(path)


def model_text(content: object) -> str:
    """Plain text of a model's answer: a text, or the text parts of a list; empty for anything else."""
    if isinstance(content, str):
        return content
    parts = content if isinstance(content, list) else []
    return "".join(p if isinstance(p, str) else p.get("text", "") for p in parts if isinstance(p, str) or (isinstance(p, dict) and isinstance(p.get("text", ""), str)))


@F.pandas_udf(StringType())
def answer_text(content: pd.Series) -> pd.Series:
    """:func:`model_text` of answers in JSON."""
    return content.map(lambda x: model_text(json.loads(x)))


# What a repository's status is called.
STATUS_LABELS = {"idle": "空闲", "loaded": "已加载", "indexing": "索引中", "indexed": "已索引", "failed": "失败"}
#: What a user may do about a code.
ADVICE = {
    1002: "Ask the repository that is there, or reload it.",
    1003: "List the repositories and choose one of them.",
    1004: "Wait until status says indexed, or cancel the build.",
    2001: "Call build_index first.",
    3001: "Ask with other words, or of more chunks.",
    4001: "Use the embedder of the index, or build it anew.",
    4002: "Ask again later.",
    4003: "Set the model that the index was built with, or build it anew.",
}


def friendly_message(code: int | None, fallback: str) -> str:
    """Advice on a code, or the fallback."""
    return ADVICE.get(code, fallback)


class Chunker(Protocol):
    """Splits files ``(repo_id, path, content)`` into chunk rows."""

    def __call__(self, files: DataFrame, cfg: C.Config) -> DataFrame: ...


class DenseSearch(Protocol):
    """Ranks stored vectors for each question, as :func:`quarry.operators.dense.top_k` does."""

    def __call__(self, vectors: DataFrame, questions: DataFrame, k: int | str, *, repo_col: str | None, whitelist: DataFrame | None) -> DataFrame: ...


class SparseSearch(Protocol):
    """Ranks chunks of a full-text index, as :func:`quarry.operators.sparse.bm25` does."""

    def __call__(self, index: sparse.Index, questions: DataFrame, tokens: Column, limit: int | str, *, repo: bool, whitelist: DataFrame | None) -> DataFrame: ...


class Build:
    """A running build: its stage, and its Spark jobs by their group."""

    def __init__(self, group: str):
        self.group, self.stage, self.thread, self.error = group, "start", None, None

    def start(self, spark: SparkSession, work: Callable[[], object]) -> None:
        def run() -> None:
            spark.sparkContext.setJobGroup(self.group, self.group, interruptOnCancel=True)
            try:
                work()
            except Exception as e:  # told by the repository's status
                self.error = e

        self.thread = InheritableThread(target=run, daemon=True)
        self.thread.start()

    def progress(self, spark: SparkSession) -> dict:
        """Stage, and tasks of its running jobs: all and done."""
        tracker, total, done = spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for k in info.stageIds if info and info.status == "RUNNING" else ():
                if (stage := tracker.getStageInfo(k)) is not None:
                    total, done = total + stage.numTasks, done + stage.numCompletedTasks
        return {"stage": self.stage, "tasks": total, "done": done}


class Engine:
    """``chunker``, ``dense_search`` and ``sparse_search`` may be replaced by others of the same form."""

    def __init__(self, spark: SparkSession, path: str, cfg: C.Config = C.Config(), embedder: Embedder | Model | None = None, answerer: Callable[[str], str] | None = None, chunker: Chunker = chunking.chunk_files, dense_search: DenseSearch = dense.top_k, sparse_search: SparseSearch = sparse.bm25):
        self.spark, self.cfg, self.store = spark, cfg, store.Store(spark, path)
        self.embedder, self.answerer = embedder or hashing_embedder(), answerer
        self.chunker, self.dense_search, self.sparse_search = chunker, dense_search, sparse_search
        self.stages: list[dict] = []
        self.builds: dict[str, Build] = {}

    @contextmanager
    def _timed(self, stage: str, repo_id: str | None = None) -> Iterator[dict]:
        """Keep how long a stage took and the counts that it leaves; :meth:`stage_log` gives them as a table."""
        begin, counts = time.time(), {}
        try:
            yield counts
        finally:
            self.stages.append({"event_type": stage, "repo_id": repo_id, "ts": datetime.fromtimestamp(begin, UTC), "value": 1000 * (time.time() - begin), "counts": {k: int(v) for k, v in counts.items()}})

    def stage_log(self) -> DataFrame:
        """``(event_type, repo_id, ts, value, counts)``: milliseconds and row counts of the stages run so far; counts come from
        observations of the executions themselves."""
        return self.spark.createDataFrame(self.stages, "event_type string, repo_id string, ts timestamp, value double, counts map<string, long>")

    def health(self) -> dict:
        return envelope(lambda: {"status": "ok", "spark": self.spark.version})

    def _repo(self, repo_id: str) -> dict:
        row = self.store.read("repos", repo_id).first()
        if row is None:
            raise Failed(1003)
        return row.asDict()

    def _set(self, repo_id: str, **values) -> None:
        new = {k: F.lit(v) for k, v in values.items()} | {"updated_at": F.current_timestamp()}
        row = store.update(self.store.read("repos", repo_id), F.col("id") == repo_id, **new).collect()  # one row
        self.store.replace("repos", repo_id, self.spark.createDataFrame(row, schemas.TABLES["repos"]))

    def _load(self, place: str, kind: str, repo_id: str) -> int:
        """Read a repository's tree into the files table; how many files."""
        try:
            with self._timed("import", repo_id) as counts:
                n = self.store.replace("files", repo_id, files.source_files(self.spark, place, repo_id, C.REPO_MAX_SIZE_MB, git=kind == "git"))
                counts["files"] = n
                return n
        except Exception as e:
            raise Failed(1001, str(e)[:200]) from e

    def import_repo(self, path: str, kind: str = "local") -> dict:
        """Register a source tree and keep its files. A repository is there once its row is: files without one are
        replaced by the next import."""

        def call() -> dict:
            row = self.spark.createDataFrame([(path, kind)], "path string, type string").select(T.normalize_source(F.col("type"), F.col("path")).alias("path"), "type")
            place, remote = row.select("path", T.supported_git_url(F.col("path"))).first()
            if not place or (kind == "git") != remote:
                raise Failed(1001, "no such source")
            if store.duplicates(self.store.read("repos"), row).count():
                raise Failed(1002)
            repo_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}:{place}").hex
            n = self._load(place, kind, repo_id)
            now = F.current_timestamp()
            new = row.select(F.lit(repo_id).alias("id"), "path", "type", F.lit("loaded").alias("status"), F.lit(n).cast("long").alias("file_count"), F.lit(0).cast("long").alias("chunk_count"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("embedding_model_id"), F.lit(None).cast("int").alias("embedding_dimension"))
            self.store.replace("repos", repo_id, new)
            return {"repo_id": repo_id, "file_count": n}

        return envelope(call)

    def ensure_files(self, repo_id: str) -> bool:
        """Whether the repository's files are at hand; read again, a remote one cloned again, if they are missing. Never
        raises."""
        try:
            repo = self._repo(repo_id)
            return not self.store.read("files", repo_id).isEmpty() or self._load(repo["path"], repo["type"], repo_id) > 0
        except Exception:  # a missing tree is an answer here
            return False

    def forget_files(self, repo_id: str) -> int:
        """Drop the kept files of a repository; how many there were."""
        return self.store.drop("files", repo_id)

    def indexed(self) -> tuple[DataFrame, DataFrame]:
        """Repositories that can be asked, and the others."""
        return tables.by_readiness(self.store.read("repos"))

    def repos(self) -> dict:
        return envelope(lambda: tables.list_repos(self.store.read("repos")))

    def status(self, repo_id: str) -> dict:
        """The stored status; while this engine builds the index also how far the running job has come."""

        def call() -> dict:
            row = self._repo(repo_id)
            build = self.builds.get(repo_id)
            progress = build.progress(self.spark) if build and row["status"] == "indexing" else None
            return {k: row[k] for k in ("id", "status", "file_count", "chunk_count")} | {"progress": progress}

        return envelope(call)

    def build_index(self, repo_id: str, rebuild: bool = False, background: bool = False) -> dict:
        """Chunks, vectors and full-text segments of a repository; all is computed and checked before the first table
        changes. In the background the answer comes at once; :meth:`status` tells the progress, :meth:`cancel` ends it."""

        def call() -> dict:
            repo = self._repo(repo_id)
            if repo["status"] == "indexing":
                raise Failed(1004)
            if repo["status"] == "indexed" and not rebuild:
                raise Failed(2002)
            self._set(repo_id, status="indexing")
            build = self.builds[repo_id] = Build(f"build-{repo_id}-{uuid.uuid4().hex}")
            if not background:
                return self._build(repo_id, build)
            build.start(self.spark, lambda: self._build(repo_id, build))
            return {"status": "indexing"}

        return envelope(call)

    def _build(self, repo_id: str, build: Build) -> dict:
        try:
            with self._timed("chunk", repo_id) as counts:
                build.stage = "chunk"
                chunks = self.chunker(self.store.read("files", repo_id), self.cfg).persist()
                n = counts["chunks"] = chunks.count()
            body = T.index_body(F.col("file_path"), F.col("import_summary"), F.col("chunk_type"), F.col("chunk_name"), F.col("content"))
            bodies = chunks.select(F.col("id").alias("chunk_id"), "repo_id", body.alias("body"))
            with self._timed("embed", repo_id) as counts:
                build.stage = "embed"
                vectors = embed_rows(bodies, "body", self.embedder).persist()
                sizes = [r[0] for r in vectors.select(F.size("embedding")).distinct().collect()]
                counts["vectors"] = vectors.count()
            if len(sizes) > 1 or (sizes and self.cfg.embedding_dimension not in (None, sizes[0])):
                raise Failed(4001)
            now = F.current_timestamp()
            kept = vectors.select(F.col("chunk_id").alias("id"), "chunk_id", "repo_id", "embedding", F.lit(self.cfg.embedding_model).alias("model"), now.alias("created_at"))
            segments = sparse.Index.by_repository(bodies, F.col("body"), name=repo_id).rows
            with self._timed("store", repo_id) as counts:
                build.stage = "store"
                counts["chunks"] = self.store.replace("chunks", repo_id, chunks.drop("import_summary").withColumn("created_at", now))
                counts["embeddings"] = self.store.replace("embeddings", repo_id, kept)
                self.store.drop("segments", repo_id)  # segments are partitions of their own
                counts["segment_rows"] = self.store.append("segments", segments)
                self._set(repo_id, status="indexed", chunk_count=n, embedding_model_id=self.cfg.embedding_model, embedding_dimension=sizes[0] if sizes else None)
            vectors.unpersist()
            chunks.unpersist()
            return {"chunk_count": n, "status": "indexed"}
        except Exception:
            self._set(repo_id, status="failed")
            raise
        finally:
            self.builds.pop(repo_id, None)

    def cancel(self, repo_id: str) -> bool:
        """End a build in the background, if there is one: the repository has failed then, its tables are as they were
        unless the last stage had begun."""
        build = self.builds.get(repo_id)
        if build is None or build.thread is None:
            return False
        self.spark.sparkContext.cancelJobGroup(build.group)
        build.thread.join()
        return True

    def fts_index(self) -> sparse.Index:
        """The stored full-text index of all repositories."""
        return sparse.Index(self.store.read("segments"))

    def reload(self, repo_id: str) -> dict:
        """Read the tree again and rebuild the index."""

        def call() -> dict:
            repo = self._repo(repo_id)
            if repo["status"] == "indexing":
                raise Failed(1004)
            n = self._load(repo["path"], repo["type"], repo_id)
            self._set(repo_id, status="loaded", file_count=n)
            built = self.build_index(repo_id, rebuild=True)
            if built["code"]:
                raise Failed(built["code"])
            return built["data"]

        return envelope(call)

    def delete_chunks(self, repo_id: str, ids: DataFrame) -> dict:
        """Chunks, their vectors and their full-text rows; data: how many chunks went. What else the touched
        repository has is indexed again."""

        def call() -> dict:
            self._repo(repo_id)
            n = self.store.delete("chunks", ids, repo_id)
            if n:
                self.store.delete("embeddings", ids, repo_id)
                left = self.store.read("chunks", repo_id)
                source = self.store.read("files", repo_id).select(F.col("path").alias("file_path"), summary(F.col("content"), F.col("path")).alias("import_summary"))
                body = T.index_body(F.col("file_path"), F.col("import_summary"), F.col("chunk_type"), F.col("chunk_name"), F.col("content"))
                bodies = left.join(source, "file_path", "left").select(F.col("id").alias("chunk_id"), "repo_id", body.alias("body"))
                self.store.drop("segments", repo_id)
                self.store.append("segments", sparse.Index.by_repository(bodies, F.col("body"), name=repo_id).rows)
                self._set(repo_id, chunk_count=left.count())
            return {"deleted": n}

        return envelope(call)

    def delete_repo(self, repo_id: str) -> dict:
        """All that hangs on the repository, then its row: what stops halfway can be done again. Data: rows that went, by
        table."""

        def call() -> dict:
            self._repo(repo_id)
            self.cancel(repo_id)
            return {"repo_id": repo_id, "deleted": {n: self.store.drop(n, repo_id) for n in ("embeddings", "segments", "chunks", "files", "chat_history", "repos")}}

        return envelope(call)

    def guard(self, repo_id: str) -> dict | None:
        """The indexed space of a repository; none without vectors. Another model is an error (4003)."""
        row = dense.fingerprint(self.store.read("embeddings", repo_id)).first()
        if row is not None:
            self._same_space(row)
        return row and row.asDict()

    def _same_space(self, row) -> None:
        if not row["uniform"]:
            raise Failed(5000, "several models or dimensions")
        if row["model"] != self.cfg.embedding_model:
            raise Failed(4003)
        if self.cfg.embedding_dimension not in (None, row["dimension"]):
            raise Failed(4001)

    def ask(self, questions: DataFrame, top_k: int = C.DEFAULT_TOP_K, chunk_ids: DataFrame | None = None) -> dict:
        """Retrieve and pack for all of ``(question_id, repo_id, question)``; answer them if there is an
        answerer. Data: ``question_id, context, references[, answer]``; 3001 if nothing was found."""

        def call() -> DataFrame:
            repos = questions.select("repo_id").distinct()
            found = repos.join(self.store.of("repos", repos).select(F.col("id").alias("repo_id"), "status"), "repo_id", "left")
            for r in found.collect():  # repositories that are asked
                if r["status"] != "indexed":
                    raise Failed(1003 if r["status"] is None else 1004 if r["status"] == "indexing" else 2001)
            vectors = self.store.of("embeddings", repos)
            for r in dense.fingerprint(vectors).collect():
                self._same_space(r)
            asked = embed_rows(questions, "question", self.embedder).withColumnRenamed("embedding", "vector")
            chunks = self.store.of("chunks", repos).withColumnRenamed("id", "chunk_id")
            seen = Observation()
            best = retrieve.hybrid(chunks, vectors, asked, top_k, self.cfg, repo=True, whitelist=chunk_ids, index=self.fts_index(), dense_search=self.dense_search, sparse_search=self.sparse_search, seen=seen).persist()
            with self._timed("retrieve") as counts:  # both channels run once, here
                n = best.count()
                if n:
                    counts |= seen.get | {"kept": n, "dropped": seen.get["fused"] - n}
            if not n:
                raise Failed(3001)
            hits = best.withColumn("key", T.normalize_path(F.col("file_path"))).join(questions.select("question_id", "repo_id"), "question_id")
            files_ = self.store.of("files", repos).withColumn("key", T.normalize_path(F.col("path")))
            hit = files_.join(F.broadcast(hits.select("repo_id", "key").distinct()), ["repo_id", "key"], "left_semi")  # at most top_k files a question
            first = hit.groupBy("repo_id", "key").agg(F.min_by(F.struct("content", "path"), "path").alias("f"))
            with_files = hits.join(first.select("repo_id", "key", summary(F.col("f.content"), F.col("f.path")).alias("import_summary")), ["repo_id", "key"], "left")
            packed = context.pack_results(with_files, self.cfg.max_context_tokens)
            out = packed.join(retrieve.references(best), "question_id").join(questions.select("question_id", "question"), "question_id")
            if self.answerer is None:
                return out.select("question_id", "context", "references")
            prompts = out.withColumn("prompt", context.prompt(F.col("question"), F.col("context")))
            answerer = self.answerer

            @F.pandas_udf("string")
            def answer(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
                for part in parts:
                    yield part.map(answerer)

            return prompts.select("question_id", "context", "references", answer("prompt").alias("answer"))

        return envelope(call)

    def ensure_indexed(self, repo_id: str) -> dict:
        """Build the index unless there is one."""
        got = self.build_index(repo_id)
        return envelope(lambda: {"status": "indexed"}) if got["code"] == 2002 else got

    def acceptance(self, repo_id: str, question_file: str, top_k: int = 4, lines: bool = False) -> dict:
        """Ask a question file's questions, hold the answers against what is expected; data: ``results``, one row of
        ``summary``, and the Markdown ``report``. A question without any reference counts as missed."""

        def call() -> dict:
            asked = files.question_set(self.spark, question_file, lines)
            got = self.ask(asked.select("question_id", F.lit(repo_id).alias("repo_id"), "question"), top_k)
            if got["code"]:
                raise Failed(got["code"])
            answers = got["data"].select("question_id", F.col("answer") if self.answerer else F.lit(None).cast("string").alias("answer"), F.col("references.file_path").alias("paths"))
            results = evaluate.hits(asked.join(answers, "question_id", "left")).persist()
            return {"results": results, "summary": evaluate.summary(results).first().asDict(), "report": evaluate.report(results, "Acceptance")}

        return envelope(call)

    def history(self, repo_id: str) -> dict:
        return envelope(lambda: self._repo(repo_id) and tables.history_of(self.store.read("chat_history", repo_id), repo_id).withColumn("parsed", store.parse_references(F.col("references_json"))))

    def save_message(self, repo_id: str, role: str, content: str, references_json: str | None = None) -> dict:
        def call() -> dict:
            self._repo(repo_id)
            name = uuid.uuid4().hex
            new = self.spark.createDataFrame([(name, repo_id, 0, role, content, references_json)], "id string, repo_id string, seq long, role string, content string, references_json string")
            held = self.store.read("chat_history", repo_id)
            self.store.append("chat_history", store.next_messages(held, new.withColumn("created_at", F.current_timestamp())))
            if len(held.inputFiles()) >= MESSAGE_FILES:
                self.store.compact("chat_history", repo_id)
            return {"id": name}

        return envelope(call)

    def clear_history(self, repo_id: str) -> dict:
        return envelope(lambda: self._repo(repo_id) and {"deleted": self.store.drop("chat_history", repo_id)})
