"""Exact cosine top-k of question vectors over chunk vectors, in one pass over the vectors.

Questions are a stated set; the tasks get them all at once. A task deals each batch of vectors into blocks around a few of them,
pivots. Angles obey the triangle inequality: by the angles of a question and of a block's vectors to the pivot no vector of the
block can be nearer than a bound, and a block that cannot reach a question's k best so far is not compared with it. At most tasks x
questions x k rows are shuffled for the final rank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of question vectors that go to the tasks at once; rows from which a batch is dealt into blocks, questions for each
#: pivot at least; questions multiplied at once.
PASS_BYTES, LEAST_ROWS, PER_PIVOT, BLOCK = 1 << 28, 256, 2, 512
#: Questions that are taken to the driver before their size is asked.
FEW = 10_000
#: More than rounding to 6 places and the bounds' own errors can make.
MARGIN = 3e-6


class DimensionMismatch(ValueError):
    """Code 4001: a vector of another dimension than the question's."""


def cosine(a: F.Column, b: F.Column) -> F.Column:
    """Cosine of two array columns; 0 if one has no length. For joined pairs, e.g. after a top-k."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    size = norm(x) * norm(y)
    return F.when(size == 0, 0.0).otherwise(dot / size)


def _units(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


class Search:
    """The k best of each question over the vectors of a task; ``compared`` of ``pairs`` of questions and vectors were."""

    def __init__(self, unit: np.ndarray, groups: list, depth: np.ndarray):
        self.unit, self.depth = unit, depth.astype(np.int64)
        self.by_group: dict = {}
        for i, g in enumerate(groups):
            self.by_group.setdefault(g, []).append(i)
        self.best: list[list[tuple]] = [[] for _ in range(len(unit))]
        self.least = np.full(len(unit), -np.inf)  # score of the k-th best
        self.compared = self.pairs = 0

    def add(self, vectors: np.ndarray, names: list, codes: np.ndarray | None, values: list) -> None:
        """Vectors with their ids and, if questions ask for groups, the number of each one's group in ``values``."""
        unit = _units(vectors)
        if codes is None:
            self._group(self.by_group.get(None, []), unit, np.arange(len(unit)), names)
            return
        order = np.argsort(codes, kind="stable")
        edges = np.searchsorted(codes[order], np.arange(len(values) + 1))
        for k, value in enumerate(values):
            if value in self.by_group:
                self._group(self.by_group[value], unit, order[edges[k] : edges[k + 1]], names)

    def _blocks(self, unit: np.ndarray, rows: np.ndarray, questions: int) -> list[tuple[np.ndarray, np.ndarray | None, float, float]]:
        """Rows around each pivot with the pivot and their least and greatest angle to it; no pivot for vectors without length."""
        own = unit[rows]
        long = (own * own).sum(axis=1) > 0.5
        out = [(rows[~long], None, 0.0, np.pi)] if (~long).any() else []
        rows, own = rows[long], own[long]
        n = min(math.isqrt(len(own)), questions // PER_PIVOT)  # few questions aren't worth many pivots
        if len(rows) < LEAST_ROWS or n < 2:
            return [*out, (rows, None, 0.0, np.pi)] if len(rows) else out
        pivots = own[:: len(own) // n][:n]
        cosines = own @ pivots.T
        home = cosines.argmax(axis=1)
        angle = _angles(cosines[np.arange(len(own)), home])
        order = np.lexsort((angle, home))
        edges = np.searchsorted(home[order], np.arange(len(pivots) + 1))
        for k in range(len(pivots)):
            at = order[edges[k] : edges[k + 1]]
            if len(at):
                out.append((rows[at], pivots[k], float(angle[at[0]]), float(angle[at[-1]])))
        return out

    def _group(self, questions: list[int], unit: np.ndarray, rows: np.ndarray, names: list) -> None:
        if not len(rows):
            return
        blocks = self._blocks(unit, rows, len(questions))
        for first in range(0, len(questions), BLOCK):
            own = np.array(questions[first : first + BLOCK])
            asked = self.unit[own]
            bounds = np.ones((len(own), len(blocks)))  # the greatest cosine that a block may have
            pivots = [k for k, x in enumerate(blocks) if x[1] is not None]
            if pivots:
                angle = _angles(asked @ np.stack([blocks[k][1] for k in pivots]).T)
                low, high = (np.array([blocks[k][i] for k in pivots]) for i in (2, 3))
                bounds[:, pivots] = np.cos(np.maximum(0.0, np.maximum(low - angle, angle - high)))
                bounds[(asked * asked).sum(axis=1) < 0.5] = 1.0  # without length: 0 to all
            self.pairs += len(own) * len(rows)
            for k in np.argsort(-bounds.mean(axis=0), kind="stable"):
                need = np.nonzero(bounds[:, k] + MARGIN >= self.least[own])[0]
                if len(need):
                    at = blocks[k][0]
                    self.compared += len(need) * len(at)
                    self._merge(own[need], np.round(asked[need] @ unit[at].T, 6), at, names)

    def _merge(self, questions: np.ndarray, scores: np.ndarray, rows: np.ndarray, names: list) -> None:
        hit = scores >= self.least[questions][:, None]
        for j in np.nonzero(hit.any(axis=1))[0]:
            q = int(questions[j])
            k, line = int(self.depth[q]), scores[j]
            at = np.nonzero(hit[j])[0]
            if len(at) > k:  # all that tie with the k-th stay until the ids decide
                at = at[line[at] >= np.partition(line[at], len(at) - k)[len(at) - k]]
            self.best[q] = sorted([*self.best[q], *((-float(line[i]) + 0.0, names[rows[i]]) for i in at)])[:k]
            if len(self.best[q]) == k:
                self.least[q] = -self.best[q][-1][0] if k else np.inf


def _best(asked, kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, groups, depth = asked.value
        search = Search(unit, groups, depth)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten()
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            if (sizes != unit.shape[1]).any() or flat.null_count:
                raise DimensionMismatch(f"4001: vectors are not of dimension {unit.shape[1]}")
            vectors = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            own = batch.column(2).dictionary_encode()
            codes = None if None in search.by_group else own.indices.fill_null(len(own.dictionary)).to_numpy(zero_copy_only=False)
            search.add(vectors, batch.column(0).to_pylist(), codes, own.dictionary.to_pylist())
        found = [(ids[q], name, -s + 0.0) for q, best in enumerate(search.best) for s, name in best]
        if found:
            q, name, s = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, kinds[0]), pa.array(name, kinds[1]), pa.array(s, pa.float64())], ["question_id", "chunk_id", "score"])

    return run


def top_k(vectors: DataFrame, questions: DataFrame, k: int | str = 5, id_col: str = "chunk_id", vector_col: str = "embedding", repo_col: str | None = None, whitelist: DataFrame | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``(question_id, chunk_id, score, rank)``: the k best of each question by cosine (rounded to 6
    places), ties by chunk id. ``questions`` has ``question_id, vector``, with ``repo_id`` if ``repo_col``
    restricts each to its repository, and a depth column if ``k`` names one. ``whitelist`` holds the ids
    that may be found; an empty one finds nothing. A vector of another dimension, or with a
    null in it, is an error; null vectors are left out."""
    data = vectors.where(F.col(vector_col).isNotNull())
    if whitelist is not None:
        data = data.join(whitelist.select(F.col(whitelist.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    repo = F.col(repo_col) if repo_col else F.lit(None).cast("string")
    data = data.select(F.col(id_col).alias("chunk_id"), F.col(vector_col).cast("array<double>").alias("v"), repo.alias("repo"))
    types = [questions.schema["question_id"].dataType, data.schema["chunk_id"].dataType]
    schema = f"question_id {types[0].simpleString()}, chunk_id {types[1].simpleString()}, score double"
    depth = F.col(k) if isinstance(k, str) else F.lit(k)
    asked = questions.where("vector is not null").select("question_id", F.col("vector").cast("array<double>"), (F.col("repo_id") if repo_col else F.lit(None)).alias("g"), depth.alias("depth"))
    spark = vectors.sparkSession
    few = asked.limit(FEW + 1).collect()
    size = sum(8 * len(r["vector"]) for r in few) if len(few) <= FEW else asked.agg(F.sum(8 * F.size("vector"))).first()[0]
    passes = max(1, -(-size // pass_bytes))
    out = None
    for i in range(passes):
        whole = passes == 1 and len(few) <= FEW
        rows = few if whole else asked.where(F.pmod(F.xxhash64("question_id"), F.lit(passes)) == i).collect()
        if not rows:
            continue
        if len({len(r["vector"]) for r in rows}) > 1:
            raise DimensionMismatch("4001: questions of several dimensions")
        unit = _units(np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1))
        shared = spark.sparkContext.broadcast(([r["question_id"] for r in rows], unit, [r["g"] for r in rows], np.array([r["depth"] for r in rows])))
        found = data.mapInArrow(_best(shared, [to_arrow_type(t) for t in types]), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")))
    if isinstance(k, str):
        limits = asked.select("question_id", "depth")
        return ranked.join(limits, "question_id").where("rank <= depth").drop("depth")
    return ranked.where(F.col("rank") <= k)


def fingerprint(embeddings: DataFrame) -> DataFrame:
    """A row per repository: vectors, distinct models and dimensions, and whether the space is one."""
    out = embeddings.groupBy("repo_id").agg(F.count("*").alias("n_vectors"), F.count_distinct("model").alias("n_models"), F.count_distinct(F.size("embedding")).alias("n_dimensions"), F.min("model").alias("model"), F.min(F.size("embedding")).alias("dimension"))
    return out.withColumn("uniform", (F.col("n_models") == 1) & (F.col("n_dimensions") == 1))
