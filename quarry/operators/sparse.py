"""Full-text search: an index in segments by document, corpus statistics and BM25 over phrases.

A segment is an inverted index of some thousand chunks, made by the task that read them: a row for each term with its
chunks, counts and places, and a row that describes the chunks. Nothing is shuffled to write it, a frequent term is
spread over all segments, and a query's terms are filters of the scan. All of a chunk's terms are in its segment, so a task
scores its segments by itself: ranges of chunks come in the order of the most that they could score, until the bound falls
below the k-th best so far. Only k rows a task and question are shuffled. Every query token is a phrase: its terms must follow each other.
Statistics cover the whole table; filters restrict results only."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions import text as T

# The usual BM25 constants, and what stands for an idf that isn't positive.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Chunks and terms of a segment at most, chunks of a range with a bound of its own, chunks added at once.
SEGMENT_CHUNKS, SEGMENT_TERMS, RANGE, STEP = 1 << 15, 1 << 20, 256, 256
#: Bytes that are worth a task; bytes and rows that are sent to a Python worker at once; index rows that become postings at once.
SPLIT, BATCH_BYTES, BATCH_ROWS, POSTED = 1 << 22, 1 << 24, 4096, 1024
#: Terms that are a list in the filter; ids of a whitelist that are sent to the tasks; questions scored in one pass.
TERMS, WHITELIST, BLOCK = 200, 1 << 22, 4096
#: The row of a segment that describes its chunks.
HEAD = ""
#: ``df`` and ``total`` are chunks and places of the term; of the head row, all chunks and terms. ``tops`` has range, most places and
#: least length for each range with the term. In the head row ``docs`` is the name of the ids' type.
ROWS = "segment long, term string, df long, total long, docs binary, tfs binary, positions binary, tops binary, head binary"


def _blob(values: np.ndarray) -> bytes:
    return values.astype(np.int32).tobytes()


def _values(blob: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(blob, np.int32)


def _column(blobs: pa.Array) -> np.ndarray:
    """The values of all blobs of a column without nulls, one after another, as they lie in its buffer."""
    if not len(blobs):
        return np.empty(0, np.int32)
    _, ends, data = blobs.buffers()
    low, high = np.frombuffer(ends, np.int32)[[blobs.offset, blobs.offset + len(blobs)]]
    return np.frombuffer(data, np.int32)[low // 4 : high // 4] if high > low else np.empty(0, np.int32)


def bounded_batches(spark: SparkSession) -> None:
    """From now on what is sent to a Python worker at once is bounded in bytes too: rows here hold the terms or postings of many
    chunks."""
    for name, most in (("Bytes", BATCH_BYTES), ("Records", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        now = int(str(spark.conf.get(key)).lower().removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


class _Writer:
    """A segment in the making."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.heads: list[pa.RecordBatch] = []
        self.lengths: list[np.ndarray] = []
        self.chunks = self.terms = 0

    def add(self, batch: pa.RecordBatch) -> None:
        lists = batch.column("terms")
        coded = lists.flatten().dictionary_encode()
        own = np.array([self.codes.setdefault(t, len(self.codes)) for t in coded.dictionary.to_pylist()], np.int32)
        self.parts.append(own[coded.indices.to_numpy()] if len(own) else np.empty(0, np.int32))
        self.lengths.append(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32))
        self.heads.append(batch.drop_columns(["terms"]))
        self.chunks += batch.num_rows
        self.terms += len(self.parts[-1])

    def rows(self, segment: int) -> pa.RecordBatch:
        """The head, then a row for each term in order: columns are slices of arrays over all postings."""
        terms = sorted(self.codes)
        place = np.empty(len(terms), np.int32)
        place[[self.codes[t] for t in terms]] = np.arange(len(terms))
        length, code = np.concatenate(self.lengths), place[np.concatenate(self.parts)]
        doc = np.repeat(np.arange(len(length), dtype=np.int32), length)
        pos = np.arange(len(doc), dtype=np.int32) - np.repeat(np.cumsum(length, dtype=np.int32) - length, length)
        order = np.argsort(code, kind="stable")  # by chunk and place within a term
        c, d, pos = code[order], doc[order], pos[order]
        new = lambda *keys: np.nonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])[: len(keys[0])])[0]
        first = new(c, d)
        docs, tfs, owner = d[first], np.diff(first, append=len(c)), c[first]
        edge = new(owner, docs // RANGE)
        upto = np.searchsorted(owner, np.arange(len(terms) + 1))
        places, ranges = np.append(first, len(c))[upto], np.searchsorted(edge, upto)
        tops = np.stack([docs[edge] // RANGE, np.maximum.reduceat(tfs, edge), np.minimum.reduceat(length[docs], edge)], 1) if len(edge) else np.empty((0, 3))

        def column(values: np.ndarray, offsets: np.ndarray, head: bytes | None) -> pa.Array:
            made = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(_blob(values))])
            return pa.concat_arrays([pa.array([head], pa.binary()), made])

        table = pa.Table.from_batches(self.heads).combine_chunks()
        table = table.append_column("length", pa.array(length.astype(np.int32)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        kind = str(table.schema.field("chunk_id").type).encode()
        columns = [
            pa.array(np.full(len(terms) + 1, segment)),
            pa.array([HEAD, *terms], pa.string()),
            pa.array(np.append(self.chunks, np.diff(upto))),
            pa.array(np.append(self.terms, np.diff(places))),
            column(docs, 4 * upto, kind),
            column(tfs, 4 * upto, None),
            column(pos, 4 * places, None),
            column(tops.ravel(), 12 * ranges, None),
            pa.concat_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(len(terms), pa.binary())]),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ROWS.split(", ")])


def segment_terms(chunks: DataFrame) -> int:
    """Terms of a segment such that small tables too have some segments for each core; by the size of what is read."""
    size = int(chunks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(SEGMENT_TERMS, max(1 << 16, size // (6 * chunks.sparkSession.sparkContext.defaultParallelism)))


def spread(chunks: DataFrame) -> DataFrame:
    """A table too small to be split for all cores is dealt out to them first; larger ones are read as they are split."""
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    small = int(chunks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < cores * SPLIT
    return chunks.repartition(cores) if small else chunks


def _invert(name: str, apart: bool, most: int):
    """Segments of a task's chunks in the order they come; with ``apart`` none has chunks of two repositories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = (zlib.crc32(name.encode()) >> 8) << 39 | TaskContext.get().partitionId() << 16, 0
        own, home = _Writer(), None

        def done() -> pa.RecordBatch:
            rows = own.rows(base | n)
            return rows.append_column("repo_id", pa.array([home] * rows.num_rows, pa.string())) if apart else rows

        for batch in batches:
            before = np.append(0, np.cumsum(pc.list_value_length(batch.column("terms")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))
            homes = batch.column("repo_id").to_pylist() if apart else [None] * batch.num_rows
            edges = [0, *(k for k in range(1, len(homes)) if homes[k] != homes[k - 1]), len(homes)]
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                at = first
                while at < last:
                    if own.chunks and (own.chunks >= SEGMENT_CHUNKS or own.terms >= most or homes[at] != home):
                        yield done()
                        own, n = _Writer(), n + 1
                    home = homes[at]
                    full = int(np.searchsorted(before, before[at] + most - own.terms, "right")) - 1  # of a long chunk, it alone
                    upto = min(at + STEP, last, max(at + 1, full))
                    own.add(batch.slice(at, upto - at))
                    at = upto
        if own.chunks:
            yield done()

    return run


def lengths(chunks: DataFrame, body: Column) -> DataFrame:
    """``(chunk_id, length)`` in terms."""
    return chunks.select("chunk_id", F.size(T.fts_terms(body)).alias("length"))


def corpus_stats(chunks: DataFrame, body: Column) -> DataFrame:
    """One row: chunks, terms and their mean per chunk."""
    return lengths(chunks, body).agg(F.count("*").alias("n_chunks"), F.sum("length").alias("n_terms"), F.avg("length").alias("avg_length"))


def document_frequency(chunks: DataFrame, body: Column) -> DataFrame:
    """``(term, df, cf)``: chunks with the term, and occurrences."""
    per_chunk = chunks.select("chunk_id", F.explode(T.fts_terms(body)).alias("term")).groupBy("term", "chunk_id").count()
    return per_chunk.groupBy("term").agg(F.count("*").alias("df"), F.sum("count").alias("cf"))


class Segment:
    """One segment's rows of some terms, at hand to be scored."""

    def __init__(self, head: bytes, rows: dict[str, dict]):
        self.table = pa.ipc.open_stream(head).read_all()
        self.length = self.table.column("length").to_numpy()
        self.rows, self._lists, self._ids, self._homes = rows, {}, None, None

    def ids(self) -> list:
        if self._ids is None:
            self._ids = self.table.column("chunk_id").to_pylist()
        return self._ids

    def homes(self) -> np.ndarray:
        if self._homes is None:
            own = self.table.column("repo_id").to_pylist() if "repo_id" in self.table.column_names else [None] * len(self.length)
            self._homes = np.array([None if x is None else str(x) for x in own], object)
        return self._homes

    def places(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        """Chunk and place of each occurrence."""
        row = self.rows[term]
        return np.repeat(_values(row["docs"]), _values(row["tfs"])), _values(row["positions"])

    def occurrences(self, terms: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Chunks of a phrase, how often each has it, and the bounds ``tops``; nothing if there is none."""
        if terms not in self._lists:
            self._lists[terms] = self._occurrences(terms)
        return self._lists[terms]

    def _occurrences(self, terms: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if any(t not in self.rows for t in terms):
            return None
        if len(terms) == 1:
            row = self.rows[terms[0]]
            return _values(row["docs"]), _values(row["tfs"]), _values(row["tops"]).reshape(-1, 3).T
        starts = None
        for off, t in enumerate(terms):
            doc, pos = self.places(t)
            at = (doc.astype(np.int64) << 32) + pos - off
            starts = at if starts is None else np.intersect1d(starts, at, assume_unique=True)
        starts = starts[(starts & 0xFFFFFFFF) < 1 << 31]
        if not len(starts):
            return None
        doc, tf = np.unique(starts >> 32, return_counts=True)
        edge = np.nonzero(np.concatenate([[True], doc[1:] // RANGE != doc[:-1] // RANGE]))[0]
        return doc, tf, np.stack([doc[edge] // RANGE, np.maximum.reduceat(tf, edge), np.minimum.reduceat(self.length[doc], edge)])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Segment, list | None]]:
    """Whole segments, with the chunks that may be found if there is a column of them."""
    now, head, allowed, rows = None, None, None, {}
    for batch in batches:
        blobs = {n: batch.column(n) for n in ("docs", "tfs", "positions", "tops") if n in batch.schema.names}
        for k, (segment, term) in enumerate(zip(batch.column("segment").to_pylist(), batch.column("term").to_pylist(), strict=True)):
            if segment != now:
                if head is not None:
                    yield Segment(head, rows), allowed
                now, head, allowed, rows = segment, None, None, {}
            if term == HEAD:
                head = batch.column("head")[k].as_py()
                allowed = batch.column("allowed")[k].as_py() if "allowed" in batch.schema.names else None
            else:  # views of the batch, no copies
                rows[term] = {n: c[k].as_buffer() for n, c in blobs.items()}
    if head is not None:
        yield Segment(head, rows), allowed


def _weigh(tf: np.ndarray, length: np.ndarray, avg: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))


class Scorer:
    """The best chunks of each question over the segments of a task; ``visited`` of ``ranges`` were scored."""

    def __init__(self, asked: list[tuple], phrases: list[tuple[str, ...]], idf: np.ndarray, avg: float, match_all: bool):
        self.asked, self.phrases, self.idf, self.avg, self.match_all = asked, phrases, idf, avg, match_all
        self.best: dict[int, list[tuple]] = {}
        self.visited = self.ranges = 0

    def add(self, segment: Segment, allowed: list | None, listed: bool) -> None:
        n = len(segment.length)
        ranges = -(-n // RANGE)
        edges = np.arange(ranges + 1) * RANGE
        may = None
        if listed:
            may = np.zeros(n, bool)
            may[allowed or []] = True
        lists: dict[int, tuple] = {}  # phrase -> chunks, weights, edges of ranges, ranges, their bounds
        for p, terms in enumerate(self.phrases):
            if (found := segment.occurrences(terms)) is not None:
                doc, tf, tops = found
                weight = self.idf[p] * _weigh(tf, segment.length[doc], self.avg)
                lists[p] = doc, weight, np.searchsorted(doc, edges).tolist(), tops[0], self.idf[p] * _weigh(tops[1], tops[2], self.avg)
        for q, (_, own, most, repo) in enumerate(self.asked):
            mine = [lists[p] for p in own if p in lists]
            if not mine or most < 1 or (self.match_all and len(mine) < len(own)):
                continue
            free = may
            if repo is not None:
                free = segment.homes() == repo if may is None else may & (segment.homes() == repo)
            if free is not None and not free.any():
                continue
            bound = np.zeros(ranges)
            for *_, at, top in mine:
                bound[at] += top
            best = self.best.setdefault(q, [])
            self.ranges += ranges
            for r in np.argsort(-bound, kind="stable").tolist():
                if bound[r] <= 0 or (len(best) == most and -bound[r] - 1e-6 > best[-1][0]):
                    break  # no range from here on can reach the last of the best
                self.visited += 1
                self._range(segment, best, mine, r, most, len(own), free)

    def _range(self, segment: Segment, best: list[tuple], mine: list[tuple], r: int, most: int, width: int, free: np.ndarray | None) -> None:
        low, high = r * RANGE, min((r + 1) * RANGE, len(segment.length))
        score, met = np.zeros(high - low), np.zeros(high - low, np.int32)
        for doc, weight, edge, *_ in mine:
            a, b = edge[r], edge[r + 1]
            if b > a:
                at = doc[a:b] - low
                score[at] += weight[a:b]
                met[at] += 1
        keep = met == width if self.match_all else met > 0
        if free is not None:
            keep &= free[low:high]
        score = np.round(-score, 6)
        if len(best) == most:
            keep &= score <= best[-1][0]
        at = np.nonzero(keep)[0]
        if len(at) > most:  # all that tie with the last stay until the ids decide
            at = at[score[at] <= np.partition(score[at], most - 1)[most - 1]]
        if len(at):
            ids = segment.ids()
            best[:] = heapq.nsmallest(most, [*best, *((s + 0.0, ids[low + k]) for s, k in zip(score[at].tolist(), at.tolist(), strict=True))])


@dataclass(frozen=True)
class Index:
    """Rows of segments (see ``ROWS``), with ``repo_id`` if segments are kept apart by repository."""

    rows: DataFrame

    @staticmethod
    def of(chunks: DataFrame, body: Column | None = None, name: str = "") -> Index:
        """The index of ``(chunk_id[, repo_id], ...)``, in one narrow pass; ``name`` tells the segments of one write from others."""
        body = F.col("content") if body is None else body
        bounded_batches(chunks.sparkSession)
        own = ["chunk_id", *(["repo_id"] if "repo_id" in chunks.columns else [])]
        return Index(chunks.select(*own, T.fts_terms(body).alias("terms")).mapInArrow(_invert(name, False, segment_terms(chunks)), ROWS))

    @staticmethod
    def by_repository(chunks: DataFrame, body: Column, name: str = "") -> Index:
        """The same with segments of one repository each, and its ``repo_id`` in every row. Chunks that come in the order of
        their repositories make the fewest segments."""
        bounded_batches(chunks.sparkSession)
        rows = chunks.select("chunk_id", F.col("repo_id").cast("string").alias("repo_id"), T.fts_terms(body).alias("terms"))
        return Index(rows.mapInArrow(_invert(name, True, segment_terms(chunks)), f"{ROWS}, repo_id string"))

    def write(self, path: str) -> Index:
        """Store the index, a file for each segment, and read it back."""
        self.rows.sortWithinPartitions("segment", "term").write.mode("overwrite").partitionBy("segment").parquet(path)
        return Index.read(self.rows.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.schema(ROWS).parquet(path))

    def stats(self) -> DataFrame:
        """One row ``(n_chunks, n_terms)``."""
        return self.rows.where(F.col("term") == HEAD).agg(F.sum("df").alias("n_chunks"), F.sum("total").alias("n_terms"))

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The rows of the terms, and the heads."""
        every = sorted({HEAD, *terms})
        if len(every) <= TERMS:
            return self.rows.where(F.col("term").isin(every))
        wanted = self.rows.sparkSession.createDataFrame([(t,) for t in every], "term string")
        return self.rows.join(F.broadcast(wanted), "term", "left_semi")  # of at most BLOCK questions

    def postings(self, kind: str = "long") -> DataFrame:
        """``(term, chunk_id, repo_id, length, positions)``: the index as rows of each term and chunk, ``kind`` being the ids' type."""
        bounded_batches(self.rows.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, ids, home, length = None, None, None, None
            for batch in batches:
                segments = batch.column("segment").to_numpy()
                edges = [0, *(np.nonzero(segments[1:] != segments[:-1])[0] + 1).tolist(), len(segments)]
                for first, last in zip(edges[:-1], edges[1:], strict=True):
                    rows = batch.slice(first, last - first)
                    if last > first and segments[first] != now:  # a segment's rows begin with its head
                        segment = Segment(rows.column("head")[0].as_py(), {})
                        now, ids, home, length = segments[first], segment.table.column("chunk_id").combine_chunks(), pa.array(segment.homes(), pa.string()), segment.length
                    rows = rows.filter(pc.not_equal(rows.column("term"), HEAD))
                    for at in range(0, rows.num_rows, POSTED):
                        yield _posted(rows.slice(at, POSTED), ids, home, length)

        return _keyed(self.rows).mapInArrow(run, f"term string, chunk_id {kind}, repo_id string, length int, positions array<int>")

    def chunks(self, kind: str = "long") -> DataFrame:
        """``(segment, doc, chunk_id)``: the chunks by their number in their segment."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for segment, head in zip(batch.column("segment").to_pylist(), batch.column("head").to_pylist(), strict=True):
                    ids = pa.ipc.open_stream(head).read_all().column("chunk_id").combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array([segment] * len(ids), pa.int64()), pa.array(np.arange(len(ids), dtype=np.int32)), ids], ["segment", "doc", "chunk_id"])

        return _keyed(self.rows.where(F.col("term") == HEAD)).select("segment", "head").mapInArrow(run, f"segment long, doc int, chunk_id {kind}")


def _posted(rows: pa.RecordBatch, ids: pa.Array, home: pa.Array, length: np.ndarray) -> pa.RecordBatch:
    """The postings of some terms of one segment: arrays over all of them."""
    doc, tf, places = (_column(rows.column(n)) for n in ("docs", "tfs", "positions"))
    at = pa.array(doc)
    term = rows.column("term").take(pa.array(np.repeat(np.arange(rows.num_rows), rows.column("df").to_numpy())))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)).astype(np.int32)), pa.array(places))
    return pa.RecordBatch.from_arrays([term, ids.take(at), home.take(at), pa.array(length[doc]), lists], ["term", "chunk_id", "repo_id", "length", "positions"])


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows of segments whose numbers are told apart over repositories too."""
    return rows.withColumn("segment", F.xxhash64("repo_id", "segment")).drop("repo_id") if "repo_id" in rows.columns else rows


def phrases(questions: DataFrame, tokens: Column) -> DataFrame:
    """``(question_id, phrase, terms)``: each query token with its terms; a token without terms contributes nothing."""
    each = questions.select("question_id", F.explode(F.array_distinct(tokens)).alias("phrase"))
    return each.withColumn("terms", T.fts_terms(F.col("phrase"))).where(F.size("terms") > 0)


def phrase_df(index: Index, wanted: list[tuple[str, ...]]) -> np.ndarray:
    """In how many chunks each phrase occurs: sums over the segments, of the stored counts where it is one term."""
    out = np.zeros(len(wanted), np.int64)
    single: dict[str, list[int]] = {}
    for k, terms in enumerate(wanted):
        if len(terms) == 1:
            single.setdefault(terms[0], []).append(k)
    if single:
        for r in index.of_terms(list(single)).where(F.col("term") != HEAD).groupBy("term").agg(F.sum("df").alias("df")).collect():
            out[single[r["term"]]] = r["df"]
    several = {k: terms for k, terms in enumerate(wanted) if len(terms) > 1}
    if several:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = dict.fromkeys(several, 0)
            for segment, _ in _segments(batches):
                for k, terms in several.items():
                    if (found := segment.occurrences(terms)) is not None:
                        total[k] += len(found[0])
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], ["phrase", "df"])

        rows = _keyed(index.of_terms(sorted({t for terms in several.values() for t in terms})))
        for r in rows.mapInArrow(run, "phrase int, df long").groupBy("phrase").agg(F.sum("df").alias("df")).collect():
            out[r["phrase"]] = r["df"]
    return out


def _score(asked: list[tuple], wanted: list[tuple[str, ...]], idf: np.ndarray, avg: float, match_all: bool, listed: bool, kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(asked, wanted, idf, avg, match_all)
        for segment, allowed in _segments(batches):
            scorer.add(segment, allowed, listed)
        rows = [(asked[q][0], name, score) for q, found in scorer.best.items() for score, name in found]
        if rows:
            q, name, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, kinds[0]), pa.array(name, kinds[1]), pa.array(score, pa.float64())], ["question_id", "chunk_id", "bm25"])

    return run


def _restricted(rows: DataFrame, index: Index, whitelist: DataFrame, kind: str) -> DataFrame:
    """Rows whose heads carry the numbers of the chunks that may be found."""
    ids = whitelist.select(F.col(whitelist.columns[0]).cast(kind).alias("chunk_id")).distinct()
    own = index.chunks(kind).join(ids, "chunk_id", "left_semi").groupBy("segment").agg(F.collect_list("doc").alias("allowed"))  # of one segment
    own = own.withColumn("term", F.lit(HEAD))
    if ids.limit(WHITELIST + 1).count() <= WHITELIST:
        return rows.join(F.broadcast(own), ["segment", "term"], "left")
    return rows.join(own, ["segment", "term"], "left").repartition("segment").sortWithinPartitions("segment")


def bm25(index: Index, questions: DataFrame, tokens: Column, limit: int | str = 20, repo: bool = False, match_all: bool = False, whitelist: DataFrame | None = None) -> DataFrame:
    """``(question_id, chunk_id, bm25, rank)``: smaller is better; ties by chunk id.

    With ``repo`` a chunk's ``repo_id`` must equal the question's; of an index that is stored by repository only the asked ones
    are read. ``match_all`` asks for every phrase, else any will do. ``limit`` is a number or a column of ``questions``.
    ``whitelist`` holds the ids that may be found; an empty one finds nothing. Scores are rounded to 6 places before they are
    ranked. Questions, a stated set, go to the tasks in blocks, each with its own terms; where they are many, those that ask
    the same are one; ids are of the questions' kind unless the index says otherwise."""
    spark = index.rows.sparkSession
    bounded_batches(spark)
    n, total, ids = index.rows.where(F.col("term") == HEAD).agg(F.sum("df"), F.sum("total"), F.max("docs")).first()
    avg = float(total or 0) / n if n and total else 1.0
    depth = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    group = F.col("repo_id").cast("string") if repo else F.lit(None).cast("string")
    kind = {"string": "string", "large_string": "string", "int32": "int"}.get(bytes(ids or b"").decode(), "long")
    id_type = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[kind]
    kinds = [to_arrow_type(questions.schema["question_id"].dataType), id_type]
    schema = f"question_id {questions.schema['question_id'].dataType.simpleString()}, chunk_id {kind}, bm25 double"
    wanted = phrases(questions, tokens).groupBy("question_id").agg(F.collect_list("terms").alias("phrases"))
    asked = questions.select("question_id", depth.cast("int").alias("most"), group.alias("g")).join(wanted, "question_id")
    few = asked.limit(BLOCK + 1).collect()
    blocks, same = 1, None
    if len(few) > BLOCK:  # of those that ask the same one is looked up
        same = asked.withColumn("asks", F.to_json(F.struct(F.array_sort("phrases").alias("p"), "most", "g"))).select("question_id", "most", "g", "phrases", "asks")
        leads = same.groupBy("asks").agg(F.min("question_id").alias("lead"))
        same = same.join(leads, "asks").persist()
        asked = same.where("question_id = lead").select("question_id", "most", "g", "phrases")
        few = asked.limit(BLOCK + 1).collect()
        blocks = 1 if len(few) <= BLOCK else -(-asked.count() // BLOCK)
    out = None
    for i in range(blocks):
        own = few if blocks == 1 else asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i).collect()
        number: dict[tuple[str, ...], int] = {}
        rows = [(r["question_id"], [number.setdefault(tuple(p), len(number)) for p in r["phrases"]], r["most"], r["g"]) for r in own]
        if not rows:
            continue
        lists = list(number)
        df = phrase_df(index, lists)
        raw = np.log(((n or 0) - df + 0.5) / (df + 0.5))
        idf = np.where(raw > 0, raw, LEAST_IDF)
        data = index.of_terms(sorted({t for terms in lists for t in terms}))
        if repo and "repo_id" in data.columns:  # partitions of the asked repositories only
            data = data.join(F.broadcast(spark.createDataFrame([(g,) for g in {r[3] for r in rows}], "repo_id string")), "repo_id", "left_semi")
        several = sorted({t for terms in lists if len(terms) > 1 for t in terms})
        data = data.withColumn("positions", F.when(F.col("term").isin(several), F.col("positions"))) if several else data.drop("positions")
        data = _keyed(data)
        if whitelist is not None:
            data = _restricted(data, index, whitelist, kind)
        found = data.mapInArrow(_score(rows, lists, idf, avg, match_all, whitelist is not None, kinds), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("bm25", "chunk_id")))
    if same is not None:
        deepest = ranked.where(F.col("rank") <= limit) if not isinstance(limit, str) else ranked
        ranked = deepest.withColumnRenamed("question_id", "lead").join(same.select("question_id", "lead"), "lead").select("question_id", "chunk_id", "bm25", "rank")
    if isinstance(limit, str):
        return ranked.join(questions.select("question_id", F.col(limit).alias("most")), "question_id").where("rank <= most").drop("most")
    return ranked.where(F.col("rank") <= limit)


def to_lexical(hits: DataFrame) -> DataFrame:
    """BM25 hits with ``score``: 1 for the best of a list and 0 for the worst; 1 if all are equal."""
    w = Window.partitionBy("question_id")
    low, high = F.min("bm25").over(w), F.max("bm25").over(w)
    return hits.withColumn("score", F.when(high <= low, 1.0).otherwise((high - F.col("bm25")) / (high - low)))
