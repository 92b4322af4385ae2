"""Lexical scan: every chunk is scored against every question's tokens, without an index.

The questions are a stated set and go to the workers in blocks. A chunk's text is passed over once,
however many questions there are: tokens that are words are looked up among its words, others are found
by one automaton. A batch's points are a matrix of chunks and tokens; times the matrix of tokens and
questions it gives all scores at once. A task keeps its best for each question."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

try:
    import ahocorasick
except ImportError:  # it only saves time
    ahocorasick = None

#: Questions sent along with the chunks at once; chunks scored at once.
BLOCK, BATCH = 1024, 256
_WORD = re.compile("[a-z0-9_]+")
_WORD_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def _finder(tokens: list[str]) -> Callable[[str], Iterator[tuple[int, str]]]:
    """A function that gives the last place and the token of every occurrence in a text, also overlapping ones,
    those of one token from left to right."""
    if not tokens:
        return lambda text: iter(())
    if ahocorasick is None:

        def every(text: str) -> Iterator[tuple[int, str]]:
            for t in tokens:
                at = text.find(t)
                while at >= 0:
                    yield at + len(t) - 1, t
                    at = text.find(t, at + 1)

        return every
    automaton = ahocorasick.Automaton()
    for t in tokens:
        automaton.add_word(t, t)
    automaton.make_automaton()
    return automaton.iter


class Counter:
    """Counts of tokens in texts: matches between characters that are no word characters, where each such
    character belongs to one match of a token only."""

    def __init__(self, tokens: list[str]):
        self.place = {t: k for k, t in enumerate(tokens)}
        self.words = {t: k for t, k in self.place.items() if _WORD.fullmatch(t)}
        self.marked = _finder([t for t in tokens if t not in self.words])
        self.any = _finder(tokens)

    def _add(self, counts: dict[int, int], after: dict[int, int], k: int, start: int, end: int) -> None:
        if after.get(k, -1) < start:  # the character before is not the one after the last match
            counts[k] = counts.get(k, 0) + 1
            after[k] = end + 1

    def hits(self, text: str) -> dict[int, int]:
        counts: dict[int, int] = {}
        after: dict[int, int] = {}
        words = self.words
        for m in _WORD.finditer(text):
            k = words.get(m.group())
            if k is not None:
                self._add(counts, after, k, m.start(), m.end())
        self._marks(text, counts, after)
        return counts

    def _marks(self, text: str, counts: dict[int, int], after: dict[int, int]) -> None:
        n = len(text)
        for last, t in self.marked(text):
            start, end = last - len(t) + 1, last + 1
            if (start == 0 or text[start - 1] not in _WORD_CHARS) and (end == n or text[end] not in _WORD_CHARS):
                self._add(counts, after, self.place[t], start, end)

    def contained(self, text: str) -> dict[int, int]:
        """Counts of all tokens that occur anywhere, one at least."""
        counts = self.hits(text)
        return {k: counts.get(k, 1) for k in {self.place[t] for _, t in self.any(text)}}


def _scan(asked: list[tuple], kinds: list[pa.DataType]):
    tokens = list(dict.fromkeys(t for _, own, _, _ in asked for t in own or ()))
    groups = [g for _, _, _, g in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokens)
        holds = np.zeros((len(tokens), len(asked)))
        for q, (_, own, _, _) in enumerate(asked):
            holds[[counter.place[t] for t in own or ()], q] = 1
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                name, path, line, low_path, low_name, content, repo = (c.to_pylist() for c in batch.slice(at, BATCH).columns)
                points = np.zeros((len(name), len(tokens)))
                for r in range(len(name)):
                    for text, worth, find in ((low_path[r], 4.0, counter.contained), (low_name[r], 3.0, counter.contained), (content[r], 0.5, counter.hits)):
                        for k, n in find(text).items():
                            points[r, k] += worth * n
                scores = points @ holds
                for q, (_, _, most, group) in enumerate(asked):
                    own = scores[:, q]
                    rows = np.nonzero(own > 0)[0]
                    if group is not None:
                        rows = np.array([r for r in rows if repo[r] == group], np.int64)
                    if len(rows) > most:  # all that tie with the last stay until the order decides
                        rows = rows[own[rows] >= -np.partition(-own[rows], most - 1)[most - 1]]
                    if len(rows):
                        best[q] = sorted([*best.get(q, []), *((-own[r], path[r], line[r], name[r]) for r in rows)])[:most]
        rows = [(asked[q][0], x[3], float(-x[0]), x[1], x[2]) for q, held in best.items() for x in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*kinds, pa.float64(), pa.string(), pa.int32()], strict=True)], ["question_id", "chunk_id", "score", "file_path", "line"])

    return run if groups else lambda batches: iter(())


def scan(chunks: DataFrame, questions: DataFrame, limit: int | str = 20, repo: bool = False, whitelist: DataFrame | None = None) -> DataFrame:
    """``(question_id, chunk_id, score, rank)`` of chunks that score above 0, best first, ties by path,
    start line (null is 0) and id. 4 a path hit, 3 a name hit, half a content hit; a path or name that
    merely contains a token counts one hit. ``questions`` has ``question_id, tokens``, with ``repo_id`` if
    ``repo``. An empty whitelist finds nothing."""
    data = chunks.where(F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) != "")
    if whitelist is not None:
        data = data.join(whitelist.select(F.col(whitelist.columns[0]).alias("chunk_id")).distinct(), "chunk_id", "left_semi")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    own = F.col("repo_id") if repo else F.lit(None).cast("string")
    data = data.select("chunk_id", F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("start_line", F.lit(0)).cast("int").alias("line"), low("file_path").alias("p"), low("chunk_name").alias("n"), low("content").alias("c"), own.alias("repo"))
    types = [questions.schema["question_id"].dataType, data.schema["chunk_id"].dataType]
    depth = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    asked = questions.select("question_id", "tokens", depth.cast("int").alias("most"), (F.col("repo_id") if repo else F.lit(None).cast("string")).alias("g"))
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    schema = f"question_id {types[0].simpleString()}, chunk_id {types[1].simpleString()}, score double, file_path string, line int"
    for i in range(blocks):
        rows = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i).collect()]
        found = data.mapInArrow(_scan(rows, [to_arrow_type(t) for t in types]), schema)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "file_path", "line", "chunk_id")
    ranked = out.withColumn("rank", F.row_number().over(best))
    if isinstance(limit, str):
        return ranked.join(asked.select("question_id", "most"), "question_id").where("rank <= most").select("question_id", "chunk_id", "score", "rank")
    return ranked.where(F.col("rank") <= limit).select("question_id", "chunk_id", "score", "rank")
