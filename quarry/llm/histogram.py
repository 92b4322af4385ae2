"""Shortest-pack-first packing over the histogram of lengths, without padding.

Documents are tokenized once and cut into pieces of a sequence's capacity and a rest; pieces of one length are alike, so the
packing is worked out on how many there are of each length. Lengths are placed longest first: copies of a length
go to the emptiest packs that take them, many at once, as packs of equal contents are one pattern with a count. What
room the patterns leave is then filled by cutting up the emptiest packs, again by counts; the last tokens
make sequences of powers of two, which need no padding. The work on counts depends on the capacity, not on the number of
documents. Its result, ranges of ranks, is joined back to the pieces by length and rank.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import tokens
from quarry.llm.common import cut, small_batches, texts
from quarry.llm.exchange import fresh_block

#: Tokens of a sequence, id that ends a document, vocabulary.
CAPACITY, END, VOCABULARY = 1024, 0, "byte_bpe_50k.json"
#: Pieces and sequences that are laid out one by one in the end.
FEW = 4096


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """``(lengths, count)``: packs of equal contents. Each length, longest first, goes to the packs with the most room."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []  # negated, each once

    def put(pack: list[int], count: int, room: int) -> None:
        if room not in open_:
            open_[room] = []
            heapq.heappush(rooms, -room)
        open_[room].append((pack, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # the new packs of this length have the most room at first, then those that were there
        while left:
            while rooms and not open_[-rooms[0]]:
                del open_[-heapq.heappop(rooms)]
            if not rooms or -rooms[0] < length:
                put([length], left, capacity - length)
                break
            room = -rooms[0]
            pack, count = open_[room].pop()
            n = min(count, left)
            if count > n:
                open_[room].append((pack, count - n))
            left -= n
            put([*pack, length], n, room - length)
    return [(pack, count) for own in open_.values() for pack, count in own]


#: Each piece of ``length`` with a rank in [low, high) gives ``parts`` parts of ``size`` tokens from ``begin`` on. Part j of the k-th
#: such piece has the number n = first + k * parts + j; it goes to sequence ``sequence + n // each``, at ``offset + n % each * size``.
Rule = tuple[int, int, int, int, int, int, int, int, int, int]
RULE = "length long, low long, high long, begin long, size long, parts long, each long, first long, sequence long, offset long"
#: What is still to be placed of pieces: (length, low, high, begin, size).
Item = tuple[int, int, int, int, int]


def _tokens(items: list[Item]) -> int:
    return sum((high - low) * size for _, low, high, _, size in items)


def _stream(items: list[Item], rooms: list[tuple[int, int]], out: list[Rule]) -> None:
    """Lay the items one after the other into rooms ``(size, sequence)``, cut wherever a room ends."""
    rooms = [(size, sequence, 0) for size, sequence in reversed(rooms)]
    for length, low, high, begin, size in items:
        for rank in range(low, high):
            at = begin
            while at < begin + size:
                room, sequence, offset = rooms.pop()
                n = min(room, begin + size - at)
                out.append((length, rank, rank + 1, at, n, 1, 1, 0, sequence, offset))
                at += n
                if room > n:
                    rooms.append((room - n, sequence, offset + n))


class _Level:
    """One pass over items: whole packs go out as they are, the room of others is filled with parts of the emptiest packs.
    Left are shorter items of far fewer tokens."""

    def __init__(self, items: list[Item], capacity: int, sequence: int, out: list[Rule]):
        self.capacity, self.sequence, self.out = capacity, sequence, out
        self.queues: dict[int, list[Item]] = {}
        for item in items:
            self.queues.setdefault(item[4], []).append(item)
        self.spare: list[Item] = []

    def histogram(self) -> dict[int, int]:
        return {size: sum(high - low for _, low, high, _, _ in own) for size, own in self.queues.items()}

    def take(self, size: int, count: int) -> list[Item]:
        got, queue = [], self.queues[size]
        while count:
            length, low, high, begin, _ = queue.pop()
            n = min(count, high - low)
            got.append((length, low, low + n, begin, size))
            if high - low > n:
                queue.append((length, low + n, high, begin, size))
            count -= n
        return got

    def emit(self, pack: list[int], count: int) -> None:
        """So many packs, as the next sequences."""
        offset = 0
        for size, same in groupby(pack):
            each, first = len(list(same)), 0
            for length, low, high, begin, _ in self.take(size, count * each):
                self.out.append((length, low, high, begin, size, 1, each, first, self.sequence, offset))
                first += high - low
            offset += size * each
        self.sequence += count

    def fill(self, room: int, count: int, sequence: int, offset: int) -> None:
        """Rooms of one size, one in each of the sequences; the spare items are enough."""
        short = [x for x in self.spare if x[4] < room]
        self.spare = [x for x in self.spare if x[4] >= room]
        while count:
            length, low, high, begin, size = self.spare.pop()
            parts = min(size // room, count)
            n = min(count // parts, high - low)
            self.out.append((length, low, low + n, begin, room, parts, 1, 0, sequence, offset))
            if high - low > n:
                self.spare.append((length, low + n, high, begin, size))
            if size > parts * room:
                rest = (length, low, low + n, begin + parts * room, size - parts * room)
                (self.spare if rest[4] >= room else short).append(rest)
            sequence, count = sequence + n * parts, count - n * parts
        self.spare += short

    def run(self) -> list[Item]:
        capacity = self.capacity
        packs = sorted(patterns(self.histogram(), capacity), key=lambda p: (sum(p[0]), p[0]))
        while packs:  # from the fullest on; the emptiest ones give
            pack, count = packs.pop()
            room = capacity - sum(pack)
            if room == 0:
                self.emit(pack, count)
                continue
            # rooms take whole parts of longer items; where there is none, a whole shorter item
            able = sum((high - low) * (size // room) for _, low, high, _, size in self.spare)
            if not able and self.spare:
                item = self.spare.pop(max(range(len(self.spare)), key=lambda k: self.spare[k][4]))
                n = min(count, item[2] - item[1])
                if n < count:
                    packs.append((pack, count - n))
                packs.append(([*pack, item[4]], n))
                self.queues.setdefault(item[4], []).append((item[0], item[1], item[1] + n, *item[3:]))
                if item[2] - item[1] > n:
                    self.spare.append((item[0], item[1] + n, *item[2:]))
                continue
            if n := min(count, able):
                first = self.sequence
                self.emit(pack, n)
                self.fill(room, n, first, capacity - room)
            if count > n:
                packs.append((pack, count - n))
                wanted = sum((capacity - sum(p)) * c for p, c in packs)
                giver, most = packs.pop(0)
                n = min(most, -(-wanted // capacity))
                for size in giver:
                    self.spare += self.take(size, n)
                if most > n:
                    packs.insert(0, (giver, most - n))
        return self.spare


def plan(histogram: dict[int, int], capacity: int) -> list[Rule]:
    """Rules that give every token of every piece one place. What the first pass leaves, some ten thousandths of the tokens, is
    laid out one by one in full sequences and powers of two if it is few pieces, else packed whole."""
    out: list[Rule] = []
    level = _Level([(n, 0, c, 0, n) for n, c in sorted(histogram.items()) if c], capacity, 0, out)
    items = level.run()
    full, rest = divmod(_tokens(items), capacity)
    if sum(x[2] - x[1] for x in items) + full <= FEW:
        sizes = [capacity] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
        _stream(sorted(items, key=lambda x: -x[4]), [(n, level.sequence + k) for k, n in enumerate(sizes)], out)
    else:
        level = _Level(items, capacity, level.sequence, out)
        for pack, count in patterns(level.histogram(), capacity):
            level.emit(pack, count)
    return out


def _pieces(path: str, capacity: int, end: int):
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, met = fresh_block(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[] for _ in range(8)]
                for name, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1).to_pylist(), path), strict=True):
                    ids += last
                    for start in range(0, len(ids), 4 * capacity):
                        piece = ids[start : start + 4 * capacity]
                        n = len(piece) // 4
                        rank = met.get(n, 0)
                        met[n] = rank + 1
                        # whole sequences are never cut
                        for c, v in zip(cols, (name, start // 4, n, zlib.crc32(piece), len(ids) // 4, own, rank, piece if n < capacity else None), strict=True):
                            c.append(v)
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank", "ids"])

    return run


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begin, size, ids = (batch.column(c).to_pylist() for c in ("begin", "size", "ids"))
        crc = [zlib.crc32(x[4 * b : 4 * (b + n)]) for b, n, x in zip(begin, size, ids, strict=True)]
        yield batch.drop_columns(["begin", "size", "ids"]).append_column("ids_crc32", pa.array(crc, pa.int64()))


def pack_by_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces with their places: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    A document is its text's ids and an end id; null and empty texts are the end id alone. Each id lies in one piece. A
    sequence's pieces are gapless from 0; all sequences have ``capacity`` tokens, but for at most one of each
    lower power of two, so none is padded (in large tables some of the last ten thousandths may be). Only what fills the room that whole pieces leave is cut besides
    documents over the capacity. Every row is packed, repeated rows and null ids too; an empty table gives no rows. Other columns
    are not read. Which of equally long pieces goes where depends on the tasks."""
    spark = docs.sparkSession
    path = vocabulary or tokens.vocabulary_path(VOCABULARY)
    found = texts(docs, id_col, text_col).mapInArrow(_pieces(path, capacity, end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long, ids binary")
    pieces = cut(found)
    # ranks within a task's pieces of one length go on from task to task
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    rules = spark.createDataFrame(plan(histogram, capacity), RULE)
    ranked = pieces.drop("ids", "ids_crc32").join(bases, ["length", "task"]).withColumn("place", F.col("rank") + F.col("base"))
    own = F.broadcast(rules.withColumnRenamed("length", "of"))  # some thousand rules at any number of documents
    placed = ranked.join(own, (F.col("length") == F.col("of")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    number = F.col("first") + (F.col("place") - F.col("low")) * F.col("parts") + F.col("part")
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("number", number)
    placed = placed.select("doc_id", "start", "length", "doc_tokens", "task", "rank", (F.col("begin") + F.col("part") * F.col("size")).alias("begin"), "size", F.expr("sequence + number div each").alias("sequence_id"), (F.col("offset") + F.col("number") % F.col("each") * F.col("size")).alias("offset"))
    key = ["task", "length", "rank"]
    whole = placed.where("size = length").join(pieces.select(*key, "ids_crc32"), key)
    some = placed.where("size < length").join(pieces.select(*key, "ids"), key)
    small_batches(spark, 1024)
    some = some.select("doc_id", (F.col("start") + F.col("begin")).alias("start"), F.col("size").alias("length"), "doc_tokens", "sequence_id", "offset", "begin", "size", "ids")
    some = some.mapInArrow(_cut_pieces, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return whole.select(*cols).unionByName(some.select(*cols))
