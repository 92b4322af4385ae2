"""Best-fit packing of documents into token sequences, improved by swap-based local search.

Documents are tokenized and cut into pieces in one narrow pass. Pieces are dealt by hash into
shards of bounded size; each shard is packed best-fit decreasing and then searched: pieces
move between underfull bins, or are exchanged one for one or two for one, whenever the sum of
squared fills grows, until bins run empty or nothing helps. Only pieces of bins that are still
underfull go on to the next round, into fewer shards, where they meet those of other shards.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import tokens
from quarry.llm.common import cut, texts

#: Tokens of a sequence, id that ends a document, pieces of a shard, vocabulary.
CAPACITY, END, SHARD, VOCABULARY = 2048, 0, 4096, "word_bpe_49k.json"
#: The search ends with a round after which the underfull bins are fewer by less than this share.
GAIN = 0.005


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes to the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s is set if a bin with s free tokens exists
    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        need = lengths[item]
        fitting = spaces >> need
        if fitting:
            space = need + (fitting & -fitting).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            at, space = len(bins), capacity
            bins.append([])
        bins[at].append(item)
        if left := space - need:
            by_space[left].append(at)
            spaces |= 1 << left
    return bins


class Search:
    """Local search over underfull bins. Every step raises the sum of squared fills, a bounded whole
    number, so it ends."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = {k: list(b) for k, b in enumerate(bins)}
        self.fill = {k: sum(lengths[i] for i in b) for k, b in self.bins.items()}
        self.holders: dict[int, list[tuple[int, int]]] = {}  # length -> (fill, bin) of underfull bins, sorted
        self.sizes = 0  # bit n is set if an underfull bin holds a piece of n tokens
        for k in self.bins:
            self._add(k)

    def _add(self, k: int) -> None:
        if 0 < self.fill[k] < self.capacity:
            for n in {self.lengths[i] for i in self.bins[k]}:
                insort(self.holders.setdefault(n, []), (self.fill[k], k))
                self.sizes |= 1 << n

    def _drop(self, k: int) -> None:
        if 0 < self.fill[k] < self.capacity:
            for n in {self.lengths[i] for i in self.bins[k]}:
                at = self.holders[n]
                at.remove((self.fill[k], k))
                if not at:
                    del self.holders[n]
                    self.sizes &= ~(1 << n)

    def _giver(self, n: int, taker: int, back: int) -> int | None:
        """The emptiest underfull bin with a piece of n tokens such that giving it and getting ``back``
        tokens for it raises the squares."""
        for fill, k in self.holders.get(n, ()):
            if k != taker:
                return k if self.fill[taker] + n - back > fill else None
        return None

    def _offers(self, k: int) -> dict[int, tuple[int, ...]]:
        """What bin k can give in exchange: nothing (a move), one piece, or two."""
        own = self.bins[k]
        out: dict[int, tuple[int, ...]] = {0: ()}
        by_length: dict[int, list[int]] = {}
        for i in own:
            by_length.setdefault(self.lengths[i], []).append(i)
        for n, items in by_length.items():
            out.setdefault(n, (items[0],))
        several = list(by_length.items())  # different lengths in one bin are few: they add up to no more than it
        for x, (n, items) in enumerate(several):
            if len(items) > 1:
                out.setdefault(2 * n, (items[0], items[1]))
            for m, others in several[x + 1 :]:
                out.setdefault(n + m, (items[0], others[0]))
        return out

    def step(self, k: int) -> bool:
        """The exchange that fills bin k most, if any does."""
        space = self.capacity - self.fill[k]
        best: tuple[int, int, int, tuple[int, ...]] | None = None
        for back, items in self._offers(k).items():
            window = self.sizes & (1 << back + space + 1) - 1
            while window:
                n = window.bit_length() - 1
                gain = n - back
                if gain <= 0 or best and gain <= best[0]:
                    break
                if (giver := self._giver(n, k, back)) is not None:
                    best = gain, n, giver, items
                    break
                window &= ~(1 << n)
            if best and best[0] == space:
                break
        if best is None:
            return False
        _, n, giver, items = best
        self._drop(k)
        self._drop(giver)
        got = next(i for i in self.bins[giver] if self.lengths[i] == n)
        self.bins[giver].remove(got)
        self.bins[k].append(got)
        for i in items:
            self.bins[k].remove(i)
            self.bins[giver].append(i)
        change = n - sum(self.lengths[i] for i in items)
        self.fill[k] += change
        self.fill[giver] -= change
        self._add(k)
        self._add(giver)
        return True

    def run(self) -> list[list[int]]:
        moved = True
        while moved:
            moved = False
            order = sorted((k for k, f in self.fill.items() if 0 < f < self.capacity), key=lambda k: (-self.fill[k], k))
            for k in order:
                while 0 < self.fill[k] < self.capacity and self.step(k):
                    moved = True
        return [b for k, b in self.bins.items() if b]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers, none over capacity. Items of no more than the capacity are required."""
    return Search(best_fit(lengths, capacity), lengths, capacity).run()


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[], [], [], [], [], []]
                for name, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1).to_pylist(), path), strict=True):
                    ids += last
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[start : start + 4 * capacity]
                        for c, v in zip(cols, (name, k, start // 4, len(piece) // 4, zlib.crc32(piece), piece), strict=True):
                            c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece int, start, length, ids_crc32[, ids binary])``: each document's ids and an end
    id, cut into pieces of ``capacity`` tokens if it is longer; the last may be shorter. Null and
    empty texts are the end id alone. ``ids`` are little-endian unsigned 32-bit values."""
    path = vocabulary or tokens.vocabulary_path(VOCABULARY)
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return texts(docs, id_col, text_col).mapInArrow(_pieces(path, capacity, end, with_ids), out)


def _pack_shard(capacity: int, turn: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = part.column("length").to_pylist()
        shard = part.column("shard")[0].as_py()
        sequence, offset, short = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
        for k, items in enumerate(pack(lengths, capacity)):
            items.sort()
            at = 0
            for i in items:
                sequence[i], offset[i] = turn << 52 | shard << 24 | k, at
                at += lengths[i]
            for i in items:
                short[i] = at < capacity
        keep = part.drop_columns(["shard", "sequence_id", "offset", "short"])
        return keep.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).append_column("short", pa.array(short, pa.bool_()))

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """Pieces with their places: ``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)``.

    A sequence's pieces are gapless from offset 0 and of at most ``capacity`` tokens in all.
    Every row is packed, repeated rows and null ids too; an empty table gives no rows. Other
    columns are not read. With ``with_ids`` the pieces carry their ids, so that joining them by
    sequence and offset gives the training rows."""
    now = cut(pieces(docs, id_col, text_col, vocabulary, capacity, end, with_ids).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "short": F.lit(True)}))
    cols = [c for c in now.columns if c != "short"]
    n, turn, done, before = now.count(), 0, [], None
    schema = ", ".join(f"{c} {t}" for c, t in now.dtypes)
    while n:
        shards = -(-n // shard)
        key = F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(shards))
        packed = cut(now.withColumn("shard", key).groupBy("shard").applyInArrow(_pack_shard(capacity, turn), schema))
        left, bins = packed.where("short").agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if shards == 1 or before is not None and bins > (1 - GAIN) * before:
            done.append(packed)
            break
        done.append(packed.where("not short"))
        now, n, turn, before = packed.where("short"), left, turn + 1, bins
    if not done:
        return now.select(*cols)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*cols)
