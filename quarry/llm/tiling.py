"""Benchmark decontamination by greedy string tiling.

A document and a test item are candidates if they share a seed, a window of ``least`` tokens.
Seeds of a slice of the benchmark, of bounded size, are joined with all windows of all
documents in one narrow pass; a larger benchmark takes more slices, each against all rows.
Each candidate pair is tiled: the longest matches of unmarked tokens, found by running
Karp-Rabin with a search length that falls to ``least``, are marked first and never overlap, so
passages in another order count in full. The share of the item that is tiled decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keep_rows, texts
from quarry.llm.windows import Words, _power, mixed

#: Tokens of a seed and of the shortest tile; share of an item that must be tiled; bytes of test
#: items that are sent to the workers at once.
LEAST, COVERAGE, SLICE = 5, 0.6, 8 << 20
#: A-Z become a-z, ASCII marks and controls become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


def fold(text: bytes) -> bytes:
    return text.translate(_FOLD)


def _windows(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` tokens."""
    power, inverse, _ = _power(len(ids) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(ids.astype(np.uint64), 3) * power[: len(ids)])])
        return (total[width:] - total[:-width]) * inverse[: len(ids) - width + 1]


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    """Where windows of ``width`` unmarked tokens start."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.nonzero(total[width:] == total[:-width])[0]


def _scan(text: np.ndarray, item: np.ndarray, used: np.ndarray, told: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, place in text, place in item) of at least ``width`` unmarked tokens."""
    if width > min(len(text), len(item)):
        return []
    starts, at = _free(told, width), _free(used, width)
    own, there = _windows(item, width)[starts], _windows(text, width)[at]
    order = np.argsort(there, kind="stable")
    low, high = np.searchsorted(there[order], own), np.searchsorted(there[order], own, "right")
    found = []
    for p, i, j in zip(starts.tolist(), low.tolist(), high.tolist(), strict=True):  # places of an item are few
        ts = at[order[i:j]]
        if p and not told[p - 1]:  # part of a longer match
            before = np.maximum(ts - 1, 0)
            ts = ts[(ts == 0) | (text[before] != item[p - 1]) | used[before]]
        for t in ts.tolist():
            n = min(len(text) - t, len(item) - p)
            stop = np.nonzero((text[t : t + n] != item[p : p + n]) | used[t : t + n] | told[p : p + n])[0]
            n = int(stop[0]) if len(stop) else n
            if n >= width:
                found.append((n, t, p))
    return found


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in item, length) of two token sequences; the longest first, ties in
    order of place; none shorter than ``least``."""
    used, told = np.zeros(len(text), bool), np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    width = max(least, min(len(text), len(item), 64))
    while True:
        found = _scan(text, item, used, told, width)
        if found and (longest := max(found)[0]) > 2 * width:
            width = longest
            continue
        queue = [(-n, t, p) for n, t, p in found]
        heapify(queue)
        while queue:
            n, t, p = heappop(queue)
            clear = ~(used[t : t - n] | told[p : p - n])
            if clear.all():
                used[t : t - n] = True
                told[p : p - n] = True
                tiles.append((t, p, -n))
                continue
            edge = np.diff(np.concatenate([[0], clear.astype(np.int8), [0]]))
            for a, b in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True):
                if b - a >= width:  # what is left of it
                    heappush(queue, (a - b, t + a, p + a))
        if width == least:
            return tiles
        width = max(least, width // 2)


class Seeds:
    """Items of a slice and the hashes of their seeds, one table for each seed length."""

    def __init__(self, items: list[tuple[int, bytes]], least: int):
        self.items = [(i, fold(t).split()) for i, t in items]
        self.least = least
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        widths = defaultdict(list)
        for k, (_, tokens) in enumerate(self.items):
            if tokens:
                widths[min(least, len(tokens))].append(k)
        for width, own in sorted(widths.items()):
            words = Words([b" ".join(self.items[k][1]) for k in own], width)
            h = words.hashes()
            item = np.array(own)[np.searchsorted(words.first, words.at, "right") - 1]
            order = np.lexsort((item, h))
            maybe = np.zeros(1 << 20, bool)
            maybe[(mixed(h, 5) >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((width, h[order], item[order], maybe))

    def candidates(self, docs: list[bytes]) -> set[tuple[int, int]]:
        """(document, item) numbers of pairs with a common seed."""
        out: set[tuple[int, int]] = set()
        for width, known, item, maybe in self.tables:
            words = Words(docs, width)
            h = words.hashes()
            at = np.nonzero(maybe[(mixed(h, 5) >> np.uint64(44)).astype(np.int64)])[0]
            low, high = np.searchsorted(known, h[at]), np.searchsorted(known, h[at], "right")
            doc = np.searchsorted(words.first, words.at[at], "right") - 1
            for d, i, j in np.unique(np.stack([doc, low, high], 1)[high > low], axis=0).tolist():
                out.update((d, int(x)) for x in item[i:j])
        return out


    def tiled(self, docs: list[bytes], coverage: float) -> Iterator[tuple[int, int | None, int, int, list[tuple[int, int, int]]]]:
        """(document, item id, item's tokens, tiled tokens, tiles) of pairs with enough tiled."""
        docs = [fold(x) for x in docs]
        split: dict[int, list[bytes]] = {}
        for d, k in sorted(self.candidates(docs)):
            if d not in split:
                split[d] = docs[d].split()
            item_id, item = self.items[k]
            ids = {w: x for x, w in enumerate(dict.fromkeys(item))}
            text = np.array([ids.get(w, len(ids)) for w in split[d]])
            tiles = tile(text, np.array([ids[w] for w in item]), min(self.least, len(item)))
            n = sum(x for _, _, x in tiles)
            if n >= coverage * len(item):
                yield d, item_id, len(item), n, sorted(tiles)


def _find(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names = part.column(0).to_pylist()
                found = seeds.tiled(part.column(1).to_pylist(), coverage)
                rows = [{"doc_id": names[d], "item_id": i, "n_tokens": m, "n_tiled": n, "coverage": n / m, "tiles": [{"at": t, "item_at": p, "length": x} for t, p, x in tiles]} for d, i, m, n, tiles in found]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _OUT)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tokens", pa.int64()), ("n_tiled", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("at", pa.int64()), ("item_at", pa.int64()), ("length", pa.int64())])))])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE, slice_bytes: int = SLICE) -> DataFrame:
    """``(doc_id, item_id, n_tokens, n_tiled, coverage, tiles array<struct<at, item_at, length>>)`` of every
    pair of a document and a test item of which ``coverage`` or more of the item's tokens are tiled.

    Tokens are words after A-Z are lowered and ASCII marks are spaces. An item of fewer than
    ``least`` tokens must occur as a whole. Items without tokens, null and empty texts give no
    pairs; repeated rows give a pair each; ids may be null. An empty table gives no rows. Other
    columns are not read."""
    data, out = texts(docs, id_col, text_col), None
    for seeds in _slices(benchmark, item_col, item_text_col, least, slice_bytes):
        found = data.mapInArrow(_find(seeds, coverage), "doc_id long, item_id long, n_tokens long, n_tiled long, coverage double, tiles array<struct<at: long, item_at: long, length: long>>")
        out = found if out is None else out.unionByName(found)
    return out


def _slices(benchmark: DataFrame, item_col: str, item_text_col: str, least: int, slice_bytes: int) -> Iterator:
    """The benchmark's items in broadcast slices of about ``slice_bytes``, however many there are: the driver builds one
    at a time."""
    items = texts(benchmark, item_col, item_text_col)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-int(total) // slice_bytes))
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast(Seeds([(r[0], bytes(r[1])) for r in part.collect()], least))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE, slice_bytes: int = SLICE) -> DataFrame:
    """The rows, with all their columns, that hold no test item to ``coverage`` or more. Texts are judged
    as by :func:`contaminated`; null and empty ones stay."""
    for seeds in _slices(benchmark, item_col, item_text_col, least, slice_bytes):

        def judge(shared=seeds):
            seeds = shared.value

            def keeps(texts: list[bytes | None]) -> list[bool]:
                hit = {d for d, *_ in seeds.tiled([t or b"" for t in texts], coverage)}
                return [k not in hit for k in range(len(texts))]

            return keeps

        docs = keep_rows(docs, text_col, judge)
    return docs
