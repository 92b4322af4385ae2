"""Substring dedup on word windows with a count-min prefilter.

Pass one sketches: each block folds its windows into the rows of a count-min sketch and sends
the cells it touched; merged, a cell that two windows touched counts them both, so the
sketch can only overestimate. The smallest count over the rows is the estimate. Pass two
groups exactly, by a 128-bit digest of the window's bytes, only windows whose estimate is at
least two; a window that repeats is always among them, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import exchange as X
from quarry.llm.common import cut, drop_cut, settle, texts

#: Rows of the sketch; cells of a row for each window, at least; keys that a bucket judges at once.
DEPTH, CELLS, BUCKET_KEYS = 2, 8, 1 << 20

#: Stands for a null id: after all others.
LAST = (1 << 63) - 1

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base, of its inverse, and a random value for each byte, modulo 2**64."""
    if len(_powers.get("p", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            for name, b in (("p", base), ("i", pow(base, -1, 1 << 64))):
                out = np.ones(size, np.uint64)
                k = 1
                step = np.uint64(b)
                while k < size:
                    out[k : 2 * k] = out[:k] * step
                    step, k = step * step, 2 * k
                _powers[name] = out
        _powers["v"] = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
    return _powers["p"][:n], _powers["i"][:n], _powers["v"]


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Finish hashes so that all their bits are of use."""
    with np.errstate(over="ignore"):
        h = h ^ np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return h ^ (h >> np.uint64(32))


class Words:
    """The words of a block's documents: one buffer, each word followed by one separator."""

    def __init__(self, docs: list[bytes], width: int):
        joined = [b" ".join(x.split()) for x in docs]
        self.joined = joined
        self.buffer = b"".join(x + b"\n" for x in joined if x)
        raw = np.frombuffer(self.buffer, np.uint8)
        # inside a document the only bytes 32 and 10 are its separators: words have none of both
        self.ends = np.nonzero((raw == 32) | (raw == 10))[0]
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64) if len(self.ends) else self.ends
        last = np.nonzero(raw[self.ends] == 10)[0] if len(self.ends) else self.ends
        counts = np.diff(last, prepend=-1)
        self.counts = np.zeros(len(docs), np.int64)
        self.counts[[k for k, x in enumerate(joined) if x]] = counts
        self.first = np.concatenate([[0], np.cumsum(self.counts)])  # of each document's words
        n = len(self.ends)
        doc = np.repeat(np.arange(len(docs)), self.counts)
        self.at = np.nonzero(doc[: n - width + 1] == doc[width - 1 :])[0] if n >= width else np.zeros(0, np.int64)
        self.width = width
        self.raw = raw

    def hashes(self) -> np.ndarray:
        """A 64-bit rolling hash of the bytes of each window."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        p, inv, value = _power(len(self.raw) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum(value[self.raw] * p[:-1], out=total[1:])
            s, e = self.starts[self.at], self.ends[self.at + self.width - 1]
            return (total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64)

    def digests(self, which: np.ndarray) -> list[bytes]:
        """XXH3's 128 bits of the windows' words, joined by one space."""
        s, e = self.starts[self.at[which]], self.ends[self.at[which] + self.width - 1]
        h, buffer = xxhash.xxh3_128_digest, self.buffer
        return [h(buffer[i:j]) for i, j in zip(s.tolist(), e.tolist(), strict=True)]

    def covered(self, which: np.ndarray) -> np.ndarray:
        """The words that the chosen windows cover."""
        edge = np.zeros(len(self.ends) + 1, np.int64)
        np.add.at(edge, self.at[which], 1)
        np.add.at(edge, self.at[which] + self.width, -1)
        return np.cumsum(edge[:-1]) > 0


def _cells(words: Words, width: int, depth: int) -> list[np.ndarray]:
    h = words.hashes()
    return [mixed(h, row + 1) % np.uint64(width) for row in range(depth)]


def _sketch(window: int, width: int, depth: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, docs in X.blocks_of(batches):
            block = X.fresh_block()
            head, data = X.body(ids, docs)
            out = [(0, block, -1, len(docs), data, head)]
            for row, cells in enumerate(_cells(Words(docs, window), width, depth)):
                if not len(cells):
                    continue
                cells.sort()
                new = np.concatenate([[True], cells[1:] != cells[:-1]])
                keys = cells[new]
                more = np.diff(np.append(np.nonzero(new)[0], len(cells))) > 1
                per = np.uint64(-(-width // buckets))
                cuts = np.searchsorted(keys // per, np.arange(buckets + 1, dtype=np.uint64))
                out += [(1, block, row * buckets + k, int(j - i), X.pack(keys[i:j]), X.pack_bits(more[i:j])) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
            yield X.rows(out)

    return run


def _bits(answers: list[dict]) -> np.ndarray:
    return np.concatenate([X.unpack_bits(r["data"], r["n"]) for r in answers]) if answers else np.zeros(0, bool)


def _estimated(words: Words, answers: list[dict], width: int, depth: int, buckets: int) -> np.ndarray:
    """The windows whose estimate is two or more: the smallest count over the rows."""
    ok = np.ones(len(words.at), bool)
    for row, cells in enumerate(_cells(words, width, depth)):
        keys = np.unique(cells)
        hit = _bits([r for r in answers if r["bucket"] // buckets == row])
        ok &= hit[np.searchsorted(keys, cells)]
    return np.nonzero(ok)[0]


def _digest_keys(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digests (as pairs of longs, sorted), where each window's is, how often each occurs."""
    raw = np.frombuffer(b"".join(words.digests(which)), ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((raw[:, 1], raw[:, 0]))
    seen = raw[order]
    new = np.concatenate([[True], (seen[1:] != seen[:-1]).any(axis=1)])
    where = np.empty(len(raw), np.int64)
    where[order] = np.cumsum(new) - 1
    return seen[new], where, np.diff(np.append(np.nonzero(new)[0], len(raw)))


def _ids(head: pa.RecordBatch) -> np.ndarray:
    return np.array([LAST if x is None else x for x in head.column("doc_id").to_pylist()], np.int64)


def _home(words: Words, which: np.ndarray) -> np.ndarray:
    """The documents of the windows, by number."""
    return np.searchsorted(words.first, words.at[which], "right") - 1


def _exact(window: int, width: int, depth: int, buckets: int, exact_buckets: int, first: bool):
    def work(answers: list[dict], body: dict) -> Iterator[pa.RecordBatch]:
        head, docs = X.unbody(body["more"], body["data"])
        words = Words(docs, window)
        which = _estimated(words, answers, width, depth, buckets)
        if not len(which):
            return
        keys, where, count = _digest_keys(words, which)
        bucket = keys[:, 0] // np.uint64(-(-(1 << 64) // exact_buckets)) if exact_buckets > 1 else np.zeros(len(keys), np.uint64)
        cuts = np.searchsorted(bucket, np.arange(exact_buckets + 1, dtype=np.uint64))
        least = np.full(len(keys) if first else 0, LAST)
        if first:
            np.minimum.at(least, where, _ids(head)[_home(words, which)])
        asks = [(1, body["block"], k, int(j - i), keys[i:j].tobytes() + least[i:j].tobytes(), X.pack_bits(count[i:j] > 1)) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        spots = np.diff(which, prepend=0).astype(np.int32).tobytes() + where.astype(np.int32).tobytes()
        yield X.rows([*asks, (2, body["block"], exact_buckets, len(which), X.squeeze(spots), b"")])

    return work


def judge_exact(group: list[dict]) -> list[tuple]:
    """Which digests of each ask occur more than once in all; of those the smallest id, if the asks name ids."""
    keys = np.concatenate([np.frombuffer(r["data"], np.uint64, 2 * r["n"]).reshape(-1, 2) for r in group])
    least = np.concatenate([np.frombuffer(r["data"], np.int64, offset=16 * r["n"]) for r in group])
    own = np.concatenate([X.unpack_bits(r["more"], r["n"]) for r in group])
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    seen = keys[order]
    same = (seen[1:] == seen[:-1]).all(axis=1)
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again |= own
    if len(least):
        start = np.nonzero(np.concatenate([[True], ~same]))[0]
        low = np.minimum.reduceat(least[order], start)
        least = np.empty_like(least)
        least[order] = np.repeat(low, np.diff(np.append(start, len(order))))
    cuts = np.cumsum([0, *(r["n"] for r in group)])
    return [(1, r["block"], r["bucket"], r["n"], X.pack_bits(again[i:j]), X.squeeze(least[i:j][again[i:j]].tobytes()) if len(least) else b"") for r, i, j in zip(group, cuts[:-1], cuts[1:], strict=True)]


def _spared(words: Words, which: np.ndarray, where: np.ndarray, hit: np.ndarray, least: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the windows are the first of their kind: in the document of the smallest id, at its first place."""
    low = np.full(len(hit), LAST)
    low[hit] = least
    mine = np.nonzero(hit[where] & (low[where] == ids[_home(words, which)]))[0]
    _, first = np.unique(where[mine], return_index=True)
    out = np.zeros(len(which), bool)
    out[mine[first]] = True
    return out


def _remove(window: int, verbatim: bool, first: bool):
    def work(answers: list[dict], body: dict) -> Iterator[pa.RecordBatch]:
        ids, docs = X.unbody(body["more"], body["data"])
        words = Words(docs, window)
        gone = np.zeros(len(words.ends), bool)
        if spots := [r for r in answers if r["kind"] == 2]:
            raw = np.frombuffer(X.unsqueeze(spots[0]["data"]), np.int32)
            which, where = np.cumsum(raw[: len(raw) // 2], dtype=np.int64), raw[len(raw) // 2 :]
            told = [r for r in answers if r["kind"] == 1]
            hit = _bits(told)
            again = hit[where]
            if first:
                least = np.concatenate([np.frombuffer(X.unsqueeze(r["more"]), np.int64) for r in told])
                spared = _spared(words, which, where, hit, least, _ids(ids))
                gone = words.covered(which[again & ~spared]) & ~words.covered(which[spared])
            else:
                gone = words.covered(which[again])
        texts, spans, removed = [], [], []
        for k, joined in enumerate(words.joined):
            i, j = words.first[k], words.first[k + 1]
            mask = gone[i:j]
            removed.append(int(mask.sum()))
            if not removed[-1]:
                texts.append(docs[k] if verbatim else joined)
                spans.append([])
                continue
            edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
            a, b = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
            spans.append([{"first": int(x), "after": int(y)} for x, y in zip(a, b, strict=True)])
            kept = zip(np.concatenate([[0], b]).tolist(), np.concatenate([a, [j - i]]).tolist(), strict=True)
            texts.append(b" ".join(words.buffer[words.starts[i + x] : words.ends[i + y - 1]] for x, y in kept if y > x))
        yield pa.RecordBatch.from_arrays(
            [*ids.columns, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))],
            [*ids.schema.names, "kept", "n_words", "n_removed", "removed"],
        )

    return work


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, depth: int = DEPTH, cells: int = CELLS, carry: list[str] | None = None, verbatim: bool = False, keep_first: bool = False) -> DataFrame:
    """Remove each word that a repeated window of ``window`` words covers.

    Returns ``(doc_id, kept string, n_words, n_removed, removed array<struct<first, after>>)``, a row
    per input row: the words left, joined by one space, and the removed runs of words. Words are
    runs of bytes other than 9 to 13 and 32, unchanged. A window repeats if its word sequence
    starts anywhere else, in the same document or another; windows are judged on the input.
    Null and empty texts have no words; repeated rows (also of one id) repeat each other's
    windows; null ids are kept as they are. Other columns are not read; those in ``carry`` come
    along in a struct ``row``. With ``keep_first`` the first of equal windows stays, with all its words: that of
    the smallest id, null ids last, and there of the first place; rows of one id in different blocks may each
    keep theirs. With ``verbatim`` a text that loses no word is given as it was,
    white space and all."""
    spark = docs.sparkSession
    data = texts(docs, id_col, text_col, carry)
    total = int(data.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    windows = max(1, total // 6)  # about; only sizes depend on it
    width = cells * max(windows, 1 << 16)
    buckets = X.n_buckets(windows, BUCKET_KEYS)
    row = f"row {data.schema['row'].dataType.simpleString()}, " if carry else ""
    first = data.mapInArrow(_sketch(window, width, depth, buckets), X.ROWS)
    kinds = X.stored(first)
    bodies, asks = kinds(0), kinds(1)
    estimates = cut(X.answered(asks, X.judge_repeats))
    drop_cut(asks)
    settle(spark)
    found = cut(X.per_block(bodies, estimates, _exact(window, width, depth, buckets, buckets, keep_first), X.ROWS))
    drop_cut(estimates)
    settle(spark)
    marks = cut(X.answered(found.where("kind = 1"), judge_exact))
    settle(spark)
    answers = marks.unionByName(found.where("kind = 2"))
    return X.per_block(bodies, answers, _remove(window, verbatim, keep_first), f"doc_id long, {row}kept string, n_words long, n_removed long, removed array<struct<first: long, after: long>>")



#: DuckDB's version of the query: 35-word windows as text.
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word, len(ws) AS n FROM w),
h AS (SELECT doc_id, i, word, CASE WHEN i + 34 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS h FROM u),
r AS (SELECT doc_id, i, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM h),
c AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS m, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(m, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
