"""Exact substring dedup with suffix arrays built by linear grouping.

Every window of ``length`` bytes has a key: the smallest hash of the shorter grams inside it. Equal
windows have equal keys, and neighbouring windows mostly share theirs, so a document falls
into segments, runs of windows with one key. Keys that occur once are dropped after a count in
folded cells (a fold only overestimates). Segments of a key meet: if all of them are the same
bytes, the smallest document id among them answers for all their windows; where different
segments meet, the suffix array of all of them is built, equal windows stand together in it,
and the smallest id of each run of equal windows answers. A key with more different segments
than a task should hold is taken apart into single windows, keyed by their own hash.

Suffix arrays are built in linear time by grouping: suffixes start in groups of their first
byte; groups are processed in descending order, and the pointers from their members to the
previous suffix of a smaller group tell which suffixes these extend, so that in the end each
group shares a Lyndon prefix; a last pass, ascending, follows the same pointers and writes out
each group's order. Nothing is renamed and nothing recurs.
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
from quarry.llm.exchange import stored
from quarry.llm.windows import LAST, _bits, _ids, _power, mixed

#: Bytes of a window and of a gram; cells for each segment; bytes of text to a bucket; different
#: segments of one key that are sorted together.
LENGTH, GRAM, CELLS, BUCKET_BYTES, MOST = 50, 20, 64, 8 << 20, 4096

def suffix_array(s: list[int]) -> list[int]:
    """The suffixes of ``s`` in order, in time linear in its length. ``s`` ends with a value smaller than all others."""
    n = len(s)
    slot, place = [0] * n, [0] * n  # the suffix of each slot, the slot of each suffix
    group = [0] * n  # of each suffix: the first slot of its group
    size = [0] * (n + 1)  # of the group that starts at a slot
    by_first: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by_first.setdefault(c, []).append(i)
    starts_at_end = [0] * (n + 1)  # end slot of a group -> its first slot
    at = 0
    for c in sorted(by_first):
        own = by_first[c]
        for k, i in enumerate(own, at):
            slot[k], place[i], group[i] = i, k, at
        size[at] = len(own)
        starts_at_end[at + len(own)] = at
        at += len(own)
    prev = [-1] * n
    end = n
    while end > 0:
        g = starts_at_end[end]
        members = slot[g:end]
        for i in members:  # to the left over all that is processed
            j = i - 1
            while j >= 0 and group[j] > g:
                j = prev[j]
            prev[i] = j
        for i in members:  # and over members of this group, whose own pointers then lead out of it
            j = prev[i]
            if j >= 0 and group[j] == g:
                path = [i]
                while j >= 0 and group[j] == g:
                    path.append(j)
                    j = prev[j]
                for k in path:
                    prev[k] = j
        times: dict[int, int] = {}
        for i in members:
            if (j := prev[i]) >= 0:
                times[j] = times.get(j, 0) + 1
        alike: dict[int, list[int]] = {}
        for j, k in times.items():
            alike.setdefault(k, []).append(j)
        touched = {group[j] for j in times}
        for k in sorted(alike, reverse=True):  # more repeats of this group's prefix are greater
            own = alike[k]
            for j in own:  # to the end of its group, by a swap
                o = group[j]
                size[o] -= 1
                last = o + size[o]
                other = slot[last]
                slot[place[j]], place[other] = other, place[j]
                slot[last], place[j] = j, last
            for j, new in zip(own, [group[j] + size[group[j]] for j in own], strict=True):
                group[j] = new
                size[new] += 1
            for j in own:
                starts_at_end[group[j] + size[group[j]]] = group[j]
        for o in touched:  # what stays of a group
            if size[o]:
                starts_at_end[o + size[o]] = o
        end = g
    order = [0] * n
    free = list(range(n))  # next slot of the group that starts there
    placed = [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    for r in range(n):
        j = order[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = prev[j]
    return order


def least_ids(segments: list[bytes], ids: list[int], length: int) -> list[np.ndarray]:
    """For each segment and each of its windows the smallest id of a segment that holds the window."""
    s: list[int] = []
    valid: list[int] = []
    home: list[int] = []
    for k, seg in enumerate(segments):
        n = len(seg) - length + 1
        valid += range(1, n + 1)
        valid += [0] * (len(seg) - n + 1)
        home += [k] * (len(seg) + 1)
        s += [b + 2 for b in seg]
        s.append(1)
    s.append(0)
    text = b"".join(x + b"\0" for x in segments)  # as long as s without its last
    out = [np.zeros(max(0, len(x) - length + 1), np.int64) for x in segments]
    run: list[int] = []
    before = b""

    def close() -> None:
        low = min(ids[home[i]] for i in run)
        for i in run:
            out[home[i]][valid[i] - 1] = low

    for i in suffix_array(s):
        if i < len(valid) and valid[i]:
            window = text[i : i + length]
            if run and window != before:
                close()
                run = []
            run.append(i)
            before = window
    if run:
        close()
    return out


class Segments:
    """The segments of a block's documents: key, document number, first and last byte + 1. Keys are
    minima, so they are mixed again lest they crowd the low buckets."""

    def __init__(self, docs: list[bytes], length: int, gram: int):
        raw = np.frombuffer(b"".join(docs), np.uint8)
        lens = np.fromiter(map(len, docs), np.int64, len(docs))
        self.begin = np.concatenate([[0], np.cumsum(lens)])
        n = len(raw)
        empty = np.zeros(0, np.int64)
        self.key, self.doc, self.first, self.after = np.zeros(0, np.uint64), empty, empty, empty
        self.raw = raw
        if n < length:
            return
        h = gram_hashes(raw, gram)
        low, reach, span = h, 1, length - gram + 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if span > reach:
            low = np.minimum(low[: n - length + 1], low[span - reach : span - reach + n - length + 1])
        doc = np.repeat(np.arange(len(docs)), lens)
        whole = doc[: n - length + 1] == doc[length - 1 :]  # windows that stay within a document
        new = np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1 : n - length + 1] != doc[: n - length]) | (whole[1:] != whole[:-1])])
        starts = np.nonzero(new & whole)[0]
        runs = np.append(np.nonzero(new)[0], n - length + 1)
        ends = runs[np.searchsorted(runs, starts, "right")]
        self.key, self.doc, self.first, self.after = mixed(low[starts], 13), doc[starts], starts, ends - 1 + length


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` bytes."""
    p, inv, value = _power(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value[raw] * p[:-1], out=total[1:])
        return mixed((total[gram:] - total[:-gram]) * inv[: len(raw) - gram + 1], 11)


def _split(bucket: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    return [(k, int(i), int(j)) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Range of the (sorted) keys."""
    return keys // np.uint64(-(-(1 << 64) // buckets)) if buckets > 1 else np.zeros(len(keys), np.uint64)


def _ask_cells(length: int, gram: int, width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, docs in X.blocks_of(batches):
            block = X.fresh_block()
            head, data = X.body(ids, docs)
            out = [(0, block, -1, len(docs), data, head)]
            cells, count = np.unique(Segments(docs, length, gram).key % np.uint64(width), return_counts=True)
            per = np.uint64(-(-width // buckets))
            out += [(1, block, k, j - i, X.pack(cells[i:j]), X.pack_bits(count[i:j] > 1)) for k, i, j in _split(cells // per, buckets)]
            yield X.rows(out)

    return run


#: A segment's digest, as two longs.
def _digests(raw: bytes, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    h = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([h(raw[i:j]) for i, j in zip(first.tolist(), after.tolist(), strict=True)]), ">u8").astype(np.uint64).reshape(-1, 2)


def _distinct(key: np.ndarray, digest: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the distinct (key, digest), each with its smallest id first, and where each went."""
    order = np.lexsort((doc_id, digest[:, 1], digest[:, 0], key))
    k, d = key[order], digest[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]).any(axis=1)])
    where = np.empty(len(key), np.int64)
    where[order] = np.cumsum(new) - 1
    return order[new], where


def _meet(block: int, key, digest, doc_id, doc, first, after, buckets: int, kind: int) -> list[tuple]:
    """A block's segments as asks (key, digest, smallest id) and where each is (``kind`` + 1)."""
    pick, where = _distinct(key, digest, doc_id)
    keys = key[pick]
    asks = [(kind, block, k, j - i, X.squeeze(keys[i:j].tobytes() + digest[pick[i:j]].tobytes() + doc_id[pick[i:j]].tobytes()), b"") for k, i, j in _split(_bucket(keys, buckets), buckets)]
    spots = np.stack([np.diff(doc, prepend=0), np.diff(first, prepend=0), after - first, where]).astype(np.int32)
    return [*asks, (kind + 1, block, -2, len(key), X.squeeze(spots.tobytes()), b"")]


def _met(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, n = X.unsqueeze(row["data"]), row["n"]
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint64, 2 * n, 8 * n).reshape(-1, 2), np.frombuffer(raw, np.int64, n, 24 * n)


def _segments(length: int, gram: int, width: int, buckets: int):
    def work(answers: list[dict], body: dict) -> Iterator[pa.RecordBatch]:
        head, docs = X.unbody(body["more"], body["data"])
        s = Segments(docs, length, gram)
        cells = s.key % np.uint64(width)
        hit = _bits(answers)[np.searchsorted(np.unique(cells), cells)] if len(cells) else np.zeros(0, bool)
        key, doc, first, after = s.key[hit], s.doc[hit], s.first[hit], s.after[hit]
        if not len(key):
            return
        raw = s.raw.tobytes()
        yield X.rows(_meet(body["block"], key, _digests(raw, first, after), _ids(head)[doc], doc, first, after, buckets, 1))

    return work


def judge_segments(group: list[dict]) -> list[tuple]:
    """For each ask the smallest id of equal segments, and whether its key has different segments (1) or
    more of them than are sorted together (2)."""
    met = [_met(r) for r in group]
    key, digest, doc_id = (np.concatenate(x) for x in zip(*met, strict=True))
    order = np.lexsort((doc_id, digest[:, 1], digest[:, 0], key))
    k, d = key[order], digest[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key | np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1)])
    low = doc_id[order][new][np.cumsum(new) - 1]
    of_key = np.cumsum(new_key) - 1
    different = np.bincount(of_key[new])[of_key]
    least, state = np.empty(len(key), np.int64), np.empty(len(key), np.int8)
    least[order], state[order] = low, np.where(different > MOST, 2, different > 1)
    cuts = np.cumsum([0, *(r["n"] for r in group)])
    return [(r["kind"], r["block"], r["bucket"], r["n"], X.squeeze(least[i:j].tobytes()), X.squeeze(state[i:j].tobytes())) for r, i, j in zip(group, cuts[:-1], cuts[1:], strict=True)]


def _answers(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest ids and states of a block's distinct segments, in order."""
    least = [np.frombuffer(X.unsqueeze(r["data"]), np.int64) for r in rows]
    state = [np.frombuffer(X.unsqueeze(r["more"]), np.int8) for r in rows]
    return (np.concatenate(least), np.concatenate(state)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int8))


def _join(raw: bytes, first: np.ndarray, after: np.ndarray) -> bytes:
    return b"".join([raw[a:b] for a, b in zip(first.tolist(), after.tolist(), strict=True)])


def _runs(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _different(length: int, gram: int, buckets: int):
    """Of segments whose keys have others: their bytes go to be sorted (kind 4); those of crowded keys
    are asked about again window by window (kinds 5 and 6)."""

    def work(answers: list[dict], body: dict) -> Iterator[pa.RecordBatch]:
        least, state = _answers([r for r in answers if r["kind"] == 1])
        if not state.any():
            return
        _, docs = X.unbody(body["more"], body["data"])
        raw = b"".join(docs)
        _, first, after, where = _spots(next(r for r in answers if r["kind"] == 2))
        begin, end = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
        begin[where], end[where] = first, after  # any place of each distinct segment
        out = []
        own = np.nonzero(state == 1)[0]
        if len(own):
            text, size = _join(raw, begin[own], end[own]), (end - begin)[own]
            h = gram_hashes(np.frombuffer(text, np.uint8), gram)
            inner = size - gram + 1
            start = np.cumsum(size) - size
            flat = h[np.repeat(start, inner) + _runs(inner)]
            key = mixed(np.minimum.reduceat(flat, np.cumsum(inner) - inner), 13)
            stop = np.cumsum(size)
            for k, i, j in _split(_bucket(key, buckets), buckets):
                place = np.concatenate([key[i:j].view(np.int64), least[own[i:j]], size[i:j]])
                out.append((4, body["block"], k, j - i, X.squeeze(text[start[i] : stop[j - 1]]), X.squeeze(place.tobytes())))
        crowded = np.nonzero(state == 2)[0]
        if len(crowded):
            n = (end - begin)[crowded] - length + 1
            at = np.repeat(begin[crowded], n) + _runs(n)
            digest = _digests(raw, at, at + length)
            out += _meet(body["block"], digest[:, 0] ^ digest[:, 1], digest, np.repeat(least[crowded], n), np.zeros(len(at), np.int64), at, at + length, buckets, 5)
        yield X.rows(out)

    return work


def _sort(length: int):
    def judge(group: list[dict]) -> list[tuple]:
        """The windows' smallest ids for segments that came with their bytes. A window whose hash is alone
        among the different segments is alone; of the rest, what is left of a key's segments is
        sorted if it differs."""
        keys, ids, sizes, raw, cuts = [], [], [], [], [0]
        for r in group:
            place, n = np.frombuffer(X.unsqueeze(r["more"]), np.int64), r["n"]
            keys.append(place[:n])
            ids.append(place[n : 2 * n])
            sizes.append(place[2 * n :])
            raw.append(X.unsqueeze(r["data"]))
            cuts.append(cuts[-1] + n)
        key, low, size, text = np.concatenate(keys), np.concatenate(ids), np.concatenate(sizes), b"".join(raw)
        start = np.cumsum(size) - size
        seen: dict[tuple[int, bytes], int] = {}
        same = np.array([seen.setdefault((k, text[a : a + n]), len(seen)) for k, a, n in zip(key.tolist(), start.tolist(), size.tolist(), strict=True)])
        _, one = np.unique(same, return_index=True)  # a representative of each different segment
        least = np.full(len(one), LAST)
        np.minimum.at(least, same, low)
        wins = size[one] - length + 1
        of = np.repeat(np.arange(len(one)), wins)
        at = start[one][of] + _runs(wins)
        h = gram_hashes(np.frombuffer(text, np.uint8), length)[at]
        order = np.argsort(h)
        twin = h[order][1:] == h[order][:-1]
        again = np.zeros(len(h), bool)
        again[order[1:][twin]] = True
        again[order[:-1][twin]] = True
        answer = least[of]
        # runs of windows that may be elsewhere too
        edge = again.copy()
        edge[1:] &= ~again[:-1] | (of[1:] != of[:-1])
        begin = np.nonzero(edge)[0]
        stop = np.nonzero(again & np.append(~again[1:] | (of[1:] != of[:-1]), True))[0] + 1
        by_key: dict[int, dict[bytes, list[int]]] = {}
        own_key = key[one][of[begin]].tolist()
        for x, (k, a, n) in enumerate(zip(own_key, at[begin].tolist(), (stop - begin).tolist(), strict=True)):
            by_key.setdefault(k, {}).setdefault(text[a : a + n + length - 1], []).append(x)
        for parts in by_key.values():
            names = sorted(parts)
            lows = [min(int(least[of[begin[x]]]) for x in parts[t]) for t in names]
            found = least_ids(names, lows, length) if len(names) > 1 else [np.full(len(names[0]) - length + 1, lows[0])]
            for t, value in zip(names, found, strict=True):
                for x in parts[t]:
                    answer[begin[x] : stop[x]] = value
        ends = np.cumsum(wins)
        out = []
        for r, i, j in zip(group, cuts[:-1], cuts[1:], strict=True):
            n = wins[same[i:j]]
            out.append((4, r["block"], r["bucket"], r["n"], X.squeeze(answer[np.repeat((ends - wins)[same[i:j]], n) + _runs(n)].tobytes()), b""))
        return out

    return judge


def _spots(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first byte, last byte + 1 and number among the distinct of a block's segments."""
    doc, first, size, where = np.frombuffer(X.unsqueeze(row["data"]), np.int32).reshape(4, -1).astype(np.int64)
    first = np.cumsum(first)
    return np.cumsum(doc), first, first + size, where


def _remove(length: int):
    def work(answers: list[dict], body: dict) -> Iterator[pa.RecordBatch]:
        head, docs = X.unbody(body["more"], body["data"])
        begin = np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype(np.int64)
        edge = np.zeros(begin[-1] + 1, np.int64)
        of_kind: dict[int, list[dict]] = {k: [r for r in answers if r["kind"] == k] for k in (1, 2, 4, 5, 6)}
        if of_kind[2]:
            least, state = _answers(of_kind[1])
            doc, first, after, where = _spots(of_kind[2][0])
            own = _ids(head)[doc]
            gone = (state[where] == 0) & (least[where] < own)
            np.add.at(edge, first[gone], 1)
            np.add.at(edge, after[gone], -1)
            wins = np.zeros(len(state), np.int64)
            wins[where] = after - first - length + 1
            for kind, value in ((4, 1), (6, 2)):  # sorted, or asked about one by one
                parts = np.nonzero(state == value)[0]
                if not len(parts):
                    continue
                if kind == 4:
                    flat = np.concatenate([np.frombuffer(X.unsqueeze(r["data"]), np.int64) for r in of_kind[4]])
                else:
                    flat = _answers(of_kind[5])[0][_spots(of_kind[6][0])[3]]
                offset = np.zeros(len(state), np.int64)
                offset[parts] = np.cumsum(wins[parts]) - wins[parts]
                mine = np.nonzero(state[where] == value)[0]
                n = wins[where[mine]]
                step = _runs(n)
                hit = flat[np.repeat(offset[where[mine]], n) + step] < np.repeat(own[mine], n)
                at = (np.repeat(first[mine], n) + step)[hit]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
        cover = np.cumsum(edge[:-1]) > 0
        kept, n_removed, spans = [], [], []
        for k, text in enumerate(docs):
            mask = cover[begin[k] : begin[k + 1]]
            n_removed.append(int(mask.sum()))
            if not n_removed[-1]:
                kept.append(text)
                spans.append([])
                continue
            side = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
            a, b = np.nonzero(side == 1)[0].tolist(), np.nonzero(side == -1)[0].tolist()
            spans.append([{"first": x, "after": y} for x, y in zip(a, b, strict=True)])
            kept.append(b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [head.column("doc_id"), pa.array(kept, pa.binary()), pa.array([len(x) for x in docs], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))],
            ["doc_id", "kept", "n_bytes", "n_removed", "removed"],
        )

    return work


def drop_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts in a document with a
    smaller id.

    Returns ``(doc_id, kept binary, n_bytes, n_removed, removed array<struct<first, after>>)``, a row per
    input row: the bytes left and the maximal removed runs. Strings never cross documents and are
    judged on the input. Null texts are empty. Rows of one id are documents of equal rank: they
    take nothing from each other. Null ids come after all others. Other columns are not read."""
    spark = docs.sparkSession
    data = texts(docs, id_col, text_col)
    total = int(data.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    per_segment = max(1, (length - gram + 2) // 2)
    width = CELLS * max(total // per_segment, 1 << 16)
    buckets = X.n_buckets(total, BUCKET_BYTES)
    cells = max(1, buckets // 2)
    first = stored(data.mapInArrow(_ask_cells(length, gram, width, cells), X.ROWS))
    bodies = first(0)
    counted = cut(X.answered(first(1), X.judge_repeats))
    drop_cut(first(1))
    settle(spark)
    second = stored(X.per_block(bodies, counted, _segments(length, gram, width, buckets), X.ROWS))
    drop_cut(counted)
    settle(spark)
    least = cut(X.answered(second(1), judge_segments))
    drop_cut(second(1))
    settle(spark)
    known = least.unionByName(second(2))
    third = stored(X.per_block(bodies, known, _different(length, gram, buckets), X.ROWS))
    settle(spark)
    answers = known.unionByName(cut(X.answered(third(4), _sort(length)))).unionByName(cut(X.answered(third(5), judge_segments))).unionByName(third(6))
    drop_cut(third(4))
    settle(spark)
    return X.per_block(bodies, answers, _remove(length), "doc_id long, kept binary, n_bytes long, n_removed long, removed array<struct<first: long, after: long>>")


#: DuckDB's version of the query: every 50-byte string, in hex.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, unnest(range(length(x) // 2)) AS i, x FROM d),
s AS (SELECT doc_id, i, substring(x, 2 * i + 1, 2) AS byte, CASE WHEN 2 * (i + 50) <= length(x) THEN substring(x, 2 * i + 1, 100) END AS s FROM b),
r AS (SELECT doc_id, i, byte, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM s),
c AS (SELECT doc_id, i, byte, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
k AS (SELECT doc_id, count(*) FILTER (gone) AS m, count(*) FILTER (opens) AS spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(m, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
