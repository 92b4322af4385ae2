"""Language-model scores by logistic context mixing.

A text is its lower-cased words, each followed by a space, and a line feed at its end. Every bit of it
is predicted by several hashed contexts: the last one to five bytes, across spaces, and the whole word
so far. Each context keeps counts of the zeros and ones that followed it in all training text; their
log odds are mixed with weights that a gate selects, by how long a context has been met before,
whether the word so far has been, and by the bit's place in its byte. The weights are learnt from every bit of
all training text, with its own occurrence taken out of the counts: equal inputs are counted together, and
each step sums slopes and curvatures over all of them; an adaptive map then refines the mixed probability by
what followed such predictions, again all of them. The costs of the bits of a byte depend on its contexts alone, so a worker keeps those it met
lately.

Two predictors of whole words grow with the corpus: a word's share of all training words, by exact
counts, and runs of words whose ends their content decides: a run that occurs in other training text may
be coded as a whole, by its share of all runs. The probabilities of a word, and of a run, are linear
mixtures of these and of the mixed bits.

Blocks of documents send their distinct words, runs and byte contexts with counts to buckets; only the
hashed tables and the weights, of fixed size, are sent to workers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quarry.llm import exchange as X
from quarry.llm.common import cut, drop_cut, fold, settle, small_batches, texts
from quarry.llm.windows import _power, mixed

#: Bits of the hashed tables' slots, for contexts of one to five bytes and for the word so far.
TABLE_BITS = (19, 20, 21, 21, 22, 22)
ORDERS, WORD = 5, 5
TABLES = len(TABLE_BITS)
INPUTS = TABLES + 1  # the tables and a constant
#: Gates: longest context met before (none to five), word so far met or not, bit of the byte.
GATES = (ORDERS + 1) * 2 * 8
#: Steps of a unit of log odds and largest log odds of a mixed prediction; cells of the adaptive map.
STEPS, FAR, CELLS = 32, 14, 28
SCALE = 2 * FAR * STEPS + 1
#: Steps in which the weights are learnt, each over all training text; pull towards the first weights, in bits' worth.
ROUNDS, PULL = 6, 8.0
#: Steps of a unit, and bounds, of the log ratio of a word's share to its spelled probability.
RATIO_STEPS, RATIO_FAR = 16, 256
#: Bytes of a text that are worked on at once: a slice begins as a text does.
SLICE = 1 << 18
#: Bytes of several texts, and examples, that are worked on at once: their arrays stay in a core's cache.
TOGETHER, CHUNK = 1 << 15, 1 << 13
#: Slots of the costs that a worker keeps.
KEPT = 1 << 21
#: Bytes of a block (larger ones name their common words less often) and of a bucket; byte contexts that a
#: task holds before it sends them.
BLOCK, BUCKET_BYTES, HELD = 4_000_000, 8 << 20, 6_000_000
#: A run of words ends at one place in so many, and after so many words at the latest.
RUN, LONGEST = 16, 64

#: Node of a nibble's tree, by bit of the byte and by byte.
NODE = np.array([[1 << k % 4 | (b >> 4 if k < 4 else b & 15) >> (4 - k % 4) for b in range(256)] for k in range(8)], np.intp)
#: Twice the node and the bit that follows it.
PLACE = 2 * NODE + np.array([[b >> (7 - k) & 1 for b in range(256)] for k in range(8)], np.intp)
BIT = np.array([[b >> (7 - k) & 1 for b in range(256)] for k in range(8)], np.int8)

def spelling(words: list[bytes]) -> bytes:
    return b" ".join([*words, b"\n"])


def _pieces(spelled: list[bytes]) -> Iterator[bytes]:
    for text in spelled:
        if len(text) <= SLICE:
            yield text
        else:
            yield from (text[i : i + SLICE] for i in range(0, len(text), SLICE))


def contexts(spelled: list[bytes], words: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each byte the five before it (the latest lowest, zeros before a slice), a hash of the word so far (if
    ``words``), and the byte; of whole slices of texts, a longer one or some together at once."""
    held: list[bytes] = []
    size = 0
    for piece in chain(_pieces(spelled), [b""]):
        if held and (not piece or size + len(piece) > TOGETHER):
            yield _contexts(held, words)
            held, size = [], 0
        held.append(piece)
        size += len(piece)


def _contexts(pieces: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(raw)
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first = np.cumsum(lens) - lens
    one, context = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    one[1:] = raw[:-1]
    context |= one
    context[1:] |= one[:-1] << np.uint64(8)
    two = context.copy()
    context[2:] |= two[:-2] << np.uint64(16)
    context[4:] |= one[:-4] << np.uint64(32)
    for k in range(ORDERS):  # nothing from before a slice
        at = first[lens > k] + k
        context[at] &= np.uint64((1 << 8 * k) - 1)
    if not words:
        return context, context, raw
    opens = one == 32
    opens[first] = True
    start = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    power, inverse, value = _power(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value[raw] * power[:n], out=total[1:])
        word = (total[:n] - total[start]) * inverse[start]
    return context, word, raw


def _hash(table: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """32 bits for a table's context."""
    key = word if table == WORD else context & np.uint64((1 << 8 * (table + 1)) - 1)
    return (mixed(key, 20 + table) >> np.uint64(32)).astype(np.uint32)


def _lines(order: int, h: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First slots of the sixteen that a nibble's tree takes, for a byte's first and second nibble."""
    shift = np.uint32(36 - TABLE_BITS[order])
    with np.errstate(over="ignore"):
        g = (h + ((byte >> 4).astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)
        g ^= g >> np.uint32(15)
        g *= np.uint32(0xC2B2AE35)
    return ((h >> shift) << np.uint32(4)).astype(np.intp), ((g >> shift) << np.uint32(4)).astype(np.intp)


def new_table(order: int) -> np.ndarray:
    """Zeros and ones that followed, for each slot."""
    return np.zeros((1 << TABLE_BITS[order], 2), np.int32)


def add_counts(table: np.ndarray, order: int, h: np.ndarray, byte: np.ndarray, count: np.ndarray) -> None:
    """Add what followed."""
    lines = [x << 1 for x in _lines(order, h, byte)]
    count, flat = count.astype(np.int32), table.reshape(-1)
    for k in range(8):
        np.add.at(flat, lines[k // 4] + PLACE[k].take(byte), count)


def odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of a one in tenths; 0 where nothing followed and only there."""
    x = np.clip(np.rint(10 * (np.log(ones + 0.4) - np.log(zeros + 0.4))), -127, 127).astype(np.int8)
    x[(x == 0) & (zeros + ones > 0)] = 1
    return x


def _slots(table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The slots met with their zeros and ones, a range of slots at once."""
    for i in range(0, table.shape[1], 1 << 18):
        zeros, ones = table[:, i : i + (1 << 18)]
        met = np.nonzero(zeros + ones)[0]
        yield met + i, zeros[met], ones[met]


def table_odds(table: np.ndarray) -> np.ndarray:
    out = np.zeros(table.shape[1], np.int8)
    for met, zeros, ones in _slots(table):
        out[met] = odds(zeros, ones)
    return out


def _gate(x: list[np.ndarray]) -> np.ndarray:
    """Gate of the inputs, of those of one bit of the byte."""
    level = (x[0] != 0).astype(np.int8)
    for o in range(1, ORDERS):
        level += x[o] != 0
    return level * np.int8(2) + (x[WORD] != 0)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def first_weights() -> np.ndarray:
    """To begin with, longer contexts count more: (inputs, gates)."""
    return np.repeat(np.array([0.1, 0.1, 0.1, 0.2, 0.3, 0.4, 0.0])[:, None], GATES, axis=1)


def first_map() -> np.ndarray:
    """Zeros and ones seen in each cell of the map, none."""
    return np.zeros((2, GATES // 8, CELLS))


def apart_odds(table: np.ndarray) -> np.ndarray:
    """Odds for each slot when a zero, and when a one, of it is taken out: at twice the slot, plus the bit."""
    out = np.zeros((table.shape[1], 2), np.int8)
    for met, zeros, ones in _slots(table):
        out[met, 0] = odds(np.maximum(zeros - 1, 0), ones)
        out[met, 1] = odds(zeros, np.maximum(ones - 1, 0))
    return out.ravel()


def both_odds(table: np.ndarray) -> np.ndarray:
    """By slot and bit: the odds, and those with the bit taken out, in one word."""
    out = np.empty((table.shape[1], 2, 2), np.int8)
    out[:, :, 0] = table_odds(table)[:, None]
    out[:, :, 1] = apart_odds(table).reshape(-1, 2)
    return out.view(np.int16).ravel()


def examples(apart: list[np.ndarray], parts: Iterator[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each bit of the byte the distinct inputs (six bytes, the bit above them, their level above that) and how often
    they occur, of ``(context, word, byte, count)``, with each bit's own occurrence taken out."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(8)]
    merged = [0] * 8
    for context, word, byte, count in parts:
        for i in range(0, len(byte), 1 << 16):
            part = slice(i, i + (1 << 16))
            own = byte[part]
            lines = [[x << 1 for x in _lines(o, _hash(o, context[part], word[part]), own)] for o in range(TABLES)]
            own = own.astype(np.intp)
            for k in range(8):
                raw = np.zeros((len(own), 8), np.int8)
                raw[:, TABLES] = BIT[k].take(own)
                place = PLACE[k].take(own)
                for o in range(TABLES):
                    raw[:, o] = apart[o].take(lines[o][k // 4] + place)
                held[k].append(_sums(raw.view(np.uint64).ravel(), count[part]))
                if sum(len(x) for x, _ in held[k]) > 2 * merged[k] + (1 << 18):
                    held[k] = [_sums(*(np.concatenate(x) for x in zip(*held[k], strict=True)))]
                    merged[k] = len(held[k][0][0])
    return [_levelled(*(_sums(*(np.concatenate(x) for x in zip(*h, strict=True))) if h else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))) for h in held]


def _levelled(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted examples by level, which becomes the highest byte of their keys."""
    level = _gate(list(keys.view(np.int8).reshape(-1, 8)[:, :TABLES].T))
    order = np.argsort(level, kind="stable")
    return keys[order] | level[order].astype(np.uint64) << np.uint64(56), counts[order]


def _opened(keys: np.ndarray, weights: np.ndarray) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Packed examples in chunks of one level: where, the level, inputs (a row for each), mixed log odds and the bit."""
    raw = keys.view(np.uint8).reshape(-1, 8)
    bounds = np.searchsorted(keys, np.arange(GATES // 8 + 1, dtype=np.uint64) << np.uint64(56))
    for g, (first, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for i in range(first, end, CHUNK):
            part = slice(i, min(i + CHUNK, end))
            x = np.empty((INPUTS, part.stop - i))
            np.multiply(raw[part, :TABLES].view(np.int8).T, 0.1, out=x[:TABLES])
            x[TABLES] = 0.3
            z = x[0] * weights[0, g]
            for o in range(1, INPUTS):
                z += x[o] * weights[o, g]
            yield part, g, x, np.clip(z, -FAR, FAR, out=z), raw[part, TABLES]


def slopes(k: int, keys: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By level: slope of the bits' log probability in the weights, and its curvature."""
    out = np.zeros((GATES // 8, INPUTS, INPUTS + 1))
    for part, g, x, z, bit in _opened(keys, weights[:, k::8]):
        p = _squash(z)
        count = counts[part]
        factors = np.empty((INPUTS + 1, len(p)))
        np.multiply(bit - p, count, out=factors[0])
        np.multiply(x, p * (1 - p) * count, out=factors[1:])
        out[g] += x @ factors.T
    return out


def stepped(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The weights after a step up the slopes (gates, inputs, 1 + inputs) by their curvatures, of bounded length."""
    first, out = first_weights(), weights.copy()
    for g in range(GATES):
        slope = sums[g, :, 0] - PULL * (weights[:, g] - first[:, g])
        move = np.linalg.solve(sums[g, :, 1:] + PULL * np.eye(INPUTS), slope)
        out[:, g] += move / max(1.0, np.abs(move).max())
    return out


def followed(k: int, keys: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Zeros and ones that followed, for each cell of the map."""
    out = first_map()
    for part, g, _, z, bit in _opened(keys, weights[:, k::8]):
        out[:, g] += np.bincount(bit * CELLS + _cell(z), counts[part], 2 * CELLS).reshape(2, CELLS)
    return out


def share_of(ratios: np.ndarray) -> float:
    """The share of words that their own counts had better predict, from how often each log ratio occurs."""
    share, n = 0.5, int(ratios.sum())
    value = np.exp2((np.arange(len(ratios)) - RATIO_FAR * RATIO_STEPS) / RATIO_STEPS)
    value[0] = 0.0
    for _ in range(30 if n else 0):
        share = float(np.clip((ratios * (share * value / (share * value + 1 - share))).sum() / n, 1e-4, 0.999))
    return share


def _cell(z: np.ndarray) -> np.ndarray:
    return np.clip((z + FAR) * (CELLS / (2 * FAR)), 0, CELLS - 1).astype(np.int64)


def cost_table(seen: np.ndarray) -> np.ndarray:
    """Bits of a zero and of a one by gate and step of the mixed log odds: (2, gates x steps)."""
    z = np.linspace(-FAR, FAR, SCALE)
    p = np.clip(_squash(z), 1e-6, 1 - 1e-6)
    n = seen[:, :, _cell(z)]  # zero or one, level, step
    p = (p + (n[1] + 8 * p) / (n.sum(axis=0) + 8)) / 2
    both = -np.log2(np.stack([1 - p, p]))
    return np.repeat(both, 8, axis=1).reshape(2, -1).astype(np.float32)


class Mixer:
    """Costs of bytes under frozen tables, weights and map."""

    def __init__(self, tables: Iterable[np.ndarray], weights: np.ndarray, seen: np.ndarray):
        self.odds = [both_odds(t) for t in tables]
        # by bit and input: the weights of each gate, for inputs in tenths
        scale = np.array([0.1] * TABLES + [0.3])[:, None]
        self.weights = [np.ascontiguousarray(weights[:, k::8] * scale, np.float32) for k in range(8)]
        cost = cost_table(seen).reshape(2, GATES, SCALE)
        self.cost = [np.ascontiguousarray(cost[:, k::8].transpose(1, 2, 0)).ravel() for k in range(8)]
        # keys and what is kept for them: the cost, and that with a byte's own occurrence taken out, in one word
        self.kept = np.full((KEPT, 2), np.uint64(0xFFFFFFFFFFFFFFFF))

    def costs(self, context: np.ndarray, word: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return self._costs(context, word, byte)[:, 0]

    def _costs(self, context: np.ndarray, word: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Costs, and those with each byte's own occurrence taken out."""
        out = np.zeros((len(byte), 2), np.float32)
        for i in range(0, len(byte), CHUNK):
            part = slice(i, i + CHUNK)
            own = byte[part]
            lines = [[x << 1 for x in _lines(o, _hash(o, context[part], word[part]), own)] for o in range(TABLES)]
            own = own.astype(np.intp)
            for k in range(8):
                place = PLACE[k].take(own)  # twice the node and the bit
                x = [self.odds[o].take(lines[o][k // 4] + place).view(np.int8) for o in range(TABLES)]
                out[part] += self._cost(k, x, np.repeat(BIT[k].take(own), 2)).reshape(-1, 2)
        return out

    def _cost(self, k: int, x: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
        gate = _gate(x).astype(np.intp)
        z = self.weights[k][TABLES].take(gate)
        for o in range(TABLES):  # one by one, so that equal contexts cost the same in any company
            z += self.weights[k][o].take(gate) * x[o]
        np.clip(z, -FAR, FAR, out=z)
        step = ((z + np.float32(FAR)) * np.float32(STEPS) + np.float32(0.5)).astype(np.intp)
        return self.cost[k].take((step + gate * SCALE) * 2 + bit)

    def bits(self, spelled: list[bytes]) -> np.ndarray:
        """Bits of every byte of the texts."""
        return self.both(spelled, None)[0]

    def both(self, spelled: list[bytes], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Bits of every byte of the texts, and of the ``wanted`` ones with their own occurrence taken out (0 for
        others)."""
        n, at = sum(map(len, spelled)), 0
        out, alone = np.zeros(n, np.float32), np.zeros(n if wanted is not None else 0, np.float32)
        for context, word, byte in contexts(spelled):
            with np.errstate(over="ignore"):
                key = (context << np.uint64(8) | byte) * np.uint64(0xD6E8FEB86659FD93) + word * np.uint64(0x9E3779B97F4A7C15)
            found, part = self._look(key, context, word, byte), slice(at, at + len(byte))
            out[part] = found[:, 0]
            if wanted is not None:
                np.copyto(alone[part], found[:, 1], where=wanted[part])
            at += len(byte)
        return out, alone

    def _look(self, key, context, word, byte) -> np.ndarray:
        slot = (key >> np.uint64(64 - 21)).astype(np.intp)
        kept = self.kept.take(slot, axis=0)
        found = np.ascontiguousarray(kept[:, 1])
        miss = np.nonzero(kept[:, 0] != key)[0]
        if len(miss):
            new, first, at = np.unique(key[miss], return_index=True, return_inverse=True)
            pick = miss[first]
            costs = self._costs(context[pick], word[pick], byte[pick]).view(np.uint64).ravel()
            found[miss] = costs[at]
            self.kept[slot[pick]] = np.stack([new, costs], 1)
        return found.view(np.float32).reshape(-1, 2)


def _tokens(docs: list[bytes], buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """A block's distinct tokens by bucket, where each bucket's end, the number of each token in order (each document's
    end included), where the documents begin, and how they are spelled."""
    spelled = [spelling(x.lower().split()) for x in docs]
    data = b"".join(spelled)
    raw = np.frombuffer(data, np.uint8)
    ends = np.nonzero((raw == 32) | (raw == 10))[0] + 1  # words have neither byte
    begin = np.searchsorted(ends, np.concatenate([[0], np.cumsum([len(x) for x in spelled])]), "right").astype(np.int64)
    places = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
    coded = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, places, pa.py_buffer(data)]).dictionary_encode()
    tokens = [t[:-1] for t in coded.dictionary.to_pylist()]
    order, cuts = _dealt(tokens, buckets)
    rank = np.empty(len(tokens), np.int32)
    rank[order] = np.arange(len(tokens), dtype=np.int32)
    return [tokens[k] for k in order.tolist()], cuts, rank[coded.indices.to_numpy()], begin, spelled


def _planes(values: np.ndarray) -> pa.Array:
    """Numbers of 32 bits by planes of bytes, as one value."""
    return pa.array([np.ascontiguousarray(values.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()], pa.large_binary())


def _unplanes(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(column[0].as_py(), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _block(tokens: list[bytes], at: np.ndarray, sizes: np.ndarray, runs: np.ndarray) -> bytes:
    """A block's texts as tokens and their numbers, and the sizes (up to LONGEST) and numbers of its runs."""
    words = b"".join([t + b" " if t else b"\n" for t in tokens])
    return _columns(words=pa.array([words], pa.large_binary()), at=_planes(at), sizes=pa.array([sizes.astype(np.uint8).tobytes()], pa.large_binary()), runs=_planes(runs))


def _unblock(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's spelling, the sizes in it of the tokens, their numbers, where the runs begin and their numbers."""
    batch = _batch(data)
    words = batch.column("words")[0].as_buffer()
    raw = np.frombuffer(words, np.uint8)
    ends = np.nonzero((raw == 32) | (raw == 10))[0] + 1
    at = _unplanes(batch.column("at"))
    places = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
    spelled = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, places, words]).take(pa.array(at))
    sizes = np.frombuffer(batch.column("sizes")[0].as_py(), np.uint8).astype(np.int64)
    return spelled.buffers()[2].to_pybytes(), np.diff(ends, prepend=0)[at], at, np.cumsum(sizes) - sizes, _unplanes(batch.column("runs"))


def _dealt(tokens: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the tokens by bucket, and where each bucket's end."""
    at = np.fromiter(map(crc32, tokens), np.int64, len(tokens)) % buckets
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(buckets + 1))


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def _runs_of(at: np.ndarray, begin: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs begin, and their keys. A run ends after two words whose hash says so, after LONGEST
    words, and with its document."""
    h = hashes[at]
    with np.errstate(over="ignore"):
        pair = mixed(h[1:] * np.uint64(3) + h[:-1], 31)
    cut = np.zeros(len(h) + 1, bool)
    cut[2:] = np.append(pair[:-1] % np.uint64(RUN) == 0, False) if len(h) > 1 else False
    cut[begin[:-1] + 1] = False  # a pair of words of one text
    cut[begin] = True
    start = np.nonzero(cut[:-1])[0]
    size = np.diff(np.append(start, len(h)))
    pieces = -(-size // LONGEST)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(start, pieces) + step * LONGEST
    size = np.diff(np.append(start, len(h)))
    inside = (np.arange(len(h)) - np.repeat(start, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        return start, np.add.reduceat(mixed(h + inside * np.uint64(0x9E3779B97F4A7C15), 32), start)


def _range(keys: np.ndarray, buckets: int) -> np.ndarray:
    per = np.uint64(-(-(1 << 64) // buckets)) if buckets > 1 else np.uint64((1 << 64) - 1)
    return np.searchsorted(np.minimum(keys // per, np.uint64(buckets - 1)), np.arange(buckets + 1, dtype=np.uint64))


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of up to 49 bits, sorted, with the sums of their counts. Counts of up to 15 bits are sorted along, in
    the same word."""
    few = counts < 1 << 15
    rare = slice(None) if few.all() else few
    packed = keys[rare] << np.uint64(15) | counts[rare].astype(np.uint64)
    packed.sort()
    own = packed >> np.uint64(15)
    first = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0] if len(own) else np.zeros(0, np.int64)
    own = own[first]
    total = np.add.reduceat((packed & np.uint64((1 << 15) - 1)).astype(np.int64), first) if len(own) else np.zeros(0, np.int64)
    if rare is few:
        many, at = np.unique(keys[~few], return_inverse=True)
        more = np.zeros(len(many), np.int64)
        np.add.at(more, at, counts[~few])
        place = np.searchsorted(own, many)
        met = np.isin(many, own, assume_unique=True)
        total[place[met]] += more[met]
        own, total = np.insert(own, place[~met], many[~met]), np.insert(total, place[~met], more[~met])
    return own, total


def _byte_keys(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (five bytes before, byte) of the texts with counts. The byte is the lowest; a key is its
    context's bytes in order of age, the latest highest, so that shorter contexts stand together."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[np.ndarray] = []
    size = 0
    none = np.zeros(0, np.uint64)
    for context, _, byte in chain(contexts(spelled, words=False), [(none, none, none)]):
        if held and (not len(byte) or size > BLOCK):
            keys = np.concatenate(held)
            keys.sort()
            first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
            found.append((keys[first], np.diff(np.append(first, len(keys)))))
            held, size = [], 0
        held.append(context.byteswap() >> np.uint64(56 - 8 * ORDERS) | byte)
        size += len(byte)
    if len(found) == 1:
        return found[0]
    return _sums(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (none, np.zeros(0, np.int64))


def _send(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray]]:
    """Byte contexts as rows for their buckets (those of one context together), after they are summed."""
    keys, counts = _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
    bucket = (mixed(keys >> np.uint64(8), 51) % np.uint64(buckets)).astype(np.int64)
    out = []
    for k in range(buckets):
        own = bucket == k
        if own.any():
            out.append((3, 0, k, int(own.sum()), X.pack(keys[own]), X.squeeze(counts[own].tobytes())))
    return out, (keys, counts)


def _ask(buckets: int, narrow: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0
        for head, docs in X.blocks_of(batches, BLOCK):
            block = X.fresh_block()
            tokens, cuts, at, begin, spelled = _tokens(docs, buckets)
            train = ~head.column("held_out").to_numpy(zero_copy_only=False)
            counts = np.bincount(at[np.repeat(train, np.diff(begin))], minlength=len(tokens)).astype(np.int32)
            out = [(1, block, k, j - i, X.squeeze(b"\n".join(tokens[i:j])), X.squeeze(counts[i:j].tobytes())) for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
            start, keys = _runs_of(at, begin, _hashes(tokens))
            keys, own_run = np.unique(keys, return_inverse=True)
            times = np.bincount(own_run, train[np.searchsorted(begin, start, "right") - 1]).astype(np.int64)
            cuts = _range(keys, buckets)
            out += [(2, block, k, int(j - i), X.pack(keys[i:j]), X.squeeze(times[i:j].tobytes())) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
            more = _columns(doc_id=head.column("doc_id"), held_out=head.column("held_out"), n_tokens=np.diff(begin))
            out.append((0, block, -1, len(docs), _block(tokens, at, np.diff(np.append(start, len(at))), own_run), more))
            yield X.rows(out)
            held.append(_byte_keys([s for s, t in zip(spelled, train, strict=True) if t]))
            n_held += len(held[-1][0])
            if n_held > HELD:
                keys, counts = _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n_held = [(keys, counts)], len(keys)
                if n_held > HELD // 2:
                    yield X.rows(_send(held, narrow)[0])
                    held, n_held = [], 0
        if n_held:
            yield X.rows(_send(held, narrow)[0])

    return run


def _count_runs(group: list[dict]) -> list[tuple]:
    """How often each run occurs in training text, over all blocks; first how many do, and how many of
    these more than once."""
    keys = np.concatenate([X.unpack(r["data"]) for r in group])
    times = np.concatenate([np.frombuffer(X.unsqueeze(r["more"]), np.int64) for r in group])
    _, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, times).astype(np.int64)
    cuts = np.cumsum([0, *(r["n"] for r in group)])
    sums = np.array([total.sum(), total[total > 1].sum()], np.int64)
    return [(8, -1, group[0]["bucket"], 0, sums.tobytes(), b""), *((2, r["block"], r["bucket"], r["n"], X.squeeze(total[at[i:j]].tobytes()), b"") for r, i, j in zip(group, cuts[:-1], cuts[1:], strict=True))]


def _table_rows(order: int, table: np.ndarray) -> Iterator[tuple]:
    """What a table holds, as rows of up to 65,536 slots; bucket: the table's order and the slots' range."""
    for r in range(-(-len(table) >> 16)):
        part = table[r << 16 : (r + 1) << 16]
        slot = np.nonzero(part.any(axis=1))[0]
        if len(slot):
            yield 4, -1, order << 16 | r, len(slot), X.pack(slot.astype(np.uint64)), X.squeeze(np.ascontiguousarray(part[slot].T).tobytes())


def _count_words(narrow: int):
    """Each bucket's words: counts over all blocks to those who asked (kind 1), sums (kind 8), the words of over four
    bytes in training text with counts (kind 6), and, a task at once, what followed each word so far (kind 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = new_table(WORD)
        for group in X.grouped(batches, "bucket"):
            place: dict[bytes, int] = {}
            ats, parts = [], []
            for r in group:
                words = X.unsqueeze(r["data"]).split(b"\n")
                ats.append(np.fromiter((place.setdefault(t, len(place)) for t in words), np.int64, len(words)))
                parts.append(np.frombuffer(X.unsqueeze(r["more"]), np.int32))
            total = np.bincount(np.concatenate(ats), np.concatenate(parts), len(place)).astype(np.int64)
            words = list(place)
            sums = np.array([total.sum(), (total > 0).sum()], np.int64)
            out = [(8, -1, group[0]["bucket"], 0, sums.tobytes(), b"")]
            out += [(1, r["block"], r["bucket"], r["n"], X.squeeze(total[at].tobytes()), b"") for r, at in zip(group, ats, strict=True)]
            if found := sorted((w, k) for w, k in place.items() if len(w) >= ORDERS and total[k]):
                out.append((6, -1, narrow + group[0]["bucket"], len(found), X.squeeze(b"\n".join([w for w, _ in found])), X.squeeze(total[[k for _, k in found]].tobytes())))
            yield X.rows(out)
            known = np.nonzero(total)[0]
            for i in range(0, len(known), 1 << 15):
                own = known[i : i + (1 << 15)]
                spelled = [words[k] + b" " if words[k] else b"\n" for k in own.tolist()]
                sliced = np.repeat(total[own], [-(-len(s) // SLICE) for s in spelled])
                for context, word, byte, n in _each(spelled, sliced):
                    add_counts(table, WORD, _hash(WORD, context, word), byte, n)
        yield X.rows(list(_table_rows(WORD, table)))

    return run


def _each(spelled: list[bytes], uses: np.ndarray) -> Iterator[tuple]:
    """As :func:`contexts`, with how often each byte's text occurs; ``uses`` has a value for each slice."""
    sizes = np.fromiter(map(len, _pieces(spelled)), np.int64)
    every, at = np.repeat(uses, sizes), 0
    for context, word, byte in contexts(spelled):
        yield context, word, byte, every[at : at + len(byte)]
        at += len(byte)


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What followed each byte context, from the keys of whole buckets: tables' rows (kind 4), a task at once; and
    the keys that hold a whole word so far, with counts (kind 5)."""
    tables = [new_table(o) for o in range(ORDERS)]
    for group in X.grouped(batches, "bucket"):
        keys, counts = _sums(np.concatenate([X.unpack(r["data"]) for r in group]), np.concatenate([np.frombuffer(X.unsqueeze(r["more"]), np.int64) for r in group]))
        byte = (keys & np.uint64(255)).astype(np.uint8)
        whole = _begins((keys >> np.uint64(8) << np.uint64(64 - 8 * ORDERS)).byteswap())
        if whole.any():
            yield X.rows([(5, -1, group[0]["bucket"], int(whole.sum()), X.pack(keys[whole]), X.squeeze(counts[whole].tobytes()))])
        for o in range(ORDERS - 1, -1, -1):
            drop = np.uint64(8 * (ORDERS - 1 - o))
            short = keys >> np.uint64(8) >> drop << np.uint64(8) | byte
            short, count = _sums(short, counts)
            context = (short >> np.uint64(8) << np.uint64(56 - 8 * o)).byteswap()
            add_counts(tables[o], o, _hash(o, context, context), (short & np.uint64(255)).astype(np.uint8), count)
    yield X.rows([row for o, t in enumerate(tables) for row in _table_rows(o, t)])


def _sum_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range of slots, summed over tasks as the rows come."""
    bucket, held = -1, np.zeros((2, 1 << 16))

    def done() -> pa.RecordBatch:
        return X.rows([(4, -1, bucket, 0, X.squeeze(held.astype(np.float32).tobytes()), b"")])

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                if bucket >= 0:
                    yield done()
                bucket, held = row["bucket"], np.zeros((2, 1 << 16))
            held[:, X.unpack(row["data"]).astype(np.int64)] += np.frombuffer(X.unsqueeze(row["more"]), np.int32).reshape(2, -1)
    if bucket >= 0:
        yield done()


def _open(shared: list[tuple[int, bytes]]) -> Iterator[np.ndarray]:
    """The tables one after another, a row of zeros and one of ones each, from their ranges."""
    for order, bits in enumerate(TABLE_BITS):
        out = np.zeros((2, 1 << bits), np.float32)
        for bucket, data in shared:
            if bucket >> 16 == order:
                first = (bucket & 0xFFFF) << 16
                out[:, first : first + (1 << 16)] = np.frombuffer(X.unsqueeze(data), np.float32).reshape(2, -1)
        yield out


def _begins(context: np.ndarray) -> np.ndarray:
    """Whether the word so far begins within the context: after a space, or with its text."""
    out = context >> np.uint64(8 * (ORDERS - 1)) == 0
    for k in range(ORDERS):
        out |= context >> np.uint64(8 * k) & np.uint64(255) == 32
    return out


def _words_so_far(context: np.ndarray) -> np.ndarray:
    """Hashes of the words so far that begin within the contexts, as :func:`contexts` has them."""
    power, _, value = _power(ORDERS + 1)
    out, open_ = np.zeros(len(context), np.uint64), np.ones(len(context), bool)
    size = np.zeros(len(context), np.int64)
    letters = [(context >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64) for k in range(ORDERS)]
    for x in letters:
        open_ &= (x != 32) & (x != 0)
        size += open_
    with np.errstate(over="ignore"):
        for k, x in enumerate(letters):
            own = k < size
            out[own] += value[x[own]] * power[size[own] - 1 - k]
    return out


def _parts(group: list[dict]) -> Iterator[tuple]:
    """``(context, word, byte, count)`` of a shard: the bytes whose word so far begins in their context, and those further
    on in the words. Together they are all of training text (a word that a slice cuts counts as whole)."""
    for r in group:
        counts = np.frombuffer(X.unsqueeze(r["more"]), np.int64)
        if r["kind"] == 5:
            keys = X.unpack(r["data"])
            context = (keys >> np.uint64(8) << np.uint64(64 - 8 * ORDERS)).byteswap()
            yield context, _words_so_far(context), (keys & np.uint64(255)).astype(np.uint8), counts
        else:
            spelled = [w + b" " for w in X.unsqueeze(r["data"]).split(b"\n")]
            for context, word, byte, n in _each(spelled, np.repeat(counts, [-(-len(w) // SLICE) for w in spelled])):
                own = ~_begins(context)
                yield context[own], word[own], byte[own], n[own]


_aparts: dict[int, list[np.ndarray]] = {}


def _gather(shared, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's examples: a row for each bit of the byte (n)."""
        for group in X.grouped(batches, "bucket"):
            if key not in _aparts:
                _aparts.clear()
                _aparts[key] = [apart_odds(t) for t in _open(shared.value)]
            found = examples(_aparts[key], _parts(group))
            yield X.rows([(7, -1, group[0]["bucket"], k, X.pack(keys), X.squeeze(counts.tobytes())) for k, (keys, counts) in enumerate(found) if len(keys)])

    return run


def _each_bit(work, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = work(r["n"], X.unpack(r["data"]), np.frombuffer(X.unsqueeze(r["more"]), np.int64), weights)
                yield X.rows([(7, -1, r["bucket"], r["n"], found.tobytes(), b"")])

    return run


def _learn(shown: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights and map by all examples. Sums of fixed size come from each shard, and are added in the same order."""
    weights = first_weights()
    for _ in range(ROUNDS):
        sums = np.zeros((GATES // 8, 8, INPUTS, INPUTS + 1))
        found = shown.mapInArrow(_each_bit(slopes, weights), X.ROWS).select("n", "bucket", "data").collect()
        for r in sorted(found, key=lambda r: (r["n"], r["bucket"])):
            sums[:, r["n"]] += np.frombuffer(bytes(r["data"]), np.float64).reshape(GATES // 8, INPUTS, INPUTS + 1)
        weights = stepped(weights, sums.reshape(GATES, INPUTS, INPUTS + 1))
    seen = first_map()
    for r in shown.mapInArrow(_each_bit(followed, weights), X.ROWS).select("data").collect():
        seen += np.frombuffer(bytes(r["data"]), np.float64).reshape(seen.shape)
    return weights, seen


_mixers: dict[int, Mixer] = {}


def _mixer(shared, key: int, state: bytes) -> Mixer:
    if key not in _mixers:
        _mixers.clear()
        _aparts.clear()
        weights = np.frombuffer(state, np.float64, INPUTS * GATES).reshape(INPUTS, GATES)
        seen = np.frombuffer(state, np.float64, offset=weights.nbytes).reshape(2, GATES // 8, CELLS)
        _mixers[key] = Mixer(_open(shared.value), weights, seen)
    return _mixers[key]


_SPELLED = "docs binary, tokens binary, runs binary, ratios binary"


def _columns(**arrays: np.ndarray | pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in arrays.values()], list(arrays))
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return X.squeeze(sink.getvalue().to_pybytes())


def _batch(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(X.unsqueeze(data)).read_next_batch()


def _spell(shared, key: int, state: bytes, buckets: int, n: int, v: int):
    def work(answers: list[dict], body: dict) -> Iterator[pa.RecordBatch]:
        """A block's bits of words, counts of words and runs, and how its training words' ratios are spread."""
        head = _batch(body["more"])
        data, sizes, at, start, own_run = _unblock(body["data"])
        begin = np.concatenate([[0], np.cumsum(head.column("n_tokens").to_numpy())])
        places = np.cumsum(sizes) - sizes
        texts = [*places[begin[:-1]].tolist(), len(data)]
        spelled = [data[i:j] for i, j in zip(texts[:-1], texts[1:], strict=True)]
        c = np.concatenate([np.frombuffer(X.unsqueeze(r["data"]), np.int64) for r in answers if r["kind"] == 1])
        base = np.log10((c + 1) / (n + (v + 1)))
        train = ~head.column("held_out").to_numpy(zero_copy_only=False)
        again = np.repeat(train, np.diff(begin)) & (c[at] > 1)  # a word that is nowhere else has no share
        bits, apart = _mixer(shared, key, state).both(spelled, np.repeat(again, sizes))
        ratio = np.log2(np.maximum(c[at] - 1, 1) / max(1, n - 1)) + np.add.reduceat(apart, places, dtype=np.float64)
        step = np.clip(np.rint((ratio[again] + RATIO_FAR) * RATIO_STEPS), 1, 2 * RATIO_FAR * RATIO_STEPS).astype(np.int64)
        ratios = np.bincount(step, minlength=2 * RATIO_FAR * RATIO_STEPS + 1)
        ratios[0] = int(np.diff(begin)[train].sum()) - len(step)
        total = np.concatenate([np.frombuffer(X.unsqueeze(r["data"]), np.int64) for r in answers if r["kind"] == 2])
        # a run of training text is not counted where it stands itself
        times = total[own_run] - train[np.searchsorted(begin, start, "right") - 1]
        row = [
            _columns(
                doc_id=head.column("doc_id"),
                held_out=head.column("held_out"),
                n_tokens=np.diff(begin),
                n_known=np.add.reduceat((c[at] > 0).astype(np.int64), begin[:-1]),
                base=np.add.reduceat(base[at], begin[:-1]),
                n_bytes=np.add.reduceat(sizes, begin[:-1]),
                first=np.searchsorted(start, begin[:-1]),
            ),
            _columns(c=c[at], bits=np.add.reduceat(bits, places, dtype=np.float64).astype(np.float32)),
            _columns(start=start, times=times),
            X.squeeze(ratios.astype(np.int64).tobytes()),
        ]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["docs", "tokens", "runs", "ratios"])

    return work


def _finish(share: float, n: int, runs: int, again: int):
    whole_share = min(max(again / runs if runs else 0.0, 1e-6), 0.999)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, tokens, parts = (_batch(batch.column(k)[i].as_py()) for k in range(3))
                start, times = (parts.column(k).to_numpy() for k in range(2))
                c, bits = tokens.column(0).to_numpy(), tokens.column(1).to_numpy().astype(np.float64)
                with np.errstate(divide="ignore"):
                    word = np.logaddexp2(np.log2(share * c / max(1, n)), np.log2(1 - share) - bits)
                    whole = np.log2(whole_share * times / max(1, runs))
                found = np.logaddexp2(whole, np.log2(1 - whole_share) + np.add.reduceat(word, start))
                length = -np.add.reduceat(found, docs.column("first").to_numpy())
                columns = [docs.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known")]
                columns += [pa.array([n] * docs.num_rows, pa.int64()), docs.column("base"), pa.array(-length * np.log10(2)), pa.array(length / docs.column("n_bytes").to_numpy())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return run


_models = 0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """Score every whole text; learn from those whose crc32 of the id as text, modulo ``folds``, is not
    ``held_fold`` (a null id is never held out).

    Returns ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``, a
    row per input row: tokens are the lower-cased words and one end; ``base_score`` is the add-one
    unigram's log10 probability, ``score`` the mixed model's; bits are per byte of the spelling. Counts,
    weights, map and shares are of all training text. Null and empty texts are
    an end alone. Repeated rows count each time. An empty table gives no rows. Results don't depend on how
    the table is partitioned. Other columns are not read."""
    global _models
    spark: SparkSession = docs.sparkSession
    held = F.coalesce(fold(F.col(id_col), folds) == held_fold, F.lit(False))
    data = texts(docs.withColumn("__held", held), id_col, text_col, ["__held"]).select("doc_id", F.col("row.__held").alias("held_out"), "text")
    total = int(data.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = X.n_buckets(total, BUCKET_BYTES)
    narrow = max(1, buckets // 4)
    kinds = X.stored(data.mapInArrow(_ask(buckets, narrow), X.ROWS))
    told = X.stored(kinds(1).repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(_count_words(narrow), X.ROWS))
    drop_cut(kinds(1))
    settle(spark)
    counted = X.stored(X.answered(kinds(2), _count_runs))
    drop_cut(kinds(2))
    byted = X.stored(kinds(3).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count_bytes, X.ROWS))
    parts = byted(4).unionByName(told(4))
    tables = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sum_tables, X.ROWS).select("bucket", "data").collect()
    drop_cut(kinds(3))
    settle(spark)
    shared = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in tables])  # of fixed size
    n, v = _total(told(8))
    runs, again = _total(counted(8))
    small_batches(spark)
    _models += 1
    key = hash((_models, spark.sparkContext.applicationId))
    shards = narrow + buckets  # of byte contexts, and of words
    shown = byted(5).unionByName(told(6)).repartition(shards, "bucket").sortWithinPartitions("bucket")
    gathered = cut(shown.mapInArrow(_gather(shared, key), X.ROWS))
    settle(spark)
    weights, seen = _learn(gathered)
    for each in (gathered, byted(4), byted(5), told(4), told(6)):
        drop_cut(each)
    state = weights.tobytes() + seen.tobytes()
    answers = told(1).unionByName(counted(2))
    spelled = cut(X.per_block(kinds(0), answers, _spell(shared, key, state, buckets, n, v), _SPELLED))
    for each in (kinds(0), told(1), counted(2)):
        drop_cut(each)
    settle(spark)
    ratios = np.zeros(2 * RATIO_FAR * RATIO_STEPS + 1, np.int64)
    for r in spelled.select("ratios").mapInArrow(_add_ratios, "ratios binary").collect():
        ratios += np.frombuffer(bytes(r[0]), np.int64)
    return spelled.select("docs", "tokens", "runs").mapInArrow(_finish(share_of(ratios), n, runs, again), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def _add_ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sum of how the ratios are spread."""
    total = np.zeros(2 * RATIO_FAR * RATIO_STEPS + 1, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.frombuffer(X.unsqueeze(x.as_py()), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["ratios"])


def _total(rows: DataFrame) -> tuple[int, int]:
    """Sums of pairs of counts, a pair a bucket, as they come."""
    out = np.zeros(2, np.int64)
    for r in rows.select("data").toLocalIterator():
        out += np.frombuffer(bytes(r[0]), np.int64)
    return int(out[0]), int(out[1])
