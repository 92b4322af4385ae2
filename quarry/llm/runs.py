"""Periodic runs of words, found on a harmonic grid with prefix hashes.

A run of period p and of four periods at least has words equal p apart at 3p consecutive places or more,
so for each p a grid of step 3p meets it. The grids of all periods are n/3p points each, n log n in all. Whole
batches of documents are one array of word numbers with a mark of its own between any two; every (period, grid point)
pair whose words agree is extended to both sides at once by binary search over prefix hashes. What was
found is verified word by word, and a stretch found for several periods counts for the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import texts

#: Primes and bases of the two prefix hashes; (period, grid point) pairs that are looked at together.
HASHES, PAIRS = ((2147483647, 1000003), (2147483629, 998244353)), 1 << 20
#: Words and periods that a run has at least.
LEAST, PERIODS = 6, 4


def _prefix(ids: np.ndarray, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all beginnings, and powers of the base."""
    power, m, n = np.ones(len(ids) + 1, np.uint64), 1, len(ids) + 1
    while m < n:
        power[m : 2 * m] = power[: min(m, n - m)] * np.uint64(pow(base, m, prime)) % np.uint64(prime)
        m *= 2
    # sums of fewer than 2^32 values of 31 bits fit
    return np.concatenate([[0], np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * power[:-1] % np.uint64(prime))]).astype(np.uint64) % np.uint64(prime), power


class Words:
    """Word numbers of several documents, ``begin`` and ``count`` of each; what lies between is unlike anything."""

    def __init__(self, ids: np.ndarray, begin: np.ndarray, count: np.ndarray):
        self.ids, self.begin, self.count = ids, begin, count
        self.hashes = [(np.uint64(prime), *_prefix(ids, prime, base)) for prime, base in HASHES]

    @staticmethod
    def of(docs: list[list[bytes]]) -> Words:
        count = np.array([len(d) for d in docs], np.int64)
        begin = 1 + np.cumsum(count + 1) - (count + 1)
        coded = pa.array([w for d in docs for w in d], pa.binary()).dictionary_encode()
        ids = np.arange(int(count.sum()) + len(docs) + 1, dtype=np.int64) + len(coded.dictionary)
        ids[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))] = coded.indices.to_numpy()
        return Words(ids, begin, count)

    def equal(self, x: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether so many words from x on hash as those p words later."""
        same = np.ones(len(x), bool)
        for prime, h, power in self.hashes:
            here, there = h[x + size] + prime - h[x], h[x + p + size] + prime - h[x + p]
            same &= here % prime * power[p] % prime == there % prime
        return same

    def extend(self, x: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The most words after (or before) x that equal those p later, for all pairs at once."""
        low, high = np.zeros_like(most), most.copy()
        live = np.nonzero(low < high)[0]
        while len(live):
            mid = (low[live] + high[live] + 1) // 2
            ok = self.equal(x[live] - mid if back else x[live], p[live], mid)
            low[live[ok]], high[live[~ok]] = mid[ok], mid[~ok] - 1
            live = live[low[live] < high[live]]
        return low

    def candidates(self) -> np.ndarray:
        """Rows (document, begin, end, period) of stretches that are long enough, each once."""
        most = np.where(self.count >= LEAST, self.count // PERIODS, 0)
        doc = np.repeat(np.arange(len(most)), most)
        period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
        step = np.maximum(LEAST, PERIODS * period) - period
        points = (self.count[doc] - period) // step
        upto = np.cumsum(points)
        found, at = [np.empty((0, 4), np.int64)], 0
        while at < len(doc):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] - points[at] + PAIRS, "right")))
            own = np.repeat(np.arange(at, to), points[at:to])
            turn = np.arange(len(own)) - np.repeat(upto[at:to] - points[at:to] - (upto[at] - points[at]), points[at:to]) + 1
            x, p = self.begin[doc[own]] + turn * step[own] - 1, period[own]
            at = to
            # a stretch has five places at least: with the grid point a neighbour agrees
            ids = self.ids
            near = ids[x] == ids[x + p]
            own, x, p = own[near], x[near], p[near]
            near = (ids[x - 1] == ids[x - 1 + p]) | (ids[x + 1] == ids[x + 1 + p])
            own, x, p = doc[own[near]], x[near], p[near]
            begin, end = self.begin[own], self.begin[own] + self.count[own]
            left, right = self.extend(x, p, x - begin, True), self.extend(x, p, end - p - x, False)
            long = left + right + p >= np.maximum(LEAST, PERIODS * p)
            found.append(np.unique(np.stack([own, x - left, x + right + p, p], 1)[long], axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def runs(self) -> np.ndarray:
        """Rows (document, begin, end, period), by document, begin and period; begins and ends are places in ``ids``."""
        found, spoilt, keep = self.candidates(), set(), []
        groups = np.append(np.nonzero(np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(1)])[: len(found)])[0], len(found))
        for a, b in zip(groups[:-1], groups[1:], strict=True):
            doc, s, e, p = found[a]
            if (self.ids[s : e - p] != self.ids[s + p : e]).any() or (found[a:b, 3] % p).any():
                spoilt.add(int(doc))  # unlike words of equal hashes
            keep.append(a)
        found = found[keep]
        if spoilt:
            found = found[~np.isin(found[:, 0], list(spoilt))]
            found = np.concatenate([found, *(self.plain(k) for k in sorted(spoilt))])
        return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]

    def plain(self, doc: int) -> np.ndarray:
        """One document's runs without hashes, period by period."""
        begin, n, best = int(self.begin[doc]), int(self.count[doc]), {}
        ids = self.ids[begin : begin + n]
        for p in range(1, n // PERIODS + 1):
            same = np.concatenate([[False], ids[:-p] == ids[p:], [False]])
            turns = np.nonzero(same[1:] != same[:-1])[0]
            for s, e in zip(turns[::2].tolist(), (turns[1::2] + p).tolist(), strict=True):
                if e - s >= max(LEAST, PERIODS * p):
                    best.setdefault((s, e), p)
        return np.array([(doc, begin + s, begin + e, p) for (s, e), p in best.items()], np.int64).reshape(-1, 4)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = [x.split() for x in batch.column("text").to_pylist()]  # bytes split at 9 to 13 and 32
        words = Words.of(docs)
        found = words.runs()
        doc, s, e, p = found.T
        cover = np.zeros(len(words.ids) + 1, np.int64)
        np.add.at(cover, s + p, 1)
        np.add.at(cover, e, -1)
        stays = np.cumsum(cover) == 0
        cuts = np.searchsorted(doc, np.arange(len(docs) + 1))
        kept = []
        for k, own in enumerate(docs):
            b = words.begin[k]
            kept.append(b" ".join(own if cuts[k] == cuts[k + 1] else compress(own, stays[b : b + len(own)].tolist())))
        values = pa.StructArray.from_arrays([pa.array(v) for v in (s - words.begin[doc], e - s, p)], fields=list(_RUN))
        runs = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.count), runs, pa.array(kept, pa.binary())], ["doc_id", "n_words", "runs", "kept"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs array<struct<start, length, period>>, kept string)``.

    A run is a stretch of words with smallest period q, words q apart being the same, of 6 words and 4q at least, that no
    neighbouring word extends. ``runs`` has all of them by start and period, starts being word numbers from 0; ``kept`` is the
    text without the words that some run has after its first period, one space between words. Words are what stands
    between bytes 9 to 13 and 32. A narrow pass: each row is answered by itself, so repeated rows and null ids
    stay; null and empty texts have no word and no run; texts of any length are searched whole. Other columns aren't read;
    an empty table gives no rows."""
    found = texts(docs, id_col, text_col).mapInArrow(_search, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary")
    return found.withColumn("kept", F.col("kept").cast("string"))


def strongest(runs: Column) -> Column:
    """The run of the greatest length by period, by whole numbers; of equal ones that of the smallest start, then period."""

    def before(a: Column, b: Column) -> Column:
        gain = a["length"] * b["period"] - b["length"] * a["period"]
        return F.when(gain != 0, -F.signum(gain)).otherwise(F.signum(F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"]))).cast("int")

    return F.get(F.array_sort(runs, before), F.lit(0))


def with_loops(doc_id: Column, text: Column) -> Column:
    """Texts of which every tenth, by the id's crc32, goes round in a loop from some word on: what op11 is measured on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def looped(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        turns = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(turns, F.lit(1), n - a)), " ")

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    once = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, looped(w)).otherwise(""))
    return F.when(h % 10 == 0, F.get(once, F.lit(0))).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """A row per document: how many runs, the strongest, and SHA-256 of the runs' list and of the kept words."""
    best = found.withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    own = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("1000 * best.length div best.period")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *own, exponent.alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB: each byte is followed by eight shifts."""
    bits = ", ".join(["-1"] * 8)
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(substr({text}, i, 1))::BIGINT, {bits}]))), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT)"


#: DuckDB's version: all pairs of equal words of a document, and the islands among those of one distance.
SQL = rf"""
WITH h AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents),
a AS (SELECT doc_id, ws, h, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM p),
t AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(ws) AS word FROM d),
e AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e),
s AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM g GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
r AS MATERIALIZED (SELECT doc_id, start, length, min(p) AS period FROM s GROUP BY doc_id, start, length),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS list FROM r GROUP BY doc_id),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DECIMAL(38, 0) * 1000000000000 // period DESC, start, period) AS k FROM r),
gone AS (SELECT DISTINCT t.doc_id, t.i FROM t JOIN r ON t.doc_id = r.doc_id AND t.i >= start + period AND t.i < start + length),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT t.doc_id, t.i, word FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i WHERE gone.i IS NULL) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN b ON d.doc_id = b.doc_id AND b.k = 1 LEFT JOIN k ON d.doc_id = k.doc_id
"""
