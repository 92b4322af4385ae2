"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: how often each byte followed each context of up
to ``order`` bytes in its training texts. A byte costs the code length of its probability in
the longest context that knows it, and of the escapes (method C) from the longer ones that
don't. With frozen statistics the cost of a byte depends only on the bytes before it, so the
cost of each (order + 1)-gram is worked out once and kept; a text's code length is the sum
over its bytes, under each language. The shortest code names the language.

The trees count every training text whole: tasks count their texts' grams, buckets add them up. As the trees
are sent to every worker, contexts share slots by their hash once there are more than GRAMS grams; no count
is left out then. All texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quarry.llm import exchange as X
from quarry.llm.common import cut, fold, small_batches
from quarry.llm.windows import mixed

#: Longest context in bytes; for callers who ask for a sample: training bytes of a language, about, and of all
#: languages together. The queries learn from all texts.
ORDER, SAMPLE_BYTES, TOTAL_BYTES = 4, 1 << 20, 16 << 20
#: Grams of all lengths and languages up to which each context has its own counts; bits of a context's slot that
#: are tried beyond. Bytes of training text for a bucket; grams that a task holds before it sends them.
GRAMS, SLOT_BITS, BUCKET_BYTES, HELD = 1 << 21, (32, 24, 22, 20, 18, 16, 14, 12, 10, 8, 6, 4, 2, 1), 32 << 20, 4_000_000
#: Languages up to which tables of a row for each are broadcast; beyond, they are joined by a shuffle.
FEW = 1 << 16
#: Robust deviations over the median cost of held-out texts with a label, and bits more for a text of any length,
#: beyond which no language explains a text; steps of a bit in which these costs are told apart.
DEVIATIONS, SLACK_BITS, COST_STEPS = 10.0, 256.0, 4096
_LETTER = regex.compile(r"\p{L}").search
_ASCII_LETTERS = bytes([*range(65, 91), *range(97, 123)])
#: Costs that a worker keeps, of grams in all languages: a direct-mapped table.
KEPT = 1 << 20


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each byte, as a number: bytes before the text are zeros."""
    out = np.zeros(len(data), np.uint64)
    for k in range(min(n, len(data))):
        out[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return out


def count_grams(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n from 1 to order + 1, the n-grams and how often they occur."""
    held = [grams(np.frombuffer(t, np.uint8), order + 1) for t in texts if t]
    full = np.concatenate(held) if held else np.zeros(0, np.uint64)
    return [np.unique(full & np.uint64((1 << 8 * n) - 1), return_counts=True) for n in range(1, order + 2)]


def slots(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """n-grams by their context's slot of so many bits, a context itself where it has no more; symbols stay."""
    if 8 * (n - 1) <= bits:
        return keys
    return mixed(keys >> np.uint64(8), 70 + n) >> np.uint64(64 - bits) << np.uint64(8) | keys & np.uint64(255)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.nonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))[0]
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


class Tree:
    """One language's context tree: for each context length the symbols that followed each context (:func:`slots`)."""

    def __init__(self, order: int, counts: list[tuple[np.ndarray, np.ndarray]], bits: int = SLOT_BITS[0]):
        self.order, self.bits = order, bits
        self.levels = []
        for keys, count in counts:  # keys hold context and symbol, the symbol in the low byte
            ctx, first = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(count, first) if len(keys) else count
            distinct = np.diff(np.append(first, len(keys)))
            self.levels.append((keys, count, ctx, total, distinct))

    def cost(self, full: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each (order + 1)-gram, given the bytes before it."""
        bits = np.zeros(len(full))
        open_ = np.arange(len(full))
        for n in range(self.order, -1, -1):
            keys, count, ctx, total, distinct = self.levels[n]
            if not len(keys) or not len(open_):
                continue
            gram = slots(full[open_] & np.uint64((1 << 8 * (n + 1)) - 1), n + 1, self.bits)
            at = np.minimum(np.searchsorted(ctx, gram >> np.uint64(8)), len(ctx) - 1)
            met = ctx[at] == gram >> np.uint64(8)
            size = (total[at] + distinct[at]).astype(float)
            sym = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            hit = keys[sym] == gram
            bits[open_[hit]] += np.log2(size[hit] / count[sym[hit]])
            out = met & ~hit
            bits[open_[out]] += np.log2(size[out] / distinct[at[out]])  # the escape
            open_ = open_[~hit]
        bits[open_] += 8.0  # a byte never met: one of 256
        return bits


class Model:
    """The languages' trees."""

    def __init__(self, order: int, trees: dict[str, Tree]):
        self.order, self.langs = order, sorted(trees)
        self.trees = [trees[x] for x in self.langs]

    def costs(self, full: np.ndarray) -> np.ndarray:
        return np.stack([t.cost(full) for t in self.trees], 1) if self.trees else np.zeros((len(full), 0))


class Scorer:
    """Code lengths of texts, with the costs of the grams met lately kept at hand."""

    def __init__(self, model: Model):
        self.model = model
        self.bits = max(10, (KEPT // max(1, len(model.langs))).bit_length() - 1)
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.kept = np.zeros((1 << self.bits, len(model.langs)))

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): bits of each whole text. Sums run over each text alone and in its own
        order, so equal texts get equal values."""
        out = np.zeros((len(texts), len(self.model.langs)))
        for k, t in enumerate(texts):
            for i in range(0, len(t), 1 << 16):
                before = max(0, i - self.model.order)
                part = np.frombuffer(t, np.uint8)[before : i + (1 << 16)]
                out[k] += self._costs(grams(part, self.model.order + 1)[i - before :]).sum(axis=0)
        return out

    def _costs(self, full: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            slot = (full * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        miss = self.keys[slot] != full
        if miss.any():
            new, at = np.unique(full[miss], return_inverse=True)
            costs = self.model.costs(new)
            with np.errstate(over="ignore"):
                own = (new * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
            found = self.kept[slot]
            found[miss] = costs[at]
            own, pick = np.unique(own, return_index=True)  # one of those that share a slot
            self.keys[own], self.kept[own] = new[pick], costs[pick]
            return found
        return self.kept[slot]


def has_letter(text: bytes) -> bool:
    return len(text) != len(text.translate(None, _ASCII_LETTERS)) or (not text.isascii() and _LETTER(text.decode()) is not None)


_scorers: dict[int, Scorer] = {}


def _predict(shared, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared, key)
        langs = scorer.model.langs
        for batch in batches:
            pred: list[str] = []
            score: list[float] = []
            bits: list[float | None] = []
            for at in range(0, batch.num_rows, 256):
                texts = [x or b"" for x in batch.column(1).slice(at, 256).to_pylist()]
                known = [bool(langs) and has_letter(t) for t in texts]
                lengths = scorer.lengths([t if k else b"" for t, k in zip(texts, known, strict=True)])
                for t, k, row in zip(texts, known, lengths, strict=True):
                    best = int(row.argmin()) if k else 0
                    pred.append(langs[best] if k else "und")
                    score.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000.0)).sum()) if k else 0.0)
                    bits.append(float(row[best]) / len(t) if k else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return run


def _count(order: int, buckets: int):
    """A task's (order + 1)-grams of each language with counts, for their buckets: those whose contexts end in the
    same two bytes meet in one."""

    def send(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, counts = added(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            bucket = (mixed(keys >> np.uint64(8) & np.uint64(0xFFFF), 69) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1)).tolist()
            for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if j > i:
                    yield _grams([(lang, k, keys[by[i:j]], counts[by[i:j]])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, list[np.ndarray]] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = n_held = 0

        def close() -> int:
            new = 0
            for lang, texts in open_.items():
                keys, counts = np.unique(np.concatenate(texts), return_counts=True)
                held.setdefault(lang, []).append((keys, counts))
                new += len(keys)
            open_.clear()
            return new

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i in range(0, len(text), 1 << 20):
                    before = max(0, i - order)
                    part = grams(np.frombuffer(text, np.uint8)[before : i + (1 << 20)], order + 1)[i - before :]
                    open_.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= 1 << 21:
                        n_held, size = n_held + close(), 0
                        if n_held > HELD:
                            held = {x: [added(*(np.concatenate(y) for y in zip(*parts, strict=True)))] for x, parts in held.items()}
                            n_held = sum(len(parts[0][0]) for parts in held.values())
                            if n_held > HELD // 2:
                                yield from send(held)
                                held, n_held = {}, 0
        close()
        yield from send(held)

    return run


_GRAMS = "lang string, n int, data binary, more binary"


def _grams(rows: list[tuple[str, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    lang, n, keys, counts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array([X.pack(x) for x in keys], pa.binary()), pa.array([X.squeeze(x.astype(np.int64).tobytes()) for x in counts], pa.binary())], ["lang", "n", "data", "more"])


def _unpacked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([X.unpack(r["data"]) for r in rows]), np.concatenate([np.frombuffer(X.unsqueeze(r["more"]), np.int64) for r in rows])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's grams of a language, added up over all tasks."""
    for own in X.grouped(batches, "place"):
        yield _grams([(own[0]["lang"], own[0]["n"], *added(*_unpacked(own)))])


def _levels(order: int, bits: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams of each length, their contexts in slots."""
    return [added(slots(keys & np.uint64((1 << 8 * n) - 1), n, bits), counts) for n in range(1, order + 2)]


def _sizes(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many grams a bucket has for each number of bits."""
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = _unpacked([row])
                n = [sum(len(k) for k, _ in _levels(order, bits, keys, counts)) for bits in SLOT_BITS]
                yield pa.RecordBatch.from_arrays([pa.array(SLOT_BITS, pa.int32()), pa.array(n, pa.int64())], ["bits", "grams"])

    return run


def _in_slots(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _grams([(row["lang"], n, *level) for n, level in enumerate(_levels(order, bits, *_unpacked([row])))])

    return run


def _sampled(rows: DataFrame, sample_bytes: int, total_bytes: int) -> DataFrame:
    """Of each language the texts of the smallest hashes until ``sample_bytes`` bytes are reached, or an equal share of
    ``total_bytes`` where there are many languages; at least one text, and of a longer one so many bytes. Rows of one
    id and text count once."""
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("total"), F.count("*").alias("n"))
    n = sizes.count()
    budget = max(1, min(sample_bytes, total_bytes // max(1, n)))
    small = F.broadcast if n <= FEW else lambda df: df  # a row per language
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # several times the sample, and some dozens of texts at least: in these it is found, whatever the table's size
    wide = F.greatest(F.lit(4.0 * budget) / F.greatest("total", F.lit(1)), F.lit(64.0) / F.col("n"))
    first = rows.select("lang", draw.alias("draw"), F.least(F.octet_length("text"), F.lit(budget)).alias("bytes")).join(small(sizes), "lang").where(F.col("draw") < wide).select("lang", "draw", "bytes").distinct()
    before = F.sum("bytes").over(Window.partitionBy("lang").orderBy("draw").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes")
    upto = first.withColumn("before", before).where(F.col("before") < budget).groupBy("lang").agg(F.max("draw").alias("upto"))
    picked = rows.join(small(upto), "lang").where(draw <= F.col("upto")).select("lang", draw.alias("draw"), F.substring("text", 1, budget).alias("text"))
    return picked.dropDuplicates(["lang", "draw"]).select("lang", "text")


def train(rows: DataFrame, order: int = ORDER, sample_bytes: int | None = None, total_bytes: int = TOTAL_BYTES, most: int = GRAMS) -> Model:
    """Trees of the ``(doc_id, lang, text binary)`` rows, of every text with a label; repeated rows count each time.
    Beyond ``most`` grams contexts share slots, of as many bits as keep to it. With ``sample_bytes`` only of a
    sample (:func:`_sampled`)."""
    rows = rows.where("lang is not null and text is not null")
    rows = rows.select("lang", "text") if sample_bytes is None else _sampled(rows, sample_bytes, total_bytes)
    total = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    counts = rows.mapInArrow(_count(order, X.n_buckets(total, BUCKET_BYTES)), _GRAMS).withColumn("place", F.struct("lang", "n"))
    counts = cut(counts.repartition("lang", "n").sortWithinPartitions("lang", "n").mapInArrow(_add_up, _GRAMS))
    sizes = {r["bits"]: r["grams"] for r in counts.mapInArrow(_sizes(order), "bits int, grams long").groupBy("bits").agg(F.sum("grams").alias("grams")).collect()}
    bits = next((b for b in SLOT_BITS if sizes.get(b, 0) <= most), SLOT_BITS[-1])
    found: dict[str, list[list[dict]]] = {}
    for r in counts.mapInArrow(_in_slots(order, bits), _GRAMS).collect():  # bounded by most
        found.setdefault(r["lang"], [[] for _ in range(order + 1)])[r["n"]].append(r)
    return Model(order, {lang: Tree(order, [added(*_unpacked(level)) for level in levels], bits) for lang, levels in found.items()})


_models = 0


def _share(spark: SparkSession, model: Model) -> tuple:
    """The model for the workers, and a name that no other has."""
    global _models
    _models += 1
    return spark.sparkContext.broadcast(model), hash((_models, spark.sparkContext.applicationId))


def _scorer(shared, key: int) -> Scorer:
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(shared.value)
    return _scorers[key]


def _default_fold(col: Column) -> Column:
    return F.coalesce(fold(col, 4) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, order: int = ORDER, sample_bytes: int | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, bits_per_byte)``, a row per input row.

    Learns from all rows with a label that are not held out (by default crc32 of the id as text,
    modulo 4, is 2; a null id is never held out), from a sample of them with ``sample_bytes``. ``lang_pred`` is ``und``, with score 0, for a text
    that is null or has no letter, or when there is nothing to learn from; else the language of
    the shortest code, ties going to the first by name. ``score`` is its share of the probability of the
    text. Equal texts get equal results. Other columns are not read."""
    small_batches(docs.sparkSession)
    held = _default_fold(F.col(id_col)) if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"), held.alias("held_out"))
    model = train(rows.where("not held_out"), order, sample_bytes)
    shared = _share(docs.sparkSession, model)
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predict(*shared), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def usual_cost(costs: DataFrame) -> float:
    """Bits a byte beyond which a text is none of the languages': DEVIATIONS robust deviations over the median of the
    ``bits_per_byte`` of texts in them, by all of these in steps; no bound without such texts."""
    found = costs.select(F.percentile(F.round(F.col("bits_per_byte") * COST_STEPS) / COST_STEPS, [0.25, 0.5, 0.75])).first()[0]
    if found is None:
        return float("inf")
    low, middle, high = found
    return float(middle + DEVIATIONS * max((high - low) / 1.349, 0.08 * middle))


def _cost_rows(shared, key: int, at: int):
    """Beside each row the bits of its text's shortest code (null without a letter) and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared, key)
        for batch in batches:
            texts = [x or b"" for x in batch.column(0).field(at).cast(pa.binary()).to_pylist()]
            bits: list[float | None] = []
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                known = [bool(scorer.model.langs) and has_letter(t) for t in part]
                lengths = scorer.lengths([t if k else b"" for t, k in zip(part, known, strict=True)])
                bits += [float(row.min()) if k else None for k, row in zip(known, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.float64()), pa.array(map(len, texts), pa.int64())], ["row", "held", "bits", "n_bytes"])

    return run


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_bytes: int | None = None) -> DataFrame:
    """The rows, with all their columns, whose text a learned language explains. Texts go that are null or have no
    letter, and those whose shortest code is longer than SLACK_BITS and, for each byte, what held-out texts
    with a label hardly ever cost (:func:`usual_cost`, of all of them). Learns as :func:`identify` does; with nothing to
    learn from all rows go. Texts are scored once; rows and costs are stored until the bound is known."""
    small_batches(docs.sparkSession)
    label, held = F.col(lang_col).cast("string"), _default_fold(F.col(id_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), label.alias("lang"), held.alias("held"))
    shared = _share(docs.sparkSession, train(rows.where("not held"), order, sample_bytes))
    whole = docs.select(F.struct(*docs.columns).alias("row"), (held & label.isNotNull()).alias("held"))
    costs = cut(whole.mapInArrow(_cost_rows(*shared, docs.columns.index(text_col)), StructType([*whole.schema.fields, StructField("bits", DoubleType()), StructField("n_bytes", LongType())])))
    most = usual_cost(costs.where("held and bits is not null").select((F.col("bits") / F.col("n_bytes")).alias("bits_per_byte")))
    return costs.where(F.col("bits") <= F.lit(most) * F.col("n_bytes") + SLACK_BITS).select("row.*")
