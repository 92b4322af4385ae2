"""Language identification and language-model scores."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from testdata import SF

from quarry.llm import langid, mixing
from quarry.llm.common import cut
from quarry.llm.queries import QUERIES


def plain_cost(texts: list[bytes], text: bytes, order: int) -> float:
    count = [defaultdict(Counter) for _ in range(order + 1)]
    pad = b"\0" * order
    for t in texts:
        for k in range(len(t)):
            for n in range(order + 1):
                count[n][(pad + t)[k + order - n : k + order]][t[k]] += 1
    bits = 0.0
    for k, c in enumerate(text):
        for n in range(order, -1, -1):
            seen = count[n].get((pad + text)[k + order - n : k + order])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if c in seen:
                bits += math.log2(total / seen[c])
                break
            bits += math.log2(total / len(seen))
        else:
            bits += 8
    return bits


def test_ppm_cost():
    texts, text = [b"the cat sat on the mat", b"that hat", "né".encode()], "the rat sat; é!".encode()
    tree = langid.Tree(3, langid.count_grams(texts, 3))
    scorer = langid.Scorer(langid.Model(3, {"en": tree}))
    assert math.isclose(scorer.lengths([text])[0, 0], plain_cost(texts, text, 3), rel_tol=1e-9)
    assert math.isclose(scorer.lengths([text, b""])[0, 0], plain_cost(texts, text, 3), rel_tol=1e-9)
    assert scorer.lengths([b""])[0, 0] == 0


def test_languages(spark):
    got = QUERIES["op3_languages"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(docs):
    base = [(k, "the and of with house " * 5, "en", 1) for k in range(8)] + [(k + 20, "der und die mit haus " * 5, "de", 1) for k in range(8)]
    rows = [*base, (50, None, "en", 1), (51, "123 !?", "en", 1), (52, "das haus und die", None, 1), (None, "of the house", None, 1), (53, "é", None, 1), (54, "", "xx", 1), (55, "the house " * 20000, None, 1)]
    got = langid.identify(docs(rows, ", lang string, score int")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[50].lang_pred, by[51].lang_pred, by[54].lang_pred) == ("und", "und", "und")
    assert (by[52].lang_pred, by[None].lang_pred, by[55].lang_pred) == ("de", "en", "en")
    assert len({r.score for r in got if r.doc_id in (50, 51, 54)}) == 1
    assert langid.identify(docs([], ", lang string")).count() == 0
    assert {r.lang_pred for r in langid.identify(docs([(1, "abc", None)], ", lang string")).collect()} == {"und"}
    kept = langid.keep_identified(docs(rows, ", lang string, score int"))
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    assert {r.doc_id for r in kept.collect()} | {55} == {r.doc_id for r in got if r.lang_pred != "und"}


def test_language_of_few_long_texts(docs):
    rows = [(k, "the and of with house " * 100, "en") for k in range(20)] + [(k + 20, "der und die mit haus " * 100, "de") for k in range(20)]
    got = langid.identify(docs(rows, ", lang string"), sample_bytes=200).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang in rows}


def test_scores(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    rows = {r.doc_id: r for r in QUERIES["op1_mixing"](spark, SF).collect()}
    assert len(rows) == len(words)
    for i, ws in words.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def test_score_edges(docs):
    rows = [(1, "a b a c", 0), (2, None, 0), (3, "", 0), (None, "a b", 0), (1, "a b a c", 0), (5, "x" * 70000, 0), (6, "A B A C", 0)]
    got = mixing.score(docs(rows, ", score int")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(rows)
    assert by[2][0].n_tokens == by[3][0].n_tokens == 1
    assert by[2][0].score == by[3][0].score
    assert not by[None][0].held_out
    assert all(math.isfinite(r.score) for r in got)
    assert mixing.score(docs([])).count() == 0


def plain_bits(text: bytes, counts: dict, weights: np.ndarray) -> float:
    """Bits of a text with exact counts of each context, one bit after another."""
    total, inside = 0.0, b""
    for at, byte in enumerate(text):
        before = text[max(0, at - 5) : at]
        keys = [(k, before[-k:].rjust(k, b"\0")) for k in range(1, 6)] + [("word", inside)]
        for k in range(8):
            bit, node = byte >> (7 - k) & 1, (k, byte >> (8 - k))
            x = []
            for key in keys:
                zeros, ones = counts.get((key, node), (0, 0))
                v = round(10 * (math.log(ones + 0.4) - math.log(zeros + 0.4)))
                x.append((1 if not v and zeros + ones else max(-127, min(127, v))) / 10)
            gate = (sum(v != 0 for v in x[:5]) * 2 + (x[5] != 0)) * 8 + k
            z = sum(w * v for w, v in zip(weights[:, gate], [*x, 0.3], strict=True))
            z = max(-mixing.FAR, min(mixing.FAR, z))
            z = math.floor((z + mixing.FAR) * mixing.STEPS + 0.5) / mixing.STEPS - mixing.FAR
            p = min(1 - 1e-6, max(1e-6, 1 / (1 + math.exp(-z))))
            total -= math.log2(p if bit else 1 - p)
        inside = b"" if byte == 32 else inside + bytes([byte])
    return total


def test_mixed_bits():
    texts = [mixing.spelling(t.lower().split()) for t in (b"the cat sat on the mat", b"The hat, that cat", "né à la mer".encode(), b"")]
    counts: dict = defaultdict(lambda: [0, 0])
    for text in texts:
        inside = b""
        for at, byte in enumerate(text):
            before = text[max(0, at - 5) : at]
            for key in [(k, before[-k:].rjust(k, b"\0")) for k in range(1, 6)] + [("word", inside)]:
                for k in range(8):
                    counts[key, (k, byte >> (8 - k))][byte >> (7 - k) & 1] += 1
            inside = b"" if byte == 32 else inside + bytes([byte])
    tables = [mixing.new_table(o) for o in range(mixing.TABLES)]
    for context, word, byte in mixing.contexts(texts):
        for o, table in enumerate(tables):
            mixing.add_counts(table, o, mixing._hash(o, context, word), byte, np.ones(len(byte)))
    weights = mixing.first_weights()
    mixer = mixing.Mixer([t.T for t in tables], weights, mixing.first_map())
    for text in [*texts, mixing.spelling([b"the", b"rat", b"sat"]), mixing.spelling(["mère".encode()])]:
        assert math.isclose(mixer.bits([text]).sum(), plain_bits(text, counts, weights), rel_tol=2e-3)
        assert math.isclose(mixer.bits([text]).sum(), mixer.bits([text, text])[: len(text)].sum(), rel_tol=1e-6)


def test_mixed_bytes_share_one():
    """After any text the costs of all next bytes add up to one."""
    texts = [mixing.spelling(b"one two three two one".split())]
    tables = [mixing.new_table(o) for o in range(mixing.TABLES)]
    for context, word, byte in mixing.contexts(texts):
        for o, table in enumerate(tables):
            mixing.add_counts(table, o, mixing._hash(o, context, word), byte, np.ones(len(byte)))
    mixer = mixing.Mixer([t.T for t in tables], mixing.first_weights(), mixing.first_map())
    context, word, _ = next(mixing.contexts([b"one tw?"]))
    every = np.arange(256, dtype=np.uint8)
    assert math.isclose(np.exp2(-mixer.costs(np.repeat(context[-1:], 256), np.repeat(word[-1:], 256), every).astype(float)).sum(), 1, rel_tol=1e-4)


def test_scores_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few, many = ({r.doc_id: (r.score, r.base_score) for r in mixing.score(docs.repartition(n)).collect()} for n in (4, 32))
    assert few.keys() == many.keys()
    assert all(math.isclose(x, y, rel_tol=1e-9) for i in few for x, y in zip(few[i], many[i], strict=True))


def test_languages_by_brute_force(spark):
    rows = [(r.doc_id, (r.text or "").encode(), r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    own: dict = defaultdict(list)
    for i, t, lang in rows:
        if not held[i] and lang is not None:
            own[lang].append(t)
    assert all(sum(map(len, x)) < langid.SAMPLE_BYTES for x in own.values())  # all is learnt from
    got = {r.doc_id: r for r in QUERIES["op3_languages"](spark, SF).collect()}
    short = sorted((len(t), i, t) for i, t, _ in rows if held[i] and langid.has_letter(t))[:12]
    langs = sorted(own)
    for _, i, t in short:
        costs = [plain_cost(own[x], t, langid.ORDER) for x in langs]
        best = int(np.argmin(costs))
        assert got[i].lang_pred == langs[best]
        assert math.isclose(got[i].score, 1 / sum(2.0 ** max(-1000.0, costs[best] - c) for c in costs), rel_tol=1e-6)


def test_many_languages(docs):
    rows = [(k, f"word{k} of the tongue {k} " * 3, f"l{k}") for k in range(300)] + [(k, "xyz " * 5000, "long") for k in range(900, 904)]
    got = langid.identify(docs(rows, ", lang string"), sample_bytes=300).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got} <= {x[2] for x in rows}
    assert {r.lang_pred for r in got if r.doc_id >= 900} == {"long"}


def test_rejected_texts(docs):
    rows = [(k, f"the house and the garden of a man number {k % 9} is near the river " * 4, "en") for k in range(200)]
    rows += [(1000, "".join(chr(33 + (k * k * 7 + k * 13) % 90) for k in range(4000)), None), (1001, "A.", None), (None, "the house", "en"), (1002, None, "en"), (1000, "the garden", None)]
    kept = [(r.doc_id, r.text) for r in langid.keep_identified(docs([(*r, 0) for r in rows], ", lang string, bits int")).collect()]
    assert len(kept) == len(rows) - 2
    assert (1000, "the garden") in kept
    assert (1001, "A.") in kept


def test_a_language_of_repeated_rows_is_learnt(docs):
    """Copies of one row are one text of the sample, also if they fill its budget many times."""
    english, german = "the quick brown fox jumps over the lazy dog and runs away from the farm again " * 2, "der schnelle braune fuchs springt über den faulen hund und läuft wieder vom hof weg "
    rows = [(1, english, "en")] * 5 + [(k, german + str(k), "de") for k in (4, 5, 9, 12)]
    got = langid.identify(docs(rows, ", lang string"), held_out=F.lit(False), sample_bytes=200).collect()
    assert {(r.doc_id, r.lang_pred) for r in got} == {(1, "en"), *((k, "de") for k in (4, 5, 9, 12))}


def labelled(docs, rows):
    return docs(rows, ", lang string").select("doc_id", "lang", F.col("text").cast("binary").alias("text"))


def test_every_training_text_is_learnt(docs):
    """More than the bytes of the sample of before, and a byte that one text alone has."""
    rows = [(k, f"word{k % 7} of the house " * 4000, "en") for k in range(16)] + [(99, "only here: Ω", "en"), (99, "only here: Ω", "en")]
    model = langid.train(labelled(docs, rows))
    keys, counts = model.trees[0].levels[0][:2]
    every = b"".join(t.encode() for _, t, _ in rows)
    assert len(every) > langid.SAMPLE_BYTES
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == Counter(every)
    plain = langid.Tree(langid.ORDER, langid.count_grams([t.encode() for _, t, _ in rows], langid.ORDER))
    for found, true in zip(model.trees[0].levels, plain.levels, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(found, true, strict=True))


def test_many_contexts_share_slots_but_lose_no_count(docs):
    rows = [(k, " ".join(f"{k * k * j % 9973}{w}" for j in range(300) for w in ("the", "house")), "en") for k in range(9)]
    rows += [(k, " ".join(f"{k * j % 9973}{w}" for j in range(300) for w in ("das", "haus")), "de") for k in range(9)]
    model = langid.train(labelled(docs, rows), most=6000)
    size = {lang: sum(len(t) for _, t, x in rows if x == lang) for lang in ("de", "en")}
    assert model.trees[0].bits < langid.SLOT_BITS[0]
    for lang, tree in zip(model.langs, model.trees, strict=True):
        assert [int(level[1].sum()) for level in tree.levels] == [size[lang]] * (langid.ORDER + 1)
    assert sum(len(level[0]) for tree in model.trees for level in tree.levels) <= 6000
    lengths = langid.Scorer(model).lengths([b"the house in the 99house", b"das haus und 77das"])
    assert lengths.argmin(axis=1).tolist() == [1, 0]


def test_bound_by_all_held_out_texts(spark):
    """The quartiles of all costs, not of the first 256 KB of them."""
    costs = [(k * 37 % 4001) / 1000 for k in range(4001)]
    got = langid.usual_cost(spark.createDataFrame([(x,) for x in costs], "bits_per_byte double"))
    low, middle, high = np.percentile(costs, [25, 50, 75])
    assert math.isclose(got, middle + langid.DEVIATIONS * max((high - low) / 1.349, 0.08 * middle), abs_tol=0.01)
    assert langid.usual_cost(spark.createDataFrame([], "bits_per_byte double")) == float("inf")


def test_every_bit_of_training_text_is_an_example():
    """Byte contexts and words of buckets together show each byte once, with the inputs that it has in its text; the
    weights are best for all of them."""
    texts = [f"the cat{k * k % 97} sat on the interesting mat, extraordinarily {'né à la mer ' * (k % 5)}" for k in range(400)]
    words = [t.encode().lower().split() for t in texts]
    spelled = [mixing.spelling(w) for w in words]
    tables = [mixing.new_table(o) for o in range(mixing.TABLES)]
    whole = list(mixing.contexts(spelled))
    for context, word, byte in whole:
        for o, table in enumerate(tables):
            mixing.add_counts(table, o, mixing._hash(o, context, word), byte, np.ones(len(byte)))
    apart = [mixing.apart_odds(t.T) for t in tables]
    plain = mixing.examples(apart, iter([(c, w, b, np.ones(len(b), np.int64)) for c, w, b in whole]))
    keys, counts = mixing._byte_keys(spelled)
    own = mixing._begins((keys >> np.uint64(8) << np.uint64(24)).byteswap())
    long = Counter(w for ws in words for w in ws if len(w) >= 5)
    group = [
        {"kind": 5, "data": mixing.X.pack(keys[own]), "more": mixing.X.squeeze(counts[own].tobytes())},
        {"kind": 6, "data": mixing.X.squeeze(b"\n".join(long)), "more": mixing.X.squeeze(np.array([*long.values()], np.int64).tobytes())},
    ]
    found = mixing.examples(apart, mixing._parts(group))
    for k in range(8):
        assert int(found[k][1].sum()) == sum(map(len, spelled))
        assert all(np.array_equal(x, y) for x, y in zip(found[k], plain[k], strict=True))
    weights = mixing.first_weights()
    cost = []
    for _ in range(mixing.ROUNDS):
        sums = np.stack([mixing.slopes(k, *found[k], weights) for k in range(8)], 1).reshape(mixing.GATES, mixing.INPUTS, -1)
        weights = mixing.stepped(weights, sums)
        seen = sum(mixing.followed(k, *found[k], weights) for k in range(8))
        assert seen.sum() == 8 * sum(map(len, spelled))
        cost.append(float(mixing.Mixer([t.T for t in tables], weights, seen).both(spelled, np.ones(sum(map(len, spelled)), bool))[1].sum()))
    first = mixing.Mixer([t.T for t in tables], mixing.first_weights(), mixing.first_map())
    assert cost[-1] < first.both(spelled, np.ones(sum(map(len, spelled)), bool))[1].sum()


def test_learning_leaves_nothing_on_disk(spark, tmp_path, monkeypatch):
    """Examples are written once, without a shuffle of them, and go when the weights are learnt: only what the scores are
    made of stays."""
    for module in ("common", "exchange"):
        monkeypatch.setattr(f"quarry.llm.{module}.shared_dir", lambda _: tmp_path.as_uri())
    plans = []
    monkeypatch.setattr(mixing, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    got = mixing.score(spark.read.parquet(f"{SF}/documents.parquet"))
    gathered = plans[0]
    assert gathered.count("MapInArrow") == 1 and "Exchange" not in gathered[: gathered.index("MapInArrow")]
    left = {p.parent.name.split("-")[0] + "/" + p.name.split("-")[0] for p in tmp_path.rglob("*") if p.is_dir()}
    assert not left & {f"kinds/kind={k}" for k in (0, 1, 3, 4, 5, 6)}
    assert len(list(tmp_path.glob("cut-*"))) == 1
    assert got.count() > 0


def test_sums_of_any_counts():
    """Counts of more than 15 bits are summed as the others."""
    rng = np.random.default_rng(1)
    for most in (2, 1 << 15, 1 << 40):
        keys = rng.integers(0, 500, 4000).astype(np.uint64) * np.uint64((1 << 49) // 500)
        counts = np.where(rng.random(4000) < 0.9, rng.integers(1, 3, 4000), rng.integers(1, most + 1, 4000))
        want = Counter()
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            want[k] += n
        got = mixing._sums(keys, counts)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == sorted(want.items())
    lone = mixing._sums(np.array([7, 3, 7], np.uint64), np.array([1 << 20, 1 << 20, 1 << 20]))
    assert [x.tolist() for x in lone] == [[3, 7], [1 << 20, 1 << 21]]


def test_slopes_by_hand():
    """Each example's slope and curvature, one by one; chunks of one level lose none."""
    rng = np.random.default_rng(2)
    raw = rng.integers(-127, 128, (3 * mixing.CHUNK, 8)).astype(np.int8)
    raw[:, : mixing.TABLES] *= rng.random((len(raw), mixing.TABLES)) < 0.7
    raw[:, 6], raw[:, 7] = rng.integers(0, 2, len(raw)), 0
    keys, counts = mixing._levelled(*mixing._sums(raw.view(np.uint64).ravel(), rng.integers(1, 9, len(raw))))
    weights, k = mixing.first_weights() + rng.random((mixing.INPUTS, mixing.GATES)) / 10, 3
    want, level = np.zeros((mixing.GATES // 8, mixing.INPUTS, mixing.INPUTS + 1)), []
    for row, n in zip(keys.view(np.int8).reshape(-1, 8).tolist(), counts.tolist(), strict=True):
        g = sum(v != 0 for v in row[:5]) * 2 + (row[5] != 0)
        x = np.array([*(v / 10 for v in row[:6]), 0.3])
        p = 1 / (1 + math.exp(-max(-mixing.FAR, min(mixing.FAR, weights[:, g * 8 + k] @ x))))
        want[g] += n * np.outer(x, np.concatenate([[row[6] - p], p * (1 - p) * x]))
        level.append(g)
    assert level == sorted(level) and len(set(level)) == mixing.GATES // 8
    assert np.allclose(mixing.slopes(k, keys, counts, weights), want, rtol=1e-9, atol=1e-9)
    assert mixing.followed(k, keys, counts, weights).sum(axis=(0, 2)).tolist() == np.bincount(level, counts).tolist()


def test_blocks_keep_their_texts():
    """What a block stores is the spelling of its texts, their tokens and their runs."""
    docs = [b"The cat  sat\ton the mat", b"", b"  ", "né à la Mer".encode(), b"x" * 70000, b"the cat " * 500]
    tokens, _, at, begin, spelled = mixing._tokens(docs, 3)
    start, keys = mixing._runs_of(at, begin, mixing._hashes(tokens))
    keys, own = np.unique(keys, return_inverse=True)
    data, sizes, numbers, first, runs = mixing._unblock(mixing._block(tokens, at, np.diff(np.append(start, len(at))), own))
    assert data == b"".join(spelled) and [tokens[k] for k in numbers] == [w for d in docs for w in [*d.lower().split(), b""]]
    assert sizes.tolist() == [len(tokens[k]) + 1 if tokens[k] else 1 for k in numbers]
    assert np.array_equal(first, start) and np.array_equal(runs, own)


def test_share_by_all_words():
    n = 2 * mixing.RATIO_FAR * mixing.RATIO_STEPS + 1
    ratios = np.zeros(n, np.int64)
    ratios[0], ratios[(mixing.RATIO_FAR + 8) * mixing.RATIO_STEPS] = 600, 400  # no count, or 256 times as likely
    share = mixing.share_of(ratios)
    assert math.isclose(share, (400 * 256 / 1000 - 1) / 255, rel_tol=1e-2)
    assert mixing.share_of(np.zeros(n, np.int64)) == 0.5
