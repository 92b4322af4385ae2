"""Tiling, packing, audio, licences, chats and the pipeline."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from testdata import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import audio, chat, licenses, packing, tiling, tokens
from quarry.llm.queries import ORACLES, QUERIES


def plain_tiles(t, p, least):
    used, told, out = [0] * len(t), [0] * len(p), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(t)):
            for j in range(len(p)):
                k = 0
                while i + k < len(t) and j + k < len(p) and t[i + k] == p[j + k] and not used[i + k] and not told[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        n, i, j = best
        if n < least:
            return out
        used[i : i + n], told[j : j + n] = [1] * n, [1] * n
        out.append((i, j, n))


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=25), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_tiles(t, p, least):
    assert tiling.tile(np.array(t, np.int64), np.array(p, np.int64), least) == plain_tiles(t, p, least)


def test_contamination(docs, spark):
    words = [f"w{k}" for k in range(30)]
    item = " ".join(words)
    moved = " ".join(["pre", *words[15:], "mid", "dle", *words[:15], "post"])
    rows = [(1, f"before, {item.upper()}! after", 0), (2, moved, 0), (3, " ".join(words[:12]), 0), (4, None, 0), (5, "", 0), (6, "two words", 0), (None, item, 0), (1, item, 0), (7, "z " * 30000 + item, 0)]
    bench = spark.createDataFrame([(10, item), (11, None), (12, "Two, words"), (13, "")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_tiled) for r in tiling.contaminated(docs(rows, ", coverage int"), bench).collect()), key=repr)
    assert got == sorted([(1, 10, 30), (1, 10, 30), (2, 10, 30), (7, 10, 30), (None, 10, 30), (6, 12, 2)], key=repr)
    clean = tiling.keep_clean(docs(rows, ", coverage int"), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5]
    sliced = tiling.contaminated(docs(rows, ", coverage int"), bench, slice_bytes=20).collect()
    assert sorted(((r.doc_id, r.item_id, r.n_tiled) for r in sliced), key=repr) == got
    assert tiling.contaminated(docs([]), bench).count() == 0
    assert tiling.contaminated(docs(rows, ", coverage int"), bench.where("false")).count() == 0


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=100, deadline=None)
def test_pack(lengths):
    bins = packing.pack(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= len(packing.best_fit(lengths, 64))


def test_search_empties_bins():
    lengths = [40, 24, 40, 24, 30, 34]
    assert len(packing.Search([[0, 4], [1, 2], [3, 5]], lengths, 100).run()) <= 2


def test_tokens_as_whole_texts():
    path = tokens.vocabulary_path("word_bpe_49k.json")
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcXYZéÉßẞÿ'.,!<|>endoftext́ıİ Ω\x1c中1²_-\n\t", k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|ENDOFTEXT|>b <|startoftext|>x", "Don't WE'LL", ""]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.encode([t.encode() for t in texts], path)]
    assert got == [e.ids for e in tokens.tokenizer(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("shard", [4096, 7])
def test_packing(docs, shard):
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "x y"), (1, "hello world"), (4, "word " * 5000), *((k, "a b c " * k) for k in range(10, 60))]
    got = packing.pack_documents(docs([(*r, 0) for r in rows], ", piece int"), shard=shard, with_ids=True).toPandas()
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.max() <= 2048
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert (part.offset == part.length.cumsum() - part.length).all()
    assert (got.ids.map(lambda x: zlib.crc32(x)) == got.ids_crc32).all()
    assert len(got) == len(rows) + 2
    assert got[got.doc_id == 4].length.tolist().count(2048) == 2
    assert packing.pack_documents(docs([])).count() == 0


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_wave_round_trip(data):
    full = audio.payload(data)
    assert len(full) % 64 == 0
    assert len(full) >= 64
    assert audio.decode_wave(audio.encode_wave(full)) == (full, audio.RATE)


def test_resample_and_segments():
    x = np.sin(2 * np.pi * 200 * np.arange(8000) / 8000).astype(np.float32)
    y = audio.resample(x, 1, 2)
    expected = np.sin(2 * np.pi * 200 * np.arange(4000) / 4000)
    assert len(y) == 4000
    assert np.abs(y[50:-50] - expected[50:-50]).max() < 0.2
    z = audio.resample(x, 3, 2)
    assert len(z) == 12000
    level = np.array([0, 0, 5, 4.5, 4.2, 0, 0, 0, 5, 0], np.float32)
    assert audio.segments(level - 0, 1.0, -1.0) == [(2, 5), (8, 9)]
    frames = np.arange(35 * audio.BANDS, dtype=np.float32).reshape(35, -1)
    stored = audio.read_tensors(audio.store_tensors(audio.tensors(frames, 0.5)))
    assert list(zip(*(stored.column(k).to_pylist() for k in range(3)), strict=True)) == [(0.0, 8.0, 16), (8.0, 16.0, 16), (16.0, 17.5, 3)]
    assert stored.column("values").to_numpy_ndarray().shape == (3, 16, audio.BANDS)
    assert (audio.frames_of(stored) == frames).all()


def test_features_by_hand():
    """Resampling, windows and bands, sample by sample."""
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 1500, np.uint8)
    x, taps, up, down = (raw.astype(float) - 128) / 128, audio.TAPS, audio.UP, audio.DOWN
    t = np.arange(up * taps) - (up * taps - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hanning(up * taps + 2)[1:-1]
    h = h / h.sum() * up
    y = []
    for o in range(-(-len(x) * up // down)):
        at, phase = o * down // up, o * down % up
        y.append(sum(x[at - taps // 2 + k] * h[(taps - 1 - k) * up + phase] for k in range(taps) if 0 <= at - taps // 2 + k < len(x)))
    n = max(1, 1 + -(-(len(y) - audio.FRAME) // audio.HOP))
    y = np.pad(y, (0, (n - 1) * audio.HOP + audio.FRAME - len(y)))
    spectrum = np.array([[abs(sum(y[i * audio.HOP + k] * np.hanning(audio.FRAME)[k] * np.exp(-2j * np.pi * f * k / audio.FRAME) for k in range(audio.FRAME))) ** 2 for f in (5, 40)] for i in range(2)])
    mels, _, _ = audio.features(raw.tobytes())
    assert mels.shape == (n, audio.BANDS)
    full = np.abs(np.fft.rfft(np.stack([y[i * audio.HOP : i * audio.HOP + audio.FRAME] for i in range(n)]) * np.hanning(audio.FRAME), axis=1)) ** 2
    assert np.allclose(full[:2][:, [5, 40]], spectrum, rtol=1e-6)
    assert np.allclose(mels, np.log10(full @ audio._mel(audio.FRAME, audio.BANDS, audio.RATE * up / down) + 1e-6), atol=1e-3)


def test_long_sound_in_slices(monkeypatch):
    raw = np.random.default_rng(4).integers(0, 256, 30_000, np.uint8).tobytes()
    whole = audio.features(raw)
    monkeypatch.setattr(audio, "SLICE", 7)
    sliced = audio.features(raw)
    assert np.allclose(whole[0], sliced[0], atol=1e-5)
    assert np.allclose(whole[1], sliced[1], atol=1e-4)


def test_audio(docs):
    rows = [(1, "hello", 0), (2, None, 0), (3, "", 0), (None, "é" * 100, 0), (4, "hello", 0), (5, "x" * 100000, 0)]
    stored = audio.store(docs(rows, ", media int"))
    got = {r.doc_id: r for r in audio.describe(stored).collect()}
    assert got[1].payload_sha256 == hashlib.sha256(b"hello".ljust(64, b"\0")).hexdigest()
    assert got[1].tail_crc32 == zlib.crc32(b"hello".ljust(64, b"\0"))
    assert (got[2].n_bytes, got[2].payload_bytes, got[None].n_bytes, got[None].payload_bytes) == (0, 64, 200, 256)
    assert got[1].feature == got[4].feature
    assert got[2].feature == got[3].feature
    assert audio.tensor_rows(audio.describe(stored)).where("doc_id = 5").count() == -(-got[5].n_frames // audio.SHAPE_FRAMES)
    assert audio.store(docs([])).count() == 0


def test_audio_query(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op5_audio"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        full = t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        media = audio.encode_wave(full)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert audio.read_tensors(bytes(r.tensors)).schema.field("values").type == audio.TENSOR


def test_packing_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    whole = tokens.tokenizer(tokens.vocabulary_path(packing.VOCABULARY))
    got = QUERIES["op7_packing"](spark, SF).toPandas()
    lengths = []
    by_doc = {i: p.sort_values("piece") for i, p in got.groupby("doc_id")}
    assert by_doc.keys() == texts.keys()
    for i, t in texts.items():
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        cut = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        lengths += map(len, cut)
        own = by_doc[i]
        assert own.piece.tolist() == list(range(len(cut)))
        assert own.start.tolist() == [2048 * k for k in range(len(cut))]
        assert own.length.tolist() == [len(x) for x in cut]
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in cut]
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert (part.offset == part.length.cumsum() - part.length).all()
        assert part.length.sum() <= 2048
    assert -(-sum(lengths) // 2048) <= got.sequence_id.nunique() <= len(packing.best_fit(lengths, 2048))


def test_offers_are_whole():
    """Every pair of lengths of a bin with many pieces can be given."""
    search = packing.Search([list(range(40))], list(range(1, 41)), 2048)
    assert set(search._offers(0)) == {0, *range(1, 41), *(a + b for a in range(1, 41) for b in range(a + 1, 41))}


def test_other_vocabularies(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not tokens.by_words(path)
    texts = ["Hello  World\n\tIf x:", "", "é  ẞ"]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode([t.encode() for t in texts], path)] == [tokens.tokenizer(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_contamination_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: tiling.fold((r.text or "").encode()).split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    expected = []
    for i, t in texts.items():
        words = tiling.fold(t.encode()).split()
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for j, item in items.items():
            if len(item) >= 5 and any(tuple(item[k : k + 5]) in grams for k in range(len(item) - 4)):
                ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
                n = sum(x for *_, x in plain_tiles([ids.get(w, -1 - k) for k, w in enumerate(words)], [ids[w] for w in item], 5))
                if n >= 0.6 * len(item):
                    expected.append((i, j, len(item), n))
    assert sorted((r.doc_id, r.item_id, r.n_tokens, r.n_tiled) for r in QUERIES["op2_tiling"](spark, SF).collect()) == sorted(expected)


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License.", 1),
        ("a/b/c/x.py", "print(1)", 1),
        ("a/b/y.py", "# Licensed under the Apache License, Version 2.0\ncode", 1),
        ("z/q.py", None, 1),
        ("top.py", "", 1),
        (None, "MIT License", 1),
        ("a/b/y.py", "more", 1),
        ("a/odd.py", "copyright by nobody in particular, no rights at all", 1),
    ]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string, license int")).collect()}
    assert len(got) == 6
    assert (got["a/LICENSE"].license, got["a/LICENSE"].origin) == ("MIT", "own")
    assert (got["a/b/c/x.py"].license, got["a/b/c/x.py"].inherited_from) == ("MIT", "a")
    assert (got["a/b/y.py"].license, got["a/b/y.py"].origin) == ("Apache-2.0", "own")
    assert (got["a/odd.py"].origin, got["z/q.py"].origin, got["top.py"].license) == ("inherited", "none", None)
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_wrapped_and_long_licenses(spark):
    texts = {name: text for name, text in licenses.TEMPLATES if len(text) > 250}
    wrapped = lambda t: "# " + "\n# ".join(" ".join(t.split()[k : k + 7]).title() for k in range(0, len(t.split()), 7))
    prose = " ".join(f"word{k} and the of" for k in range(400))
    rows = [(f"{name}/{k}.py", f"{prose}\n{wrapped(text)}\n{prose}" if k else text) for name, text in texts.items() for k in (0, 1)]
    rows += [("plain.py", prose * 20), ("near.py", "a license is a thing that one may have")]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for name in texts:
        assert [(got[f"{name}/{k}.py"].license, got[f"{name}/{k}.py"].origin) for k in (0, 1)] == [(name, "own")] * 2
    assert got["plain.py"].origin == got["near.py"].origin == "none"


def test_chats(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "other"), (5, 0, None, None), (None, 0, "user", "x"), (1, 1, "assistant", "yo")]
    turns += [(6, k, "user", f"t{k}") for k in range(200)] + [(7, k + 1, "user", f"t{k}") for k in range(150)] + [(8, 0, "user", "<|im_end|>")]
    df = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, pos int")
    got = chat.format_chats(df).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.n_turns, r.part) for r in got] == [(1, 2, 0), (4, 1, 0), (5, 1, 0), *((6, 200, k) for k in range(4)), (8, 1, 0)]
    assert got[0].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert got[-1].text == "<|im_start|>user\n< |im_end|><|im_end|>\n"
    assert "".join(r.text for r in got if r.conv_id == 6).count("<|im_start|>") == 200
    assert chat.format_chats(df.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, result = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(result.columns)
    at = [result.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.dtypes
    for name, stage in p.STAGES[:-1]:
        before = docs.count()
        docs = p.cut(stage(spark, docs, SF))
        assert docs.dtypes == schema, name
        assert 0 < docs.count() <= before
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert sorted(map(tuple, p.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))
