"""The pipeline's stages on hand-made documents, against brute force."""

import pytest

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, component_id long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None, "k", 1, 7) for i, t, lang in rows], SCHEMA)


@pytest.fixture
def benchmark(spark, tmp_path):
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


ITEM = " ".join(f"item{k}" for k in range(30))
PASSAGE = " ".join(f"pass{k}" for k in range(60))


def prose(seed, n=80):
    return " ".join(f"{w}{(seed * 31 + k * k * 7 + k) % 997}" for k in range(n) for w in ("the", "house"))


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return x == y or (bool(x and y) and len(x & y) >= 0.8 * len(x | y))


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_empty_tables(spark, benchmark):
    docs = make(spark, [])
    for name, stage in p.STAGES:
        out = stage(spark, docs, benchmark)
        assert out.count() == 0, name
        if name != "packing":
            assert out.dtypes == docs.dtypes


def test_language_stage(spark, benchmark):
    rows = [(k, prose(k), "en") for k in range(60)] + [(100, None, "en"), (101, "", None), (102, "12 + 34", "en"), (None, prose(5), None), (3, prose(7), "en"), (103, "".join(chr(0x4E00 + k * k % 9999) for k in range(3000)), None)]
    out = p.language_id(spark, make(spark, rows), benchmark)
    assert out.dtypes == make(spark, []).dtypes
    assert rows_of(out) == sorted([(i, t) for i, t, _ in rows if i not in (100, 101, 102, 103)], key=repr)


def test_near_stage(spark, benchmark):
    base = {k: prose(k) for k in range(12)}
    rows = [(k, t, "en") for k, t in base.items()]
    rows += [(20 + k, base[k].replace("the3", "a3", 1), "en") for k in range(4)]  # near copies
    rows += [(30, base[5], "en"), (31, base[5].upper(), "en"), (40, None, "en"), (41, "", "en"), (42, "two words", "en"), (43, "two words", "en"), (None, base[1], "en"), (None, "x", "en"), (50, "long word " * 20000, "en"), (2, base[2], "en")]
    texts = {}
    for i, t, _ in rows:
        if i is not None:
            texts.setdefault(i, t or "")
    label = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if a < b and label[a] != label[b] and alike(texts[a], texts[b]):
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
                    changed = True
    for i in list(label):
        while label[label[i]] != label[i]:
            label[i] = label[label[i]]
    out = p.near_dedup(spark, make(spark, rows), benchmark)
    assert rows_of(out) == sorted([(i, t) for i, t, _ in rows if i is None or label[i] == i], key=repr)


def test_substring_stage(spark, benchmark):
    rows = [(1, prose(1) + "\n" + PASSAGE + " tail", "en"), (2, "head  two " + PASSAGE, "en"), (3, PASSAGE, "en"), (None, "own words " + PASSAGE, "en"), (4, None, "en"), (5, "", "en"), (6, "kept\tas  is", "en")]
    out = p.substring_dedup(spark, make(spark, rows), benchmark)
    assert out.dtypes == make(spark, []).dtypes
    assert rows_of(out) == sorted([(1, rows[0][1]), (2, "head two"), (None, "own words"), (4, ""), (5, ""), (6, "kept\tas  is")], key=repr)
    assert {r.doc_id: r.n_chars for r in out.collect()}[2] == 8


def test_benchmark_stage(spark, benchmark):
    words = ITEM.split()
    rows = [(1, prose(1), "en"), (2, prose(2) + " " + ITEM.upper() + "!", "en"), (3, " ".join([*words[15:], "and", *words[:15]]), "en"), (4, " ".join(words[:10]), "en"), (5, None, "en"), (6, "", "en"), (None, ITEM, "en"), (1, prose(1), "en")]
    out = p.decontaminate(spark, make(spark, rows), benchmark)
    assert out.dtypes == make(spark, []).dtypes
    assert rows_of(out) == sorted([(i, t) for i, t, _ in rows if i in (1, 4, 5, 6)], key=repr)


def test_packing_stage(spark, benchmark):
    rows = [(k, prose(k), "en") for k in range(30)] + [(None, "x", "en"), (40, None, "en"), (3, prose(3), "en"), (50, "word " * 9000, "en")]
    got = p.packing(spark, make(spark, rows), benchmark).collect()
    assert {r.doc_id for r in got} == {i for i, _, _ in rows}
    fill = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048
