"""Fingerprints, bit-sliced comparison and groups against plain loops."""

import numpy as np
import pytest
import xxhash
from testdata import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import components, simhash


def plain_fingerprint(text: str, width: int = 4) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(fps: dict[int, int], radius: int) -> dict[int, int]:
    label = {i: i for i in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in ids}


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.integers(0, 12))
@settings(max_examples=60, deadline=None)
def test_near(values, radius):
    a = np.array(values, np.uint64)
    b = np.array([v ^ (1 << k % 64) ^ (1 << k * 7 % 64) for k, v in enumerate(values)], np.uint64)
    q, m = simhash.near(a, b, radius)
    expected = {(i, j) for i in range(len(a)) for j in range(len(b)) if (int(a[i]) ^ int(b[j])).bit_count() <= radius}
    assert set(zip(q.tolist(), m.tolist(), strict=True)) == expected
    assert simhash.near_lanes(a, b, radius).tolist() == [(int(x) ^ int(y)).bit_count() <= radius for x, y in zip(a, b, strict=True)]


def test_masks_lose_nothing():
    rng = np.random.default_rng(1)
    for _ in range(300):
        flips = sum(1 << int(k) for k in rng.choice(64, 4, replace=False))
        assert any(not flips & m for m in simhash.masks(4))


def test_forest():
    rng = np.random.default_rng(2)
    a, b, cost = rng.integers(0, 40, 200), rng.integers(40, 80, 200), rng.integers(0, 9, 200)
    x, y = components.best_forest(a, b, cost)
    whole, tree = components.stars(a, b), components.stars(x, y)
    assert dict(zip(*map(list, whole), strict=True)) == dict(zip(*map(list, tree), strict=True))
    assert len(x) == len(whole[0])


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, 9), (9, 7), (5, 5), (9, 11), (200, 3)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 100 for k in range(100, 141)} | {7: 7, 9: 7, 11: 7, 200: 3, 3: 3}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    from quarry.llm.queries import QUERIES

    texts = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    groups = plain_groups(fps, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash"](spark, SF).collect()}
    assert got == {i: (f"{f:016x}", groups[i]) for i, f in fps.items()}


def test_edges(docs):
    rows = [(3, "a b c d e", 1), (1, "A B c d e", 2), (2, None, 3), (5, "", 4), (9, " \n", 5), (None, "a b c d e", 6), (3, "a b c d e", 7), (8, "x " * 20000, 8)]
    got = simhash.simhash_groups(docs(rows, ", fp long")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert len(got) == len(rows)
    assert by[3] == by[1]
    assert {c for _, c in by[3]} == {1}
    assert by[2] == by[5] == by[9] == {("0" * 16, 2)}
    assert {c for _, c in by[None]} == {1}
    assert simhash.simhash_groups(docs([])).count() == 0


@pytest.mark.parametrize("chunk", [2, 1024])
def test_crowded_bucket(spark, chunk):
    base = 0x0123456789ABCDEF
    rows = [(1, k, simhash.signed(base ^ (1 << k))) for k in range(40)]
    links = simhash.bucket_links(spark.createDataFrame(rows, "bucket long, node long, fp long"), 2, chunk=chunk)
    got = dict(map(tuple, components.connected_components(links).collect()))
    assert got == {k: 0 for k in range(40)}


def test_similar(docs):
    words = [f"w{k}" for k in range(200)]
    near = words.copy()
    near[100] = "other"
    far = words[:80] + [f"v{k}" for k in range(120)]
    rows = [(4, " ".join(words)), (2, " ".join(near)), (7, " ".join(far)), (6, " ".join(words)), (8, None), (9, "")]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(rows)).collect()}
    assert got == {4: 2, 2: 2, 6: 2, 7: 7, 8: 8, 9: 8}


def plain_similar(texts: dict[int, str], may=lambda i, j: True, width: int = 5, similarity: float = 0.8) -> dict[int, int]:
    sets = {i: {tuple(t.lower().split()[k : k + width]) for k in range(len(t.split()) - width + 1)} for i, t in texts.items()}
    label = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and label[i] != label[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and may(i, j):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def families() -> dict[int, str]:
    """Variants whose similarities lie on both sides of the limit."""
    rng = np.random.default_rng(5)
    rows = {}
    for family in range(4):
        words = [f"f{family}w{k}" for k in range(150)]
        for k in range(24):
            own = words.copy()
            for at in rng.choice(150, 2 + k % 2, replace=False):
                own[at] = f"x{k}y{at}"
            rows[family * 100 + k] = " ".join(own)
    return rows


@pytest.mark.parametrize("held", [2000, 1 << 24])
def test_open_links(docs, monkeypatch, held):
    monkeypatch.setattr(simhash, "HELD_BYTES", held, raising=False)
    rows, scale = families(), simhash._permutations(128)
    bands = {i: set(simhash.signature(simhash.shingle_hashes(t.encode(), 5), scale, 16, 4)[0]) for i, t in rows.items()}
    monkeypatch.setattr(simhash, "MARGIN", 0.25)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(list(rows.items()))).collect()}
    assert got == plain_similar(rows, lambda i, j: bool(bands[i] & bands[j]))


def test_similar_families(docs):
    rows = families()
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(list(rows.items()))).collect()}
    assert got == plain_similar(rows)


def test_similar_repeated_line(docs):
    words = [f"w{k}" for k in range(200)]
    line = words[3:13]
    rows = [(1, " ".join(words)), (2, " ".join(words[:13] + line * 100 + words[13:]))]
    h = [simhash.shingle_hashes(t.encode(), 5) for _, t in rows]
    assert (simhash.fingerprint(h[0]) ^ simhash.fingerprint(h[1])).bit_count() > 24
    assert {r.component_id for r in simhash.similar_groups(docs(rows)).collect()} == {1}


def test_signatures_tell_similarity():
    rng, scale = np.random.default_rng(7), simhash._permutations(128)
    differ, met = [], 0
    for _ in range(300):  # Jaccard 0.8: 80 of 100
        h = rng.integers(0, 1 << 63, 100, np.uint64)
        (one, x), (two, y) = (simhash.signature(h[at], scale, 16, 4) for at in (slice(0, 90), slice(10, 100)))
        met += bool(set(one) & set(two))
        differ.append(int(simhash.differing(np.frombuffer(x, np.uint64)[None], np.frombuffer(y, np.uint64)[None])[0]))
    assert met >= 298
    assert abs(np.mean(differ) - 19.2) < 2
    most = 0.75 * (1 - (0.8 - simhash.MARGIN)) * 128
    assert sum(d > most for d in differ) <= 1


def test_far_blocks_are_abandoned():
    """Random fingerprints are far apart: their blocks are left long before the last plane, padding or not."""
    fps = np.random.default_rng(5).integers(0, 1 << 63, 100, np.uint64)
    cols = simhash.planes(fps)
    lanes = np.arange(cols.shape[1] * 64)
    over = np.packbits(np.broadcast_to((lanes[None, :] >= 100) | (lanes[None, :] <= np.arange(100)[:, None]), (100, len(lanes))), axis=1, bitorder="little").view(np.uint64).ravel()
    flip = [np.where(fps >> np.uint64(k) & np.uint64(1), simhash.ONES, np.uint64(0)) for k in range(64)]
    words = cols.shape[1]
    ok, read = simhash.count_within(lambda k, blocks: cols[k][blocks % words] ^ flip[k][blocks // words], over, 4)
    assert not ok.any()
    assert read < 30 * 100 * words


@pytest.mark.parametrize("parts", [6, 7, 8])
def test_more_ranges_lose_no_link(parts):
    rng = np.random.default_rng(parts)
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flips & m for m in simhash.masks(4, parts))
    assert simhash.ranges_for(4, 1000) == 6
    assert simhash.ranges_for(4, 1 << 40) == 8
