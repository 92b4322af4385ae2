"""Periodic runs against a plain search."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import runs


def plain(words):
    out = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - p:
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def found(docs):
    words = runs.Words.of(docs)
    out = [[] for _ in docs]
    for doc, s, e, p in words.runs().tolist():
        out[doc].append((s - words.begin[doc], e - s, p))
    return out


some = st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=5), st.integers(1, 9)), max_size=6).map(lambda parts: [w for ws, k in parts for w in ws * k])


@given(st.lists(some, min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_runs(docs):
    assert found(docs) == [plain(d) for d in docs]


@given(st.lists(some, min_size=1, max_size=3))
@settings(max_examples=60, deadline=None)
def test_weak_hashes_and_small_steps(docs):
    held = runs.HASHES, runs.PAIRS
    runs.HASHES, runs.PAIRS = ((3, 2),), 3  # nearly all hashes collide
    try:
        assert found(docs) == [plain(d) for d in docs]
    finally:
        runs.HASHES, runs.PAIRS = held


def test_long_text():
    rng = np.random.default_rng(5)
    words = [b"w%d" % k for k in rng.integers(0, 50, 3000)]
    words[700:2000] = words[700:913] * 6 + words[700:722]
    words[2500:2600] = [b"same"] * 100
    assert found([words]) == [plain(words)]


def rebuilt(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_query_by_brute_force(spark, docs):
    texts = [None, "", " \n ", "one", "a a a a a a b", "x y " * 9 + "z", "é è é è é è é è é è é è", "a\tb\x0bc\r" * 4, "q w e r t y " * 300, " ".join(f"u{k}" for k in range(200)), "A a A a A a A a"]
    rows = [(k, texts[k % len(texts)], "r", 1) for k in range(120)] + [(7, texts[5], "r", 1), (7, texts[5], "r", 1), (None, texts[4], None, None)]
    table = docs(rows, ", runs string, n_words int")
    got = runs.digests(runs.periodic_runs(table.withColumn("text", runs.with_loops(F.col("doc_id"), F.col("text")))))
    want = []
    for doc_id, text, *_ in rows:
        words = rebuilt(doc_id, text)
        own = plain(words)
        kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in own)]
        best = min(own, key=lambda r: (-r[1] / r[2], r[0], r[2])) if own else (None, None, None)
        milli = 1000 * best[1] // best[2] if own else None
        want.append((doc_id, len(own), *best, milli, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 40
    assert runs.periodic_runs(docs([])).count() == 0
