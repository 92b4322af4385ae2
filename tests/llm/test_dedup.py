"""Word windows and byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from testdata import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import suffixes, windows


def plain_windows(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def plain_strings(rows, length):
    first: dict[bytes, int] = {}
    ranked = [(suffixes.LAST if i is None else i, i, (t or "").encode()) for i, t in rows]
    for rank, _, b in ranked:
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(rank, first.get(b[k : k + length], rank))
    out = []
    for rank, i, b in ranked:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < rank:
                gone[k : k + length] = [True] * length
        out.append((i, len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcé" for b in "xyz "]
    passages = [" ".join(rng.choices(vocab, k=60)) for _ in range(5)]
    rows = []
    for k in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(vocab, k=rng.randint(0, 40))) for _ in range(rng.randint(0, 4))]
        rows.append((k, "\n".join(parts)))
    return rows + [(100, None), (101, ""), (None, passages[0]), (3, passages[1]), (3, passages[1]), (None, None), (102, "q" * 5000)]


def plain_kept(rows, window):
    """Of equal windows the first stays, in order of ids (null last) and places, with its words."""
    words = [((windows.LAST if i is None else i), (t or "").encode().split()) for i, t in rows]
    first: dict = {}
    count: Counter = Counter()
    for n, (i, w) in enumerate(words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            count[key] += 1
            first[key] = min(first.get(key, (i, n, k)), (i, n, k))
    out = []
    for n, ((i, _), (rank, w)) in enumerate(zip(rows, words, strict=True)):
        gone, stays = [False] * len(w), [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if count[key] > 1:
                side = stays if first[key] == (rank, n, k) else gone
                side[k : k + window] = [True] * window
        kept = [x for x, g, s in zip(w, gone, stays, strict=True) if s or not g]
        out.append((i, len(w) - len(kept), b" ".join(kept).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_first_windows_stay(docs, seed):
    rows = corpus(seed)
    got = windows.drop_repeats(docs([(*r, 0) for r in rows], ", kept int").coalesce(1), window=7, keep_first=True).collect()
    assert sorted(((r.doc_id, r.n_removed, r.kept) for r in got), key=repr) == plain_kept(rows, 7)


@pytest.mark.parametrize("seed", [1, 2])
def test_windows(docs, seed):
    rows = corpus(seed)
    got = windows.drop_repeats(docs([(*r, 0) for r in rows], ", kept int"), window=7).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == plain_windows(rows, 7)
    assert all(sum(s.after - s["first"] for s in r.removed) == r.n_removed for r in got)


def test_windows_verbatim_and_carry(docs):
    rows = [(1, "a  b\n" * 9, "x"), (2, "one   two\nthree", None), (3, None, "y")]
    got = {r.doc_id: r for r in windows.drop_repeats(docs(rows, ", lang string"), window=4, carry=["lang"], verbatim=True).collect()}
    assert got[2].kept == "one   two\nthree"
    assert got[1].kept == ""
    assert (got[1].row.lang, got[2].row.lang, got[3].kept) == ("x", None, "")
    assert windows.drop_repeats(docs([])).count() == 0


@pytest.mark.parametrize(("seed", "most"), [(1, 4096), (2, 1)])
def test_strings(docs, monkeypatch, seed, most):
    monkeypatch.setattr(suffixes, "MOST", most)
    rows = corpus(seed)
    got = suffixes.drop_substrings(docs([(*r, 0) for r in rows], ", kind int"), length=20, gram=6).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got), key=repr) == plain_strings(rows, 20)
    assert suffixes.drop_substrings(docs([])).count() == 0


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=200, deadline=None)
def test_suffix_array(values):
    s = [*values, 0]
    assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_least_ids():
    got = suffixes.least_ids([b"abcdefgh", b"xbcdefgz", b"abcdefgh!"], [5, 3, 9], 4)
    assert [x.tolist() for x in got] == [[5, 3, 3, 3, 5], [3, 3, 3, 3, 3], [5, 3, 3, 3, 5, 9]]


def test_queries(spark):
    from quarry.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted(map(tuple, QUERIES["op6_windows"](spark, SF).collect()))
    assert got == sorted((i, n, m, sha(k.encode())) for i, n, m, k in plain_windows(rows, 35))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in QUERIES["op10_suffixes"](spark, SF).collect())
    assert got == sorted((i, n, m, sha(k)) for i, n, m, k in plain_strings(rows, 50))
