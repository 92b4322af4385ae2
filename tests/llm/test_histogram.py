"""Packing by the histogram: places, ids and padding, from the tokenizer's own ids."""

import zlib
from array import array
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from testdata import SF

from quarry.llm import histogram, tokens
from quarry.llm.queries import QUERIES

PATH = tokens.vocabulary_path(histogram.VOCABULARY)


def sizes_of(rules, lengths):
    cover, filled = {}, {}
    for length, low, high, begin, size, parts, each, first, sequence, offset in rules:
        for k in range(high - low):
            for j in range(parts):
                n = first + k * parts + j
                cover.setdefault((length, low + k), []).append((begin + j * size, size))
                filled.setdefault(sequence + n // each, []).append((offset + n % each * size, size))
    assert set(cover) == {(n, k) for n, c in lengths.items() for k in range(c)}

    def total(parts):
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        return at

    assert all(total(parts) == length for (length, _), parts in cover.items())
    return Counter(map(total, filled.values()))


@given(st.dictionaries(st.integers(1, 32), st.integers(0, 40), max_size=20))
@settings(max_examples=200, deadline=None)
def test_plan(lengths):
    sizes = sizes_of(histogram.plan(lengths, 32), lengths)
    assert all(n == 32 or n & (n - 1) == 0 and c == 1 for n, c in sizes.items())


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_plan_without_single_pieces(lengths):
    held, histogram.FEW = histogram.FEW, -1
    try:
        sizes = sizes_of(histogram.plan(lengths, 32), lengths)
    finally:
        histogram.FEW = held
    assert max(sizes) <= 32


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1))
@settings(max_examples=100, deadline=None)
def test_patterns(lengths):
    packs = histogram.patterns(lengths, 64)
    assert Counter({n: c for n, c in lengths.items()}) == sum((Counter({n: k * pack.count(n) for n in set(pack)}) for pack, k in packs), Counter())
    assert all(sum(pack) <= 64 for pack, _ in packs)


def test_rules_do_not_grow_with_counts():
    few, many = ({n: c * (n % 7 + 1) for n in range(1, 1025)} for c in (10**3, 10**9))
    a, b = len(histogram.plan(few, 1024)), len(histogram.plan(many, 1024))
    assert b < 20_000 and b < 4 * a


texts = st.lists(st.sampled_from(["a", "Bé", "12", " ", "  ", "\n", "\n\n", "\t", "'s", "'", ".", "<|endoftext|>", " ", "　", "\x85", "\x1c", "foo", "好", "😀", "x" * 300, "ÀB!?"]), max_size=14).map("".join)


@given(st.lists(texts, min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_byte_level_ids(docs):
    whole = tokens.tokenizer(PATH).encode_batch(docs, add_special_tokens=False)
    assert tokens.encode([d.encode() for d in docs], PATH) == [array("I", e.ids).tobytes() for e in whole]


def check(rows, got, capacity):
    """Every id in one piece, pieces in their places, nothing padded."""
    encoder = tokens.tokenizer(PATH)
    ids = Counter()
    want = {}
    for name, text in rows:
        own = array("I", [*encoder.encode(text or "", add_special_tokens=False).ids, 0]).tobytes()
        ids[name] += 1
        want[name] = own
    pieces, places = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for name, own in pieces.items():
        data, spans = want[name], Counter()
        for r in own:
            assert r.length > 0 and zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and r.doc_tokens == len(data) // 4
            spans.update(range(r.start, r.start + r.length))
        assert spans == Counter(dict.fromkeys(range(len(data) // 4), ids[name]))
    sizes = Counter()
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes[at] += 1
    assert all(n == capacity or n & (n - 1) == 0 and c == 1 for n, c in sizes.items()), sizes


def test_pack_by_lengths(spark, docs):
    rows = [(1, None), (2, ""), (2, ""), (3, "two words"), (None, "no id"), (4, "long text. " * 200), (5, " "), (6, "<|endoftext|> x")] + [(k, f"Item {k} " * (k % 9)) for k in range(10, 60)]
    table = docs([(*r, 1, 2) for r in rows], ", length int, task int")
    check(rows, histogram.pack_by_lengths(table, capacity=64).collect(), 64)
    assert histogram.pack_by_lengths(docs([])).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(rows, QUERIES["op13_lengths"](spark, SF).collect(), 1024)
