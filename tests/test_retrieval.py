"""Golden cases of search and fusion; BM25 against SQLite's full-text index."""

import math
import os
import random
import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import dense, embed, fusion, lexical, retrieve, sparse


def ranked(spark, ids, scores=None):
    scores = scores or [float(len(ids) - k) for k in range(len(ids))]
    return spark.createDataFrame([(1, i, s, k + 1) for k, (i, s) in enumerate(zip(ids, scores, strict=True))], "question_id int, chunk_id string, score double, rank int")


def weights(spark, d=1.0, b=1.0):
    return spark.createDataFrame([(1, d, b, 0.5, 0.5)], "question_id int, rrf_dense_weight double, rrf_bm25_weight double, semantic_weight double, lexical_weight double")


@pytest.mark.parametrize(
    ("k", "d", "b", "dense_ids", "sparse_ids", "expected"),
    [(60, 1.0, 1.0, "abc", "bca", "bac"), (60, 1.0, 1.0, "ab", "ba", "ab"), (10, 1.0, 1.0, "", "uvw", "uvw"), (60, 1.0, 0.35, "ab", "ba", "ab"), (1, 1.0, 1.0, "xyx", "y", "yx")],
)
def test_rrf(spark, k, d, b, dense_ids, sparse_ids, expected):
    out = fusion.reciprocal_rank(ranked(spark, list(dense_ids)), ranked(spark, list(sparse_ids)), weights(spark, d, b), k)
    assert "".join(r.chunk_id for r in out.orderBy("rank").collect()) == expected


def test_rrf_scores_scaled_after_cut(spark):
    out = fusion.fuse_rrf(ranked(spark, list("abc")), ranked(spark, list("bca")), weights(spark), 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in out] == [("b", 1.0), ("a", 0.0)]
    assert fusion.fuse_rrf(ranked(spark, ["a"]), ranked(spark, []), weights(spark)).first().score == 1.0


def test_weighted(spark):
    out = fusion.fuse_weighted(ranked(spark, ["a", "b", "c"], [0.9, 0.5, 0.1]), ranked(spark, ["c", "d"], [1.0, 0.0]), weights(spark)).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 3)) for r in out] == [("a", 0.5), ("c", 0.5), ("b", 0.25), ("d", 0.0)]


def test_jaccard(spark):
    assert fusion.jaccard(ranked(spark, list("abc")), ranked(spark, list("bcd"))).first().jaccard == 0.5
    assert fusion.jaccard(ranked(spark, list("abc")), ranked(spark, [])).first().jaccard == 0.0


def test_cosine(spark):
    v = spark.createDataFrame([("c1", [1.0, 0.0, 0.0]), ("c2", [0.8, 0.2, 0.0]), ("c3", [0.0, 1.0, 0.0]), ("c4", [0.0, 0.0, 0.0]), ("c5", None)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "question_id int, vector array<float>")
    assert [r.chunk_id for r in dense.top_k(v, q, 2).orderBy("rank").collect()] == ["c1", "c2"]
    assert [(r.chunk_id, r.score) for r in dense.top_k(v, q, 4).orderBy("rank").collect()][2:] == [("c3", 0.0), ("c4", 0.0)]
    none = spark.createDataFrame([], "chunk_id string")
    assert dense.top_k(v, q, 2, whitelist=none).count() == 0
    with pytest.raises(Exception, match="4001"):
        dense.top_k(v, spark.createDataFrame([(1, [1.0])], "question_id int, vector array<float>"), 1).collect()


DOCS = ["probe alpha beta", "probe probe probe x", "gamma a_b.c delta", "a b c probe café", "如何调用 probe", "", "b a c"]


@pytest.mark.parametrize("tokens", [["probe"], ["a_b.c"], ["cafe", "delta"], ["probe", "gamma", "--"], ["如何"]])
def test_bm25_as_sqlite(spark, tokens):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(body, tokenize='unicode61')")
    con.executemany("INSERT INTO f(rowid, body) VALUES (?, ?)", enumerate(DOCS, 1))
    match = " OR ".join(f'"{t}"' for t in tokens)
    expected = [(i, round(s, 6)) for i, s in con.execute("SELECT rowid, bm25(f) AS s FROM f WHERE f MATCH ? ORDER BY s, rowid", (match,))]
    docs = spark.createDataFrame(list(enumerate(DOCS, 1)), "chunk_id long, content string")
    q = spark.createDataFrame([(1, tokens)], "question_id int, tokens array<string>")
    got = sparse.bm25(sparse.Index.of(docs), q, F.col("tokens"), 20).orderBy("rank").collect()
    assert sorted((r.chunk_id, round(r.bm25, 5)) for r in got) == sorted((i, round(s, 5)) for i, s in expected)


def test_bm25_statistics_are_global(spark):
    docs = spark.createDataFrame([(k, "r1" if k % 2 else "r2", "probe" if k < 3 else "other") for k in range(9)], "chunk_id long, repo_id string, content string")
    q = spark.createDataFrame([(1, "r1", ["probe"])], "question_id int, repo_id string, tokens array<string>")
    own = sparse.bm25(sparse.Index.of(docs), q, F.col("tokens"), 9, repo=True).collect()
    every = {r.chunk_id: r.bm25 for r in sparse.bm25(sparse.Index.of(docs), q, F.col("tokens"), 9).collect()}
    assert [(r.chunk_id, r.bm25) for r in own] == [(1, every[1])]


def test_lexical(spark):
    rows = [("c1", "r", "src/login.ts", "login", "login login", 3), ("c2", "r", "src/relogin.ts", None, "x", None), ("c3", "r", "a.ts", None, "nothing", 1), ("c4", "s", "login.ts", None, "", 1)]
    c = spark.createDataFrame(rows, "chunk_id string, repo_id string, file_path string, chunk_name string, content string, start_line int")
    q = spark.createDataFrame([(1, "r", ["login"])], "question_id int, repo_id string, tokens array<string>")
    got = lexical.scan(c, q, 5, repo=True).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("c1", 7.5), ("c2", 4.0)]


@pytest.mark.parametrize("mode", ["weighted", "rrf"])
@pytest.mark.parametrize("sparse_mode", ["fts", "full_table"])
def test_hybrid_agrees(spark, mode, sparse_mode):
    from quarry.config import Config

    c = spark.createDataFrame([("c1", "a/login.ts", "login handler", "function", "login", 1), ("c2", "b/other.ts", "something else", "function", "other", 1)], "chunk_id string, file_path string, content string, chunk_type string, chunk_name string, start_line int")
    v = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(1, "the login handler", [0.9, 0.1])], "question_id int, question string, vector array<float>")
    got = retrieve.hybrid(c, v, q, 2, Config(fusion=mode, sparse_mode=sparse_mode)).orderBy("rank").collect()
    assert got[0].chunk_id == "c1"
    assert got[0].fusion == mode


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(DOCS, 1)), "chunk_id long, content string")
    stored = sparse.Index.of(docs.repartition(3)).write(str(tmp_path / "fts"))
    q = spark.createDataFrame([(1, ["probe", "a_b.c"]), (2, ["nowhere"]), (3, []), (4, ["b c"])], "question_id int, tokens array<string>")
    some = spark.createDataFrame([(1,), (4,), (99,)], "id long")
    for match_all in (False, True):
        for ids in (None, some, some.where("false")):
            own = sparse.bm25(sparse.Index.of(docs.coalesce(1)), q, F.col("tokens"), 3, match_all=match_all, whitelist=ids)
            got = sorted(map(tuple, sparse.bm25(stored, q, F.col("tokens"), 3, match_all=match_all, whitelist=ids).collect()))
            assert got == sorted(map(tuple, own.collect()))
            assert ids is None or {r[1] for r in got} <= {1, 4}
    held = sparse.WHITELIST
    sparse.WHITELIST = 0  # too many ids to send
    try:
        far = sorted(map(tuple, sparse.bm25(stored, q, F.col("tokens"), 3, whitelist=some).collect()))
    finally:
        sparse.WHITELIST = held
    assert far == sorted(map(tuple, sparse.bm25(stored, q, F.col("tokens"), 3, whitelist=some).collect()))
    plan = sparse.bm25(stored, q, F.col("tokens"), 3)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan") :]
    assert physical.count("Exchange hashpartitioning") == 1  # of the best of each task
    assert "PushedFilters: [IsNotNull(term), " in physical or "PushedFilters: [In(term" in physical
    terms = {(r.term, r.chunk_id): (r.length, r.positions) for r in stored.postings().collect()}
    assert terms["b", 3] == (5, [2])
    assert terms["probe", 2] == (4, [0, 1, 2])


def _all_rows(words, asked, k):
    """BM25 of every text, by the formula."""
    n, avg = len(words), sum(map(len, words)) / len(words)
    out = {}
    for q, tokens in asked:
        found = []
        for i, w in enumerate(words):
            score, met = 0.0, False
            for t in tokens:
                tf = w.count(t)
                df = sum(t in x for x in words)
                raw = math.log((n - df + 0.5) / (df + 0.5)) if tf else 0
                score -= (raw if raw > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg)) if tf else 0
                met |= tf > 0
            if met:
                found.append((round(score, 6) + 0.0, i))
        out[q] = sorted(found)[:k]
    return out


def test_ranges_are_skipped(spark, monkeypatch):
    """Several segments, small ranges, rare and frequent terms: the same rows as by the formula, most ranges unseen."""
    rng = random.Random(3)
    words = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))] + (["rare"] * rng.randint(1, 3) if k % 97 == 5 else []) for k in range(1200)]
    asked = [(1, ["rare", "a"]), (2, ["a", "b", "c"]), (3, ["rare"])]
    batch = pa.RecordBatch.from_pydict({"chunk_id": pa.array(range(1200), pa.int64()), "terms": words})
    monkeypatch.setattr(sparse, "RANGE", 16)
    segments = []
    for a in (0, 700):
        w = sparse._Writer()
        w.add(batch.slice(a, 700))
        rows = w.rows(a).to_pylist()
        segments.append(sparse.Segment(rows[0]["head"], {r["term"]: r for r in rows[1:]}))
    lists = [("rare",), ("a",), ("b",), ("c",)]
    number = {t[0]: k for k, t in enumerate(lists)}
    df = np.array([sum(t[0] in w for w in words) for t in lists])
    raw = np.log((1200 - df + 0.5) / (df + 0.5))
    scorer = sparse.Scorer([(q, [number[t] for t in ts], 5, None) for q, ts in asked], lists, np.where(raw > 0, raw, sparse.LEAST_IDF), sum(map(len, words)) / 1200, False)
    for s in segments:
        scorer.add(s, None, False)
    want = _all_rows(words, asked, 5)
    got = {asked[q][0]: best for q, best in scorer.best.items()}
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
    assert scorer.visited < 0.6 * scorer.ranges


def test_dimensions_are_each_rows(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "question_id int, vector array<float>")
    for bad in ([[1.0], [1.0, 2.0, 3.0]], [[1.0, None], [1.0, 0.0]]):
        v = spark.createDataFrame([(k, x) for k, x in enumerate(bad)], "chunk_id int, embedding array<float>")
        with pytest.raises(Exception, match="4001"):
            dense.top_k(v.coalesce(1), q, 1).collect()


@pytest.mark.parametrize("engine", [True, False])
def test_token_counts(engine, monkeypatch):
    if not engine:
        monkeypatch.setattr(lexical, "ahocorasick", None)
    c = lexical.Counter(["tok", "a.b", "b.", "x/y"])
    assert c.hits("tok tok tok") == {0: 2}
    assert c.hits("xtok tok.") == {0: 1}
    assert c.hits("a.b axb a.b. a.b") == {1: 3, 2: 1}
    assert c.hits("b. b.") == {2: 1}
    assert c.contained("atokb/x/yz") == {0: 1, 3: 1}


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    class Counting(embed.WordShapes):
        def __init__(self, place):
            self.place = place

        def load(self):
            with open(self.place, "a") as out:
                out.write(f"{os.getpid()}\n")
            return embed.WordShapes.load(self)

    rows = spark.createDataFrame([(k, f"some words {k}" if k % 7 else None) for k in range(200)], "chunk_id long, body string").repartition(12)
    got = embed.embed_rows(rows, "body", Counting(str(tmp_path / "loads")), 16).collect()
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads)) <= 12
    for r in got:
        want = embed.pooled(embed.WordShapes().load()([r.body or ""]), 4)[0]
        assert r.embedding == pytest.approx(want.tolist(), abs=1e-6)
        assert sum(x * x for x in r.embedding) == pytest.approx(1 if r.body else 0, abs=1e-5)
    with pytest.raises(Exception, match="4001"):
        embed.embed_rows(rows, "body", lambda texts: np.zeros((len(texts), 2 + len(texts) % 3)), 16).collect()


@pytest.mark.parametrize("clustered", [True, False])
@pytest.mark.parametrize("grouped", [True, False])
def test_blocks_are_skipped(clustered, grouped):
    """The same rows as by comparing all; of vectors in clusters most are not compared."""
    rng = np.random.default_rng(4)
    homes = rng.normal(size=(40, 32))
    vectors = homes[rng.integers(0, 40, 6000)] + 0.1 * rng.normal(size=(6000, 32)) if clustered else rng.normal(size=(6000, 32))
    vectors[::500] = 0
    vectors[1::700] = vectors[2]  # ties
    asked = np.concatenate([vectors[3:200], homes[:5], np.zeros((1, 32))])
    group = rng.integers(0, 2, 6000)
    search = dense.Search(dense._units(asked), ["a" if grouped else None] * len(asked), np.full(len(asked), 7))
    for at in range(0, 6000, 2000):
        search.add(vectors[at : at + 2000], list(range(at, at + 2000)), group[at : at + 2000] if grouped else None, ["a", "b"])
    scores = np.round(dense._units(asked) @ dense._units(vectors).T, 6) + 0.0
    for q, best in enumerate(search.best):
        every = sorted((-s, i) for i, s in enumerate(scores[q].tolist()) if not grouped or group[i] == 0)[:7]
        assert [i for _, i in best] == [i for _, i in every]
    assert search.compared < (0.45 if clustered else 1.01) * search.pairs
