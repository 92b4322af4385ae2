"""Golden cases of the text rules, import summaries, chunking, context packing and configuration."""

import pytest
from pyspark.sql import functions as F

from quarry.config import Config, canonical_model_id
from quarry.functions import text as T
from quarry.functions.imports import import_summary
from quarry.operators import chunking, classify, context


def rows(spark, values, schema="v string"):
    return spark.createDataFrame([(v,) for v in values], schema)


NL = ["How does login work?", "怎么调用这个接口", "please explain the retry policy in simple words for me", "what is the purpose of this module?", "请用import说明模块如何加载", ""]
PL = ["function foo(bar) { return bar; }", "src/app/main.ts", "const x = await fetch(url);", "getUserById", "a.b.c.d()", "std::vector<int> v;", "def run(self): pass"]


@pytest.mark.parametrize(("side", "texts"), [("nl", NL), ("pl", PL)])
def test_modality(spark, side, texts):
    got = [r[0] for r in rows(spark, texts).select(classify.modality(F.col("v"))).collect()]
    assert got == [side] * len(texts)


def test_forced_modality(spark):
    for setting in ("force_nl", "force_pl"):
        assert rows(spark, ["getUserById"]).select(classify.modality(F.col("v"), setting)).first()[0] == setting[-2:]


def test_tokens_and_matches(spark):
    df = rows(spark, ["Where is the Foo foo a.b/c x 如何 调用链路图 以及"])
    assert df.select(T.question_tokens(F.col("v"))).first()[0] == ["is", "the", "foo", "a.b/c", "调用链路图"]
    got = rows(spark, ["Foo foo BAR 函数 or", "!!", "  "]).select(T.and_match(F.col("v"))).collect()
    assert [r[0] for r in got] == ['"Foo" "BAR" "函数" "or"', None, None]
    got = rows(spark, [["a", 'b"c'], []], "v array<string>").select(T.or_match(F.col("v"))).collect()
    assert [r[0] for r in got] == ['"a" OR "b""c"', None]


def test_paths(spark):
    df = spark.createDataFrame([("local", " /a/b// "), ("local", "///"), ("git", "https://x/y.git/"), ("local", " ")], "k string, v string")
    assert [r[0] for r in df.select(T.normalize_source(F.col("k"), F.col("v"))).collect()] == ["/a/b", "/", "https://x/y.git", ""]
    assert rows(spark, ["./a\\b.ts"]).select(T.normalize_path(F.col("v"))).first()[0] == "a/b.ts"


@pytest.mark.parametrize(
    ("content", "path", "expected"),
    [
        ("// note\n\nimport a from 'a';\nexport { b } from './b';\nconst x = 1;\nimport c from 'c';", "x.ts", "import a from 'a';\nexport { b } from './b';"),
        ("#!/usr/bin/env python\nfrom os import path\nimport sys\n\nimport late", "x.py", "from os import path\nimport sys"),
        ('"""Doc.\nimport no\n"""\nimport yes\n', "x.py", "import yes"),
        ('"""One line."""\nimport yes\n', "x.PYI", "import yes"),
        ('"""Doc.\n"""\nimport yes\n', "x.md", ""),
        ('package main\n\nimport (\n\t"fmt"\n\t"os"\n)\n\nfunc main() {}', "x.go", 'import (\n\t"fmt"\n\t"os"\n)'),
        ("const a = 1;\nimport b from 'b'", "x.ts", ""),
        ("", "x.ts", ""),
        (None, None, ""),
        ("use std::io;\n" * 200, "x.rs", ("use std::io;\n" * 92).strip()),
    ],
)
def test_import_summary(content, path, expected):
    assert import_summary(content, path) == expected


def test_index_body(spark):
    df = spark.createDataFrame([("p.ts", "import x", "function", "f", "body"), ("p.ts", None, "class", None, "body")], "p string, s string, k string, n string, c string")
    got = [r[0] for r in df.select(T.index_body(*map(F.col, "pskn"), F.col("c"))).collect()]
    assert got == ["File: p.ts\nImports:\nimport x\n\nfunction: f\n\nbody", "File: p.ts\nclass: anonymous\n\nbody"]


TS = "export class Greeter {\n  hello(name: string): string {\n    return '}' + name;\n  }\n}\n\nfunction run() {\n  return 1;\n}\n"


def test_syntax_chunks():
    got = chunking.split_file("r", "a/x.ts", TS)
    assert [(c["chunk_type"], c["chunk_name"], c["start_line"], c["end_line"]) for c in got] == [("class", "Greeter", 1, 5), ("function", "hello", 2, 4), ("function", "run", 7, 9)]
    py = "class A:\n    def m(self):\n        return 1\n\n\nasync def f():\n    pass\n"
    got = chunking.split_file("r", "x.py", py)
    assert [(c["chunk_type"], c["chunk_name"], c["start_line"]) for c in got] == [("class", "A", 1), ("function", "m", 2), ("function", "f", 6)]
    assert got == chunking.split_file("r", "x.py", py)


def test_long_chunks():
    body = "function big() {\n" + "  const value = compute(1, 2, 3);\n" * 200 + "}\n"
    got = chunking.split_file("r", "x.js", body)
    assert len(got) > 1
    assert {c["chunk_name"] for c in got} == {"big"}
    assert {c["chunk_type"] for c in got} == {"generic"}
    assert all(len(c["content"]) <= 1500 for c in got)
    text = " ".join(f"w{k}" for k in range(3000))
    parts = chunking.split_text(text, 500, 100)
    assert all(len(p) <= 500 for p in parts)
    assert {w for p in parts for w in p.split()} == set(text.split())
    assert set(parts[0].split()) & set(parts[1].split())
    assert chunking.split_file("r", "x.md", "")[0]["chunk_name"] == "generic_1"


def item(n, **more):
    return {"question_id": 1, "rank": n, "file_path": f"src/very/long/path/number/{n}/file.ts", "chunk_type": "function", "chunk_name": f"name{n}", "content": "x" * 300, "import_summary": None} | more


def packed(spark, items, tokens):
    schema = "question_id int, rank int, file_path string, chunk_type string, chunk_name string, content string, import_summary string"
    rows = context.pack_results(spark.createDataFrame([tuple(i.values()) for i in items], schema), tokens).collect()
    return rows[0].context if rows else None


def test_context(spark):
    assert packed(spark, [], 10) is None
    assert packed(spark, [item(1)], 1000) == "Path: src/very/long/path/number/1/file.ts\nfunction: name1\n```\n" + "x" * 300 + "\n```"
    assert "Imports:\nimport a\n```" in packed(spark, [item(1, import_summary=" import a\n")], 1000)
    first = packed(spark, [item(2), item(1)], 120)
    assert first.count("\n\n---\n\n") == 1
    assert first.index("name1") < first.index("name2")
    nulls = packed(spark, [item(1, file_path=None, chunk_type=None, chunk_name=None, content=None)], 100)
    assert nulls == "Path: \n: anonymous\n```\n\n```"


def test_context_of_little_room(spark):
    many = [item(k, content=f"{k}" * 300) for k in range(12)]
    for tokens in (1, 4, 16, 40, 120, 320, 2000):
        text = packed(spark, many, tokens)
        assert len(text) <= 4 * tokens
        shown = [k for k in range(12) if f"number/{k}/file.ts" in text]
        assert shown == list(range(len(shown)))
    # with narrower paths more results have room: 120 tokens hold 480 characters, a full header and its frame 58
    assert packed(spark, many, 120).count("Path: ") > 480 // (58 + 7)
    assert packed(spark, [item(1)], 3) == "fun\n```\n\n```"  # no room for a header
    assert packed(spark, [item(1)], 2) == ""
    assert packed(spark, [item(1)], 5) == "Path: src/v\n```\n\n```"


def test_config():
    assert Config.parse({}) == Config()
    cfg = Config.parse({"CHUNK_MAX_LENGTH": "12.9", "DEFAULT_TOP_K": "-1", "INDEX_IMPORT_SUMMARY": "YES", "RETRIEVAL_FUSION": " RRF ", "RETRIEVAL_RRF_EXPLAIN_BM25_WEIGHT": "3", "RETRIEVAL_QUERY_MODALITY": "force_pl", "RETRIEVAL_DENSE_TOP_N": "x", "RETRIEVAL_SPARSE_MODE": "full_table"})
    assert (cfg.chunk_max_length, cfg.top_k, cfg.index_import_summary, cfg.fusion) == (12, 5, True, "rrf")
    assert (cfg.rrf_explain_bm25_weight, cfg.query_modality, cfg.dense_top_n, cfg.sparse_mode) == (0.35, "force_pl", None, "full_table")
    assert [canonical_model_id(x) for x in ("local:/a/b/", "/m", "o/n", None)] == ["local:a/b", "file:/m", "o/n", "hashing"]
