"""Registered queries of the parts around retrieval: source trees, syntax chunks, summaries, configuration,
stored references, filters, and the service from import to delete.

Each has SQL that says the same of the test tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import config as C
from quarry.api import ADVICE, CODES, STATUS_LABELS, Engine, add_documents, answer_text, embed_and_persist, hashing_embedder
from quarry.functions import text as T
from quarry.functions.imports import summary
from quarry.operators import chunking, classify, dense, embed, evaluate, fusion, lexical, sparse, store
from quarry.plans.catalog import _ALL_Q, _CLASS, _EVAL, _Q, _RANK, REPOS, _asked, _bm25_cte, _dense_sql, _evaluated, all_questions, chunks, fts_index, query, questions, read, repos, shared_folder, vectors
from quarry.sources import files, trees
from quarry.streaming import indexing


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows that are much more work than they are bytes, dealt out to all cores: their table may be one file's one block."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


# --- filters of both channels ------------------------------------------------------------------------


@query(_dense_sql("q.label = e.label AND e.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def dense_repo_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return dense.top_k(v, _asked(v), 5, repo_col="repo_id", whitelist=read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query("SELECT vec_id AS question_id, 0 AS dense_hits, 0 AS sparse_hits, 0 AS scan_hits FROM embeddings WHERE vec_id % 50 = 0 AND vec_id IN (SELECT item_id FROM benchmark)")
def empty_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each channel for each question when no id may be found."""
    none = read(spark, sf_dir, "labels").where("false").select("doc_id")
    q = questions(spark, sf_dir).where("question_id % 50 = 0").withColumn("tokens", T.question_tokens(F.col("question")))
    c = chunks(spark, sf_dir)
    found = {"dense_hits": dense.top_k(vectors(spark, sf_dir), q, 5, whitelist=none), "sparse_hits": sparse.bm25(fts_index(spark, sf_dir), q, F.col("tokens"), 5, whitelist=none), "scan_hits": lexical.scan(c, q, 5, whitelist=none)}
    out = q.select("question_id")
    for name, hits in found.items():
        out = out.join(hits.groupBy("question_id").agg(F.count("*").cast("int").alias(name)), "question_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@query(
    f"""WITH {_Q}, {_bm25_cte('text', 'doc_id', 'documents')}, m AS (SELECT * FROM scored WHERE chunk_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT question_id, chunk_id, bm25, {_RANK} FROM m QUALIFY rank <= 20"""
)
def bm25_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).withColumn("tokens", T.question_tokens(F.col("question")))
    return sparse.bm25(fts_index(spark, sf_dir), q, F.col("tokens"), 20, whitelist=read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query(f"WITH t AS (SELECT doc_id, {T.sql_fts_terms('text')} AS t FROM documents), u AS (SELECT doc_id, len(t) AS length, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM t) SELECT term, doc_id AS chunk_id, length::INT AS length, count(*)::INT AS tf, min(pos)::INT AS first, max(pos)::INT AS last FROM u GROUP BY ALL")
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index: every term of every chunk."""
    p = fts_index(spark, sf_dir).postings()
    return p.select("term", "chunk_id", "length", F.size("positions").alias("tf"), F.col("positions")[0].alias("first"), F.element_at("positions", -1).alias("last"))


@query("SELECT label::BIGINT AS question_id, min(rank)::INT AS rank, chunk_id FROM (SELECT label, CASE WHEN vec_id % 7 = 0 THEN '' WHEN vec_id % 7 = 1 THEN NULL ELSE 'c' || vec_id % 11 END AS chunk_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings) WHERE chunk_id <> '' GROUP BY label, chunk_id")
def first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of lists with repeated, empty and missing ids: these hold their places but have no rank."""
    e = read(spark, sf_dir, "embeddings")
    name = F.when(F.col("vec_id") % 7 == 0, "").when(F.col("vec_id") % 7 == 1, None).otherwise(F.concat(F.lit("c"), (F.col("vec_id") % 11).cast("string")))
    from pyspark.sql import Window

    listed = e.select(F.col("label").cast("long").alias("question_id"), name.alias("chunk_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"))
    return fusion.first_ranks(listed, "rank").select("question_id", "rank", "chunk_id")


# --- classification under settings -------------------------------------------------------------------


def _forced(mode: str) -> str:
    return f"WITH {_ALL_Q}, {_CLASS}, f AS (SELECT question_id, intent, '{mode}' AS modality FROM c) SELECT question_id, modality, {classify.SQL_DEPTHS}, {classify.SQL_WEIGHTS} FROM f"


def _classified(spark: SparkSession, sf_dir: str, setting: str) -> DataFrame:
    cols = ("semantic_weight", "lexical_weight", "rrf_dense_weight", "rrf_bm25_weight")
    out = classify.classify(all_questions(spark, sf_dir), cfg=C.Config.parse({"RETRIEVAL_QUERY_MODALITY": setting}))
    return out.select("question_id", "modality", "dense_depth", "bm25_depth", "lexical_depth", *(F.round(c, 9).alias(c) for c in cols))


@query(_forced("nl"))
def forced_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "force_nl")


@query(_forced("pl"))
def forced_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "force_pl")


@query("SELECT l_orderkey, l_linenumber, l_quantity::INT - 10 AS k, l_quantity::INT - 10 BETWEEN 1 AND 20 AS allowed FROM lineitem")
def top_k_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_quantity").cast("int") - 10
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k.alias("k"), classify.allowed(k).alias("allowed"))


_CONFIG = "fusion, sparse_mode, chunk_max_length, top_k, dense_top_n, rrf_explain_bm25_weight, query_modality, embedding_model"
_CONFIG_TYPES = "fusion string, sparse_mode string, chunk_max_length int, top_k int, dense_top_n int, rrf_explain_bm25_weight double, query_modality string, embedding_model string"


def _parsed(settings: pd.Series) -> pd.DataFrame:
    parsed = [C.Config.parse(json.loads(x)) for x in settings]
    return pd.DataFrame({c: pd.Series([getattr(p, c) for p in parsed], dtype=object) for c in _CONFIG.split(", ")})


@query(
    """SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'rrf' ELSE 'weighted' END AS fusion, CASE WHEN p_partkey % 2 = 0 THEN 'full_table' ELSE 'fts' END AS sparse_mode,
CASE WHEN p_partkey % 4 = 3 THEN 1500 ELSE p_size * 20 END::INT AS chunk_max_length, CASE WHEN p_size > 5 THEN p_size - 5 ELSE 5 END::INT AS top_k, CASE WHEN p_partkey % 5 = 0 THEN p_size END::INT AS dense_top_n,
CASE WHEN p_size / 10.0 <= 2 THEN p_size / 10.0 ELSE 0.35 END::DOUBLE AS rrf_explain_bm25_weight, CASE p_partkey % 3 WHEN 0 THEN 'force_nl' WHEN 1 THEN 'force_pl' ELSE 'auto' END AS query_modality,
CASE p_partkey % 4 WHEN 0 THEN 'hashing' WHEN 1 THEN 'local:a/b' WHEN 2 THEN 'file:/m/' || p_partkey ELSE 'owner/n' || p_partkey END AS embedding_model FROM part"""
)
def configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of settings as texts for each part, parsed: what is missing or no good falls back to the default."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    pick = lambda n, *values: F.element_at(F.array(*(v if isinstance(v, F.Column) else F.lit(v) for v in values)), (k % n + 1).cast("int"))
    settings = F.struct(
        pick(3, " RRF ", "sum", "").alias("RETRIEVAL_FUSION"),
        pick(2, "full_table", "other").alias("RETRIEVAL_SPARSE_MODE"),
        F.when(k % 4 == 3, "x").otherwise(F.concat((F.col("p_size") * 20).cast("string"), F.lit(".7"))).alias("CHUNK_MAX_LENGTH"),
        (F.col("p_size") - 5).cast("string").alias("DEFAULT_TOP_K"),
        F.when(k % 5 == 0, size).alias("RETRIEVAL_DENSE_TOP_N"),
        (F.col("p_size") / 10).cast("string").alias("RETRIEVAL_RRF_EXPLAIN_BM25_WEIGHT"),
        pick(3, "force_nl", " FORCE_PL", "odd").alias("RETRIEVAL_QUERY_MODALITY"),
        pick(4, " ", " local:/a/b/ ", F.concat(F.lit("/m/"), k.cast("string")), F.concat(F.lit("owner/n"), k.cast("string"))).alias("EMBEDDING_MODEL"),
    )
    parsed = F.pandas_udf(_parsed, _CONFIG_TYPES)
    return read(spark, sf_dir, "part").select(k.alias("k"), parsed(F.to_json(settings)).alias("c")).select("k", "c.*")


# --- sources and chunks ------------------------------------------------------------------------------

_TREE = "t AS (SELECT n_nationkey AS k, (['src/n' || n_nationkey || '.ts', 'lib/sub/n' || n_nationkey || '.PY', 'node_modules/n' || n_nationkey || '.js', 'n' || n_nationkey || '.min.js', 'docs/n' || n_nationkey || '.md'])[n_nationkey % 5 + 1] AS path, 'name ' || n_name || chr(10) || 'region ' || n_regionkey AS content FROM nation)"
_TREE_WANTED = "SELECT path, content FROM t WHERE k % 5 < 2"


def nation_tree(spark: SparkSession, sf_dir: str) -> str:
    """A small source tree in the shared folder, a file for each nation: two wanted kinds, three that the rules
    leave out."""
    root = shared_folder(spark, "tree")
    system, folder = trees.opened(root)
    for r in read(spark, sf_dir, "nation").collect():  # 25 rows at every size
        k = r.n_nationkey
        place = (f"src/n{k}.ts", f"lib/sub/n{k}.PY", f"node_modules/n{k}.js", f"n{k}.min.js", f"docs/n{k}.md")[k % 5]
        system.create_dir(f"{folder}/{place}".rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(f"{folder}/{place}") as out:
            out.write(f"name {r.n_name}\nregion {r.n_regionkey}".encode())
    return root


@query(f"WITH {_TREE} {_TREE_WANTED}")
def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.source_files(spark, nation_tree(spark, sf_dir), "r", 1).select("path", "content")


@query(f"WITH {_TREE} SELECT sum(length(content))::BIGINT AS bytes, count(*) AS files FROM t")
def source_tree_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.tree_size(spark, nation_tree(spark, sf_dir))


@query("SELECT source AS directory, lang || '/' || doc_id || '.py' AS name, strlen(text) AS bytes, md5(text) AS md5 FROM documents WHERE lang <> 'en' UNION ALL SELECT source, lang || '/' || doc_id || '.ts', strlen(text), md5(text) FROM documents WHERE lang = 'en'")
def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree that Spark writes, and read back as one, a directory for each source."""
    root = shared_folder(spark, "documents")
    kind = F.when(F.col("lang") == "en", ".ts").otherwise(".py")
    rows = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), kind)).alias("path"), "text")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = trees.opened(root)
        for part in parts:
            for path, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                system.create_dir(f"{place}/{path.rsplit('/', 1)[0]}", recursive=True)
                with system.open_output_stream(f"{place}/{path}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64())], ["n"])

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    found = files.tree(spark, root)
    return found.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("directory"), F.regexp_extract("path", "^[^/]*/(.*)", 1).alias("name"), F.col("length").alias("bytes"), F.md5(F.col("content").cast("binary")).alias("md5"))


@query("SELECT 'q' || item_id AS question_id, 'c' || item_id % 3 AS category, text AS question, ['f' || item_id || '.ts'] AS expected_files, ['k' || item_id, 'x'] AS expected_keywords FROM benchmark")
def question_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question file written from the benchmark, read."""
    b, i = read(spark, sf_dir, "benchmark"), F.col("item_id").cast("string")
    item = F.struct(F.concat(F.lit("q"), i).alias("id"), F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"), F.col("text").alias("question"), F.array(F.concat(F.lit("f"), i, F.lit(".ts"))).alias("expectedFiles"), F.array(F.concat(F.lit("k"), i), F.lit("x")).alias("expectedKeywords"))
    place = shared_folder(spark, "questions")
    one = b.groupBy((F.col("item_id") % 16).alias("file")).agg(F.to_json(F.struct(F.collect_list(item).alias("questions"))).alias("value"))
    one.repartition(16, "file").drop("file").write.text(place)
    return files.question_set(spark, place, lines=True)


_CODE = {
    "ts": "import a from 'a';\nexport class C{k} extends Base {{\n  run(x: number): string {{ return `${{x}} }}`; }}\n  go = (y: T): void => {{ this.run(y); }};\n}}\nexport function f{k}(a, b) {{\n  const re = /[{{]/;\n  return a;\n}}\ninterface I {{ m(z: string): void; }}\n",
    "py": "import os\n\nclass C{k}:\n    def run(self):\n        return 1\n\nasync def f{k}(a):\n    return lambda x: x\n",
    "js": "// no class here\nconst s = 'class X {{}}';\nfoo({k});\n",
}
_CODE_NODES = {
    "ts": (("class", "C{k}", 2, 5), ("class", None, 2, 2), ("function", "run", 3, 3), ("function", None, 4, 4), ("function", "f{k}", 6, 9), ("function", "m", 10, 10)),
    "py": (("class", "C{k}", 3, 5), ("function", "run", 4, 5), ("function", "f{k}", 7, 8)),
    "js": (("generic", "generic_1", 1, 4),),
}
_KINDS = tuple(_CODE)


def _nodes_sql() -> str:
    name = lambda n: "NULL" if n is None else f"replace('{n}', '{{k}}', p_partkey::VARCHAR)"
    return " UNION ALL ".join(f"SELECT 'p' || p_partkey || '.{kind}' AS file_path, '{t}' AS chunk_type, {name(n)} AS chunk_name, {a}::INT AS start_line, {b}::INT AS end_line FROM part WHERE p_partkey % 3 = {k}" for k, kind in enumerate(_KINDS) for t, n, a, b in _CODE_NODES[kind])


@query(_nodes_sql())
def chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, functions, methods, arrow functions, heritage and signatures of a source file for each part."""
    p, k = dealt(read(spark, sf_dir, "part").select("p_partkey")), F.col("p_partkey")
    code = [F.replace(F.lit(_CODE[kind].format(k="\0")), F.lit("\0"), k.cast("string")) for kind in _KINDS]
    path = F.concat(F.lit("p"), k.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _KINDS)), (k % 3 + 1).cast("int")))
    source = p.select(F.lit("r").alias("repo_id"), path.alias("path"), F.when(k % 3 == 0, code[0]).when(k % 3 == 1, code[1]).otherwise(code[2]).alias("content"))
    return chunking.chunk_files(source).select("file_path", "chunk_type", "chunk_name", "start_line", "end_line")


@query("SELECT 'c' || conv_id AS repo_id, conv_id || '-' || turn || '.txt' AS file_path, 'generic' AS chunk_type, 'generic_1' AS chunk_name, 1::INT AS start_line, len(string_split(text, chr(10)))::INT AS end_line, md5(text) AS md5 FROM conversations WHERE length(text) <= 3000")
def chunk_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a file of one chunk: none is over the limit of 3000 characters."""
    c = read(spark, sf_dir, "conversations")
    turns = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("repo_id"), F.concat(F.concat_ws("-", "conv_id", "turn"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    out = chunking.chunk_files(turns, C.Config(chunk_max_length=3000))
    return out.select("repo_id", "file_path", "chunk_type", "chunk_name", "start_line", "end_line", F.md5(F.col("content").cast("binary")).alias("md5"))


_IMPORTS = (
    ("ts", "// note\n\nimport a{k} from 'a';\nexport {{ b }} from './b';\nconst x = 1;\nimport late from 'c';", "import a{k} from 'a';\nexport {{ b }} from './b';"),
    ("py", '#!/usr/bin/env python\n"""Doc.\nimport no\n"""\nfrom os import path\nimport m{k}\n\nimport late', "from os import path\nimport m{k}"),
    ("go", 'package main\n\nimport (\n\t"fmt"\n\t"m{k}"\n)\n\nfunc main() {{}}', 'import (\n\t"fmt"\n\t"m{k}"\n)'),
    ("js", "'use strict'\nconst a{k} = 1;\nimport b from 'b'", ""),
)


def _filled(texts: list[str], key: F.Column, place: F.Column) -> F.Column:
    each = [F.replace(F.lit(t.format(k="\0")), F.lit("\0"), key) for t in texts]
    return F.element_at(F.array(*each), place)


@query("SELECT p_partkey AS k, replace((["
       + ", ".join(T.quoted(x[2].format(k="{k}")) for x in _IMPORTS)
       + "])[p_partkey % 4 + 1], '{k}', p_partkey::VARCHAR) AS summary FROM part")
def import_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of preambles, docstrings, groups and files without imports."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    place = (k % 4 + 1).cast("int")
    path = F.concat(F.lit("x."), F.element_at(F.array(*(F.lit(x[0]) for x in _IMPORTS)), place))
    content = _filled([x[1] for x in _IMPORTS], k.cast("string"), place)
    return p.select(k.alias("k"), F.coalesce(summary(content, path), F.lit("")).alias("summary"))


# --- references, answers, labels ---------------------------------------------------------------------


@query(
    """WITH r AS (SELECT vec_id, '[{"chunk_id":"c' || vec_id || '","file_path":"p","snippet":"s","score":0.5}]' AS refs, CASE vec_id % 3 WHEN 0 THEN 'rrf' WHEN 1 THEN 'weighted' END AS mode FROM embeddings)
SELECT vec_id, CASE WHEN mode IS NULL THEN refs ELSE '{"references":' || refs || ',"retrieval_fusion":"' || mode || '"}' END AS json FROM r"""
)
def stored_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    one = F.struct(F.concat(F.lit("c"), v.cast("string")).alias("chunk_id"), F.lit("p").alias("file_path"), F.lit("s").alias("snippet"), F.lit(0.5).alias("score"))
    mode = F.when(v % 3 == 0, "rrf").when(v % 3 == 1, "weighted")
    return read(spark, sf_dir, "embeddings").select("vec_id", store.serialize_references(F.array(one), mode).alias("json"))


@query("SELECT conv_id, turn, md5(CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN text || '|' || role WHEN 2 THEN text ELSE '' END) AS md5 FROM conversations")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a model's answer in one of five forms: a text, parts, parts of which some are no text, an object, nothing."""
    t, r, k = F.col("text"), F.col("role"), F.col("turn") % 5
    part = lambda text: F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))
    plain = lambda text: F.expr(f"substring(to_json(array({text})), 2, length(to_json(array({text}))) - 2)")
    parts = F.concat(F.lit("["), plain("text"), F.lit(', "|", '), part(r), F.lit("]"))
    odd = F.concat(F.lit('[{"type": "image"}, 3, '), part(t), F.lit("]"))
    content = F.when(k == 0, plain("text")).when(k == 1, parts).when(k == 2, odd).when(k == 3, part(t)).otherwise("null")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(answer_text(content).cast("binary")).alias("md5"))


@query(f"WITH {REPOS} SELECT id, CASE status WHEN 'indexing' THEN '索引中' ELSE '已索引' END AS label FROM repos")
def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(*(F.lit(x) for pair in STATUS_LABELS.items() for x in pair))
    return repos(spark, sf_dir).select("id", labels[F.col("status")].alias("label"))


_CODE_LIST = (0, 1001, 1002, 1003, 1004, 2001, 2002, 3001, 4001, 4002, 4003, 5000)


@query(f"WITH e AS (SELECT ([{', '.join(map(str, _CODE_LIST))}])[user_id % 12 + 1] AS code FROM events) SELECT code::INT AS code, count(*) AS n, code IN (1002, 1003, 1004, 2001, 3001, 4001, 4002, 4003) AS friendly FROM e GROUP BY code")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the events' codes occur, and whether there is advice on them."""
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("user_id") % 12 + 1).cast("int"))
    return read(spark, sf_dir, "events").groupBy(code.alias("code")).agg(F.count("*").alias("n")).withColumn("friendly", F.col("code").isin(*ADVICE))


@query(
    f"""WITH {_EVAL}, s AS (SELECT count(*) AS total, sum((keyword_hit OR file_hit)::INT) AS matched, avg((keyword_hit OR file_hit)::INT::DOUBLE) * 100 AS rate FROM e),
l AS (SELECT 0 AS part, 0 AS question_id, '# Evaluation' AS line UNION ALL SELECT 1, 0, '' UNION ALL SELECT 2, 0, printf('Matched %d of %d (%.2f%%).', matched::BIGINT, total, rate) FROM s UNION ALL SELECT 3, 0, '' UNION ALL SELECT 4, 0, '| question | keyword | file | matched |' UNION ALL SELECT 5, 0, '|---|---|---|---|'
UNION ALL SELECT 6, question_id, '| ' || question_id || ' | ' || CASE WHEN keyword_hit THEN 'yes' ELSE 'no' END || ' | ' || CASE WHEN file_hit THEN 'yes' ELSE 'no' END || ' | ' || CASE WHEN keyword_hit OR file_hit THEN 'yes' ELSE 'no' END || ' |' FROM e)
SELECT row_number() OVER (ORDER BY part, question_id)::INT AS n, line FROM l"""
)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = evaluate.report(_evaluated(spark, sf_dir)).rstrip("\n").split("\n")
    return _rows(spark, list(enumerate(lines, 1)), "n int, line string")


# --- the service -------------------------------------------------------------------------------------

_STEPS = """steps AS (SELECT * FROM (VALUES
 (1, 'health', 0, 0), (2, 'import', 0, 10), (3, 'import again', 1002, 0), (4, 'import nothing', 1001, 0), (5, 'status loaded', 0, 10), (6, 'ask too early', 2001, 0),
 (7, 'build', 0, 10), (8, 'build again', 2002, 0), (9, 'indexed', 0, 1), (10, 'ask', 0, 3), (11, 'ask of nothing allowed', 3001, 0), (12, 'ask by another model', 4003, 0),
 (13, 'ask of an unknown one', 1003, 0), (14, 'message', 0, 0), (15, 'error', 0, 0), (16, 'history', 0, 2), (17, 'clear', 0, 2), (18, 'history after', 0, 0), (19, 'forget files', 0, 10),
 (20, 'files again', 0, 10), (21, 'reload', 0, 10), (22, 'list', 0, 1), (23, 'dimension', 0, 64), (24, 'delete', 0, 10), (25, 'status gone', 1003, 0), (26, 'left', 0, 0)) v(step, what, code, n))"""


@query(f"WITH {_TREE}, {_STEPS} SELECT step, what, code, CASE WHEN n = 10 THEN (SELECT count(*)::INT FROM ({_TREE_WANTED})) ELSE n END AS n FROM steps")
def service_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository from import to delete through the service, each step with its code and a count."""
    root = nation_tree(spark, sf_dir)
    place = shared_folder(spark, "store")
    e = Engine(spark, place)
    out: list[tuple[str, int, int]] = []

    def step(what: str, got: dict, n=lambda data: 0) -> dict:
        out.append((what, got["code"], int(n(got["data"])) if got["code"] == 0 else 0))
        return got

    step("health", e.health())
    repo = step("import", e.import_repo(root + "/"), lambda d: d["file_count"])["data"]["repo_id"]
    step("import again", e.import_repo(root))
    step("import nothing", e.import_repo(root + "/none"))
    step("status loaded", e.status(repo), lambda d: d["file_count"] if d["status"] == "loaded" else -1)
    asked = _rows(spark, [(1, repo, "where is the name of nation")], "question_id int, repo_id string, question string")
    step("ask too early", e.ask(asked))
    step("build", e.build_index(repo), lambda d: d["chunk_count"])
    step("build again", e.build_index(repo))
    out.append(("indexed", 0, e.indexed()[0].count()))
    step("ask", e.ask(asked, 3), lambda d: len(d.first()["references"]))
    step("ask of nothing allowed", e.ask(asked, 3, _rows(spark, [], "id string")))
    step("ask by another model", Engine(spark, place, C.Config(embedding_model="other")).ask(asked))
    step("ask of an unknown one", e.ask(asked.withColumn("repo_id", F.lit("none"))))
    step("message", e.save_message(repo, "user", "hi"))
    step("error", e.save_message(repo, "error", "no", "[]"))
    step("history", e.history(repo), lambda d: d.where("references_json is null").count())
    step("clear", e.clear_history(repo), lambda d: d["deleted"])
    step("history after", e.history(repo), lambda d: d.count())
    out.append(("forget files", 0, e.forget_files(repo)))
    out.append(("files again", 0, e.store.read("files", repo).count() if e.ensure_files(repo) else -1))
    step("reload", e.reload(repo), lambda d: d["chunk_count"])
    step("list", e.repos(), lambda d: d.count())
    out.append(("dimension", 0, e.guard(repo)["dimension"]))
    step("delete", e.delete_repo(repo), lambda d: d["deleted"]["chunks"])
    step("status gone", e.status(repo))
    out.append(("left", 0, sum(e.store.read(t, repo).count() for t in ("repos", "files", "chunks", "embeddings", "segments", "chat_history"))))
    return _rows(spark, [(k, *x) for k, x in enumerate(out, 1)], "step int, what string, code int, n int")


def _filled_engine(spark: SparkSession, sf_dir: str, answerer=None) -> tuple[Engine, str]:
    """All documents as the files of one repository; each is one chunk."""
    e = Engine(spark, shared_folder(spark, "store"), C.Config(chunk_max_length=1 << 30), answerer=answerer)
    now = F.current_timestamp()
    repo = _rows(spark, [("all", "/all", "local", "loaded", 0, 0, None, None)], "id string, path string, type string, status string, file_count long, chunk_count long, embedding_model_id string, embedding_dimension int")
    e.store.append("repos", repo.withColumns({"created_at": now, "updated_at": now}))
    e.store.append("files", chunks(spark, sf_dir).select(F.lit("all").alias("repo_id"), F.col("file_path").alias("path"), "content"))
    return e, "all"


@query(
    f"""WITH {_Q}, aq AS (SELECT item_id AS question_id, text AS question FROM benchmark), {_CLASS}, k AS (SELECT question_id, {classify.SQL_DEPTHS} FROM c), n AS (SELECT count(*) AS docs FROM documents)
SELECT 'chunk' AS event_type, 'chunks' AS name, docs::BIGINT AS n FROM n UNION ALL SELECT 'embed', 'vectors', docs FROM n UNION ALL SELECT 'store', 'chunks', docs FROM n UNION ALL SELECT 'store', 'embeddings', docs FROM n
UNION ALL SELECT 'retrieve', 'dense', sum(dense_depth)::BIGINT FROM k UNION ALL SELECT 'retrieve', 'kept', 5 * count(*) FROM k"""
)
def engine_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine's stages counted themselves while it indexed all documents and answered all questions."""
    e, repo = _filled_engine(spark, sf_dir)
    e.build_index(repo)
    e.ask(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.lit(repo).alias("repo_id"), F.col("text").alias("question")))
    log = e.stage_log().select("event_type", F.explode("counts").alias("name", "n"))
    return log.where("name in ('chunks', 'vectors', 'embeddings', 'dense', 'kept')")


@query("SELECT item_id AS question_id, item_id % 2 = 0 AS keyword_hit, item_id % 5 = 1 AS file_hit, item_id % 2 = 0 OR item_id % 5 = 1 AS matched FROM benchmark")
def acceptance_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents asked the benchmark's questions: answers hold the expected word of every second question,
    references a file that every fifth expects."""
    e, repo = _filled_engine(spark, sf_dir, answerer=lambda prompt: "An answer with KEYWORD.")
    e.ensure_indexed(repo)
    i = F.col("item_id")
    item = F.struct(i.cast("string").alias("id"), F.lit("c").alias("category"), F.col("text").alias("question"), F.array(F.when(i % 5 == 1, ".txt").otherwise("none.go")).alias("expectedFiles"), F.array(F.when(i % 2 == 0, "keyword").otherwise("absent")).alias("expectedKeywords"))
    place = shared_folder(spark, "questions")
    read(spark, sf_dir, "benchmark").groupBy((i % 16).alias("file")).agg(F.to_json(F.struct(F.collect_list(item).alias("questions"))).alias("value")).drop("file").write.text(place)
    return e.acceptance(repo, place, lines=True)["data"]["results"].withColumn("question_id", F.col("question_id").cast("long")).select("question_id", "keyword_hit", "file_hit", "matched")


@query(
    f"""WITH {_Q}, {_bm25_cte('text', 'doc_id', 'documents')}, m AS (SELECT s.* FROM scored s JOIN documents d ON d.doc_id = s.chunk_id WHERE d.source = CASE WHEN question_id % 2 = 0 THEN 'src3' ELSE 'src7' END)
SELECT question_id, chunk_id, bm25, {_RANK} FROM m QUALIFY rank <= 20"""
)
def bm25_two_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to two of many repositories, of segments stored by repository: those of the others are not scored, but
    their counts are part of the statistics."""
    s = store.Store(spark, shared_folder(spark, "store"))
    c = chunks(spark, sf_dir).repartition("repo_id").sortWithinPartitions("repo_id", "chunk_id")
    s.append("segments", sparse.Index.by_repository(c, F.col("content")).rows)
    q = questions(spark, sf_dir).withColumn("tokens", T.question_tokens(F.col("question")))
    q = q.withColumn("repo_id", F.when(F.col("question_id") % 2 == 0, "src3").otherwise("src7"))
    return sparse.bm25(sparse.Index(s.read("segments")), q, F.col("tokens"), 20, repo=True)


# --- vectors and increments --------------------------------------------------------------------------


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, i = read(spark, sf_dir, "benchmark"), F.col("item_id")
    return b.select(F.concat(F.lit("b"), i.cast("string")).alias("chunk_id"), F.concat(F.lit("r"), (i % 3).cast("string")).alias("repo_id"), F.col("text").alias("body"))


@query("SELECT 'r' || item_id % 3 AS repo_id, count(*) AS n, 16 AS dimension FROM benchmark GROUP BY 1")
def persisted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as JSON lines by repository, read back."""
    place = shared_folder(spark, "vectors")
    embed_and_persist(_bodies(spark, sf_dir), "body", hashing_embedder(16), f"{place}/v")
    v = spark.read.schema("chunk_id string, embedding array<float>, repo_id string").json(f"{place}/v")
    return v.groupBy("repo_id").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dimension"))


@query("SELECT 'b' || item_id AS chunk_id, 'r' || item_id % 3 AS repo_id, CASE WHEN item_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM benchmark UNION ALL SELECT 'old', 'r9', 0.0")
def added_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second chunk embedded anew: its vector of length one replaces the zeros there were."""
    rows = _bodies(spark, sf_dir)
    old = rows.select("chunk_id", "repo_id", F.array(F.lit(0.0).cast("float")).alias("embedding")).unionByName(_rows(spark, [("old", "r9", [0.0])], "chunk_id string, repo_id string, embedding array<float>"))
    new = rows.where(F.substring("chunk_id", 2, 20).cast("long") % 2 == 0)
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return add_documents(old, new, "body", hashing_embedder(16)).select("chunk_id", "repo_id", F.round(norm, 5).alias("norm"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM documents),
m AS (SELECT doc_id, avg(length(w)) AS a, avg(ascii(w)) AS b, avg(length(w) - length(translate(w, 'aeiou', ''))) AS c FROM w GROUP BY doc_id)
SELECT doc_id AS chunk_id, round(a / sqrt(a * a + b * b + c * c + 1), 4)::DOUBLE AS length, round(b / sqrt(a * a + b * b + c * c + 1), 4)::DOUBLE AS first, round(c / sqrt(a * a + b * b + c * c + 1), 4)::DOUBLE AS vowels FROM m"""
)
def embedded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-pooled vectors of length one, by a model that workers load."""
    rows = chunks(spark, sf_dir).select("chunk_id", "content")
    v = lambda k: F.round(F.col("embedding")[k].cast("double"), 4)
    return embed.embed_rows(rows, "content", embed.WordShapes()).select("chunk_id", v(0).alias("length"), v(1).alias("first"), v(2).alias("vowels"))


_STREAMED = T.sql_fts_terms("'File: ' || item_id || '.txt' || chr(10) || 'generic: generic_1' || chr(10) || chr(10) || body")


@query(
    f"""WITH b AS (SELECT item_id, CASE WHEN item_id % 4 = 1 THEN 'changed ' || text ELSE text END AS body FROM benchmark WHERE item_id % 4 <> 2), t AS (SELECT 'r' || item_id % 3 AS repo_id, item_id, {_STREAMED} AS t FROM b)
SELECT repo_id, count(*) AS chunks, sum(len(list_distinct(t)))::BIGINT AS postings, sum(len(t))::BIGINT AS places FROM t GROUP BY 1"""
)
def streamed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive in two batches, indexed as they come: of every four the second has changed and the third is gone in batch
    two, the fourth comes then, and the first comes twice as it is."""
    place = shared_folder(spark, "stream")
    b, i = read(spark, sf_dir, "benchmark"), F.col("item_id")
    rows = lambda version, content: b.select(F.concat(F.lit("r"), (i % 3).cast("string")).alias("repo_id"), F.concat(i.cast("string"), F.lit(".txt")).alias("path"), F.lit(version).cast("long").alias("version"), content.alias("content"), (i % 4).alias("part"))
    first = rows(1, F.col("text")).where("part < 3").drop("part")
    then = F.when(i % 4 == 1, F.concat(F.lit("changed "), "text")).when(i % 4 != 2, F.col("text"))
    for arriving in (first, rows(2, then).drop("part")):
        arriving.write.mode("append").parquet(f"{place}/in")
        indexing.index_files(spark, f"{place}/in", f"{place}/out", f"{place}/checkpoint").awaitTermination()
    s = store.Store(spark, f"{place}/out")
    chunks_ = s.read("chunks").groupBy("repo_id").agg(F.count("*").alias("chunks"))
    terms = sparse.Index(s.read("segments")).postings("string").groupBy("repo_id").agg(F.count("*").alias("postings"), F.sum(F.size("positions")).alias("places"))
    return chunks_.join(terms, "repo_id")
