"""Registered queries over the test tables, and the SQL that an independent engine runs for each.

How the tables stand for the engine's: a document is a chunk and a file of the repository ``source``
(path ``source/lang/doc_id.txt``), embeddings are chunk vectors (``vec_id`` is a chunk's id, ``label`` its
repository), benchmark items are questions, conversations are chat history, pages are files whose URL is
their path, events are the log."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, classify, context, dense, evaluate, fusion, lexical, retrieve, sparse, store
from quarry.sources import tables
from quarry.streaming import indexing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    kind = F.when(i % 3 == 0, "function").when(i % 3 == 1, "class").otherwise("generic")
    return d.select(
        i.alias("chunk_id"),
        F.col("source").alias("repo_id"),
        F.concat_ws("/", "source", "lang", F.concat(i.cast("string"), F.lit(".txt"))).alias("file_path"),
        F.col("text").alias("content"),
        kind.alias("chunk_type"),
        F.when(i % 5 != 0, F.concat(F.lit("n"), (i % 7).cast("string"))).alias("chunk_name"),
        F.when(i % 4 != 0, (i % 100).cast("int")).alias("start_line"),
        F.when(i % 4 != 0, (i % 100 + 9).cast("int")).alias("end_line"),
    )


CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, source AS repo_id, source || '/' || lang || '/' || doc_id || '.txt' AS file_path, text AS content,
  CASE WHEN doc_id % 3 = 0 THEN 'function' WHEN doc_id % 3 = 1 THEN 'class' ELSE 'generic' END AS chunk_type,
  CASE WHEN doc_id % 5 <> 0 THEN 'n' || (doc_id % 7) END AS chunk_name,
  CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 100)::INT END AS start_line, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 100 + 9)::INT END AS end_line FROM documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, each with the vector of its own number."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return b.join(v, "question_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("repo_id"))


_indexes: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the one that ``spark.checkpoint.dir`` names; on a single machine that names none, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared.rstrip('/') if shared else Path(tempfile.mkdtemp(prefix='spark-')).as_uri()}/{name}-{uuid.uuid4().hex}"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as chunks, their URLs being what is searched."""
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("chunk_id"), F.col("url").alias("content"))


def fts_index(spark: SparkSession, sf_dir: str, of: Callable[[SparkSession, str], DataFrame] = chunks) -> sparse.Index:
    """The full-text index of the documents, or of others, stored by the first query of a session that needs it."""
    key = spark.sparkContext.applicationId, sf_dir, of.__name__
    if key not in _indexes:
        path = shared_folder(spark, "fts")
        sparse.Index.of(sparse.spread(of(spark, sf_dir))).write(path)
        _indexes[key] = path
    return sparse.Index.read(spark, _indexes[key])


# --- dense -------------------------------------------------------------------------------------------


def _asked(v: DataFrame) -> DataFrame:
    return v.where(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("vector"), "repo_id")


def _dense_sql(where: str) -> str:
    return f"""SELECT q.vec_id AS question_id, e.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id)::INT AS rank
FROM embeddings q JOIN embeddings e ON {where} WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5"""


@query(_dense_sql("true"))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return dense.top_k(v, _asked(v), 5)


@query(_dense_sql("q.label = e.label"))
def dense_topk_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return dense.top_k(v, _asked(v), 5, repo_col="repo_id")


@query(_dense_sql("e.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def dense_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return dense.top_k(v, _asked(v), 5, whitelist=read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query(
    """WITH e AS (SELECT *, CASE WHEN label % 3 = 1 AND vec_id % 2 = 0 THEN 'other' ELSE 'hashing' END AS model FROM embeddings)
SELECT label::VARCHAR AS repo_id, count(*) AS n_vectors, count(DISTINCT model) AS n_models, count(DISTINCT len(embedding)) AS n_dimensions, min(model) AS model,
  min(len(embedding))::INT AS dimension, count(DISTINCT len(embedding)) = 1 AND count(DISTINCT model) = 1 AS uniform FROM e GROUP BY label"""
)
def embedding_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third repository has vectors of two models."""
    two = (F.col("repo_id").cast("int") % 3 == 1) & (F.col("chunk_id") % 2 == 0)
    return dense.fingerprint(vectors(spark, sf_dir).withColumn("model", F.when(two, "other").otherwise("hashing")))


# --- sparse ------------------------------------------------------------------------------------------

_TERMS = f"terms AS (SELECT doc_id, {T.sql_fts_terms('text')} AS t FROM documents)"


@query(f"WITH {_TERMS} SELECT count(*) AS n_chunks, sum(len(t))::BIGINT AS n_terms, round(avg(len(t)), 6) AS avg_length FROM terms")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.corpus_stats(chunks(spark, sf_dir), F.col("content")).withColumn("avg_length", F.round("avg_length", 6))


@query(f"WITH {_TERMS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(t) AS term FROM terms) GROUP BY term")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.document_frequency(chunks(spark, sf_dir), F.col("content"))


_Q = f"""q AS (SELECT item_id AS question_id, text AS question, {T.sql_question_tokens('text')} AS tokens FROM benchmark),
qt AS (SELECT DISTINCT question_id, unnest(tokens) AS token FROM q)"""


def _bm25_cte(body: str, ids: str, source: str, tokens: str = "qt") -> str:
    """Phrases are found as runs of terms between single spaces."""
    return f"""body AS (SELECT {ids} AS chunk_id, {T.sql_fts_terms(body)} AS t FROM {source}),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM body),
ph AS (SELECT DISTINCT token AS phrase, {T.sql_fts_terms('token')} AS pt FROM {tokens}),
post AS (SELECT chunk_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM body),
pterm AS (SELECT phrase, len(pt) AS width, unnest(pt) AS term, generate_subscripts(pt, 1) AS off FROM ph),
occ AS (SELECT phrase, width, chunk_id, pos - off AS start FROM post JOIN pterm USING (term) GROUP BY ALL HAVING count(*) = width),
tf AS (SELECT phrase, chunk_id, count(*) AS tf FROM occ GROUP BY ALL),
idf AS (SELECT phrase, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) > 0 THEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf FROM tf, stats GROUP BY phrase, n),
scored AS (SELECT question_id, tf.chunk_id, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))), 6) AS bm25, count(*) AS n_phrases
  FROM {tokens} JOIN tf ON phrase = token JOIN idf USING (phrase) JOIN body ON body.chunk_id = tf.chunk_id, stats GROUP BY question_id, tf.chunk_id)"""


_RANK = "row_number() OVER (PARTITION BY question_id ORDER BY bm25, chunk_id)::INT AS rank"


@query(f"WITH {_Q}, {_bm25_cte('text', 'doc_id', 'documents')} SELECT question_id, chunk_id, bm25, {_RANK} FROM scored QUALIFY rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).withColumn("tokens", T.question_tokens(F.col("question")))
    return sparse.bm25(fts_index(spark, sf_dir), q, F.col("tokens"), 20)


@query(
    f"""WITH {_Q}, {_bm25_cte('text', 'doc_id', 'documents')}, m AS (SELECT s.* FROM scored s JOIN documents d ON d.doc_id = s.chunk_id WHERE d.source = 'src' || (question_id % 20))
SELECT question_id, chunk_id, bm25, {_RANK} FROM m QUALIFY rank <= 20"""
)
def bm25_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).withColumn("tokens", T.question_tokens(F.col("question")))
    q = q.withColumn("repo_id", F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string")))
    return sparse.bm25(fts_index(spark, sf_dir), q, F.col("tokens"), 20, repo=True)


_PAGE_Q = r"pq AS (SELECT page_id AS question_id, regexp_extract(url, '^https?://([^/]+/[^/]+)', 1) AS token FROM pages)"


@query(f"WITH {_PAGE_Q}, {_bm25_cte('url', 'page_id', 'pages', 'pq')} SELECT question_id, chunk_id, bm25, {_RANK} FROM scored QUALIFY rank <= 5")
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and first directory of each page as one phrase, against all URLs."""
    q = pages(spark, sf_dir).select(F.col("chunk_id").alias("question_id"), F.array(F.regexp_extract("content", "^https?://([^/]+/[^/]+)", 1)).alias("tokens"))
    return sparse.bm25(fts_index(spark, sf_dir, pages), q, F.col("tokens"), 5)


@query(
    f"""WITH aq AS (SELECT item_id AS question_id, unnest({T.sql_fts_terms('text')}) AS token FROM benchmark), au AS (SELECT DISTINCT * FROM aq),
{_bm25_cte('text', 'doc_id', 'documents', 'au')}, need AS (SELECT question_id, count(*) AS need FROM au GROUP BY 1), m AS (SELECT s.* FROM scored s JOIN need USING (question_id) WHERE n_phrases = need)
SELECT question_id, chunk_id, bm25, {_RANK} FROM m QUALIFY rank <= 20"""
)
def bm25_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of a question must occur."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.array_distinct(T.fts_terms(F.col("text"))).alias("tokens"))
    return sparse.bm25(fts_index(spark, sf_dir), q, F.col("tokens"), 20, match_all=True)


def _hits(text: str) -> str:
    return f"len(regexp_extract_all({text}, '(^|[^a-z0-9_])' || replace(token, '.', '\\.') || '([^a-z0-9_]|\\z)'))"


@query(
    f"""WITH {_Q}, p AS (SELECT page_id, url, lower(url) AS u, lower(html) AS h FROM pages),
s AS (SELECT question_id, page_id AS chunk_id, url, sum((CASE WHEN contains(u, token) THEN CASE WHEN {_hits('u')} > 0 THEN {_hits('u')} ELSE 1 END ELSE 0 END) * 4.0
  + (CASE WHEN contains(h, token) THEN {_hits('h')} ELSE 0 END) * 0.5)::DOUBLE AS score FROM qt, p GROUP BY ALL)
SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, url, chunk_id)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 20"""
)
def lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    files = p.select(F.col("page_id").alias("chunk_id"), F.col("url").alias("file_path"), F.lit(None).cast("string").alias("chunk_name"), F.lit(0).alias("start_line"), F.col("html").alias("content"))
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), T.question_tokens(F.col("text")).alias("tokens"))
    return lexical.scan(files, q, 20)


# --- classification ----------------------------------------------------------------------------------

_ALL_Q = """aq AS (SELECT 'b' || item_id AS question_id, text AS question FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations UNION ALL SELECT 'u' || page_id, url FROM pages
  UNION ALL SELECT 'e' || event_id, props FROM events)"""


def all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every short text of the tables as a question: prose, chat turns, URLs, JSON."""
    text = lambda name, key, col: read(spark, sf_dir, name).select(key.alias("question_id"), F.col(col).alias("question"))
    c = lambda prefix, *cols: F.concat(F.lit(prefix), *(x if not isinstance(x, str) else F.col(x).cast("string") for x in cols))
    return text("benchmark", c("b", "item_id"), "text").unionByName(text("conversations", c("c", "conv_id", F.lit("-"), "turn"), "text")).unionByName(text("pages", c("u", "page_id"), "url")).unionByName(text("events", c("e", "event_id"), "props"))


@query(f"WITH {_ALL_Q} SELECT question_id, CASE WHEN regexp_matches(lower(question), '{T.LOCATE}') THEN 'locate' ELSE 'explain' END AS intent FROM aq")
def question_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_questions(spark, sf_dir).select("question_id", T.detect_intent(F.col("question")).alias("intent"))


@query(f"WITH {_ALL_Q} SELECT question_id, {classify.sql_modality('question')} AS modality FROM aq")
def question_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_questions(spark, sf_dir).select("question_id", classify.modality(F.col("question")).alias("modality"))


@query(
    f"""WITH {_ALL_Q}, t AS (SELECT question_id, {T.sql_question_tokens('question')} AS tokens FROM aq),
u AS (SELECT question_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS k FROM t), f AS (SELECT question_id, token, min(k) AS k FROM u GROUP BY ALL)
SELECT question_id, string_agg('"' || token || '"', ' OR ' ORDER BY k) AS match FROM f GROUP BY question_id UNION ALL SELECT question_id, NULL FROM t WHERE len(tokens) = 0"""
)
def or_match_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_questions(spark, sf_dir).select("question_id", T.or_match(T.question_tokens(F.col("question"))).alias("match"))


@query(
    f"""WITH {_ALL_Q}, t AS (SELECT question_id, regexp_extract_all(trim(question), '{T.MATCH_TOKEN}') AS tokens FROM aq),
u AS (SELECT question_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS k FROM t), f AS (SELECT question_id, min_by(token, k) AS token, min(k) AS k FROM u GROUP BY question_id, lower(token))
SELECT question_id, string_agg('"' || token || '"', ' ' ORDER BY k) AS match FROM f GROUP BY question_id UNION ALL SELECT question_id, NULL FROM t WHERE len(tokens) = 0"""
)
def and_match_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_questions(spark, sf_dir).select("question_id", T.and_match(F.col("question")).alias("match"))


_CLASS = f"c AS (SELECT question_id, CASE WHEN regexp_matches(lower(question), '{T.LOCATE}') THEN 'locate' ELSE 'explain' END AS intent, {classify.sql_modality('question')} AS modality FROM aq)"


@query(f"WITH {_ALL_Q}, {_CLASS} SELECT question_id, {classify.SQL_DEPTHS} FROM c")
def recall_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(all_questions(spark, sf_dir)).select("question_id", "dense_depth", "bm25_depth", "lexical_depth")


@query(f"WITH {_ALL_Q}, {_CLASS} SELECT question_id, intent, modality, {classify.SQL_WEIGHTS} FROM c")
def fusion_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("semantic_weight", "lexical_weight", "rrf_dense_weight", "rrf_bm25_weight")
    return classify.classify(all_questions(spark, sf_dir)).select("question_id", "intent", "modality", *(F.round(c, 9).alias(c) for c in cols))


# --- fusion ------------------------------------------------------------------------------------------

_CHANNELS = f"""{_Q}, aq AS (SELECT item_id AS question_id, text AS question FROM benchmark), {_CLASS}, k AS (SELECT question_id, intent, modality, {classify.SQL_DEPTHS}, {classify.SQL_WEIGHTS} FROM c),
{_bm25_cte('text', 'doc_id', 'documents')},
d0 AS (SELECT b.vec_id AS question_id, e.vec_id AS chunk_id, round(list_cosine_similarity(b.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings b JOIN benchmark ON item_id = b.vec_id, embeddings e),
d AS (SELECT d0.*, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM d0 JOIN k USING (question_id) QUALIFY rank <= dense_depth),
s0 AS (SELECT scored.*, row_number() OVER (PARTITION BY question_id ORDER BY bm25, chunk_id) AS rank FROM scored JOIN k USING (question_id) QUALIFY rank <= bm25_depth),
s AS (SELECT question_id, chunk_id, rank, CASE WHEN max(bm25) OVER w <= min(bm25) OVER w THEN 1.0 ELSE (max(bm25) OVER w - bm25) / (max(bm25) OVER w - min(bm25) OVER w) END AS score FROM s0 WINDOW w AS (PARTITION BY question_id))"""
_RRF = """r0 AS (SELECT question_id, chunk_id, d.rank AS dr, s.rank AS sr, coalesce(rrf_dense_weight / (60 + d.rank), 0) + coalesce(rrf_bm25_weight / (60 + s.rank), 0) AS raw
  FROM d FULL JOIN s USING (question_id, chunk_id) JOIN k USING (question_id)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(raw, 9) DESC, chunk_id::VARCHAR) AS rank FROM r0 QUALIFY rank <= 5),
rrf AS (SELECT question_id, chunk_id, rank::INT AS rank, round(CASE WHEN max(raw) OVER w <= min(raw) OVER w THEN 1.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END, 6) AS score FROM r1 WINDOW w AS (PARTITION BY question_id))"""
_SCALE = "CASE WHEN max(score) OVER w <= min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
_WEIGHTED = f"""dn AS (SELECT question_id, chunk_id, rank, {_SCALE} AS n FROM d WINDOW w AS (PARTITION BY question_id)), sn AS (SELECT question_id, chunk_id, rank, {_SCALE} AS n FROM s WINDOW w AS (PARTITION BY question_id)),
w0 AS (SELECT question_id, chunk_id, dn.rank AS dr, sn.rank AS sr, coalesce(dn.n * semantic_weight, 0) + coalesce(sn.n * lexical_weight, 0) AS raw FROM dn FULL JOIN sn USING (question_id, chunk_id) JOIN k USING (question_id)),
weighted AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY round(raw, 9) DESC, dr ASC NULLS LAST, sr ASC)::INT AS rank, round(raw, 6) AS score FROM w0 QUALIFY rank <= 5)"""


def _channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = classify.classify(questions(spark, sf_dir))
    d = dense.top_k(vectors(spark, sf_dir), asked, "dense_depth")
    return asked, d, sparse.to_lexical(sparse.bm25(fts_index(spark, sf_dir), asked, F.col("tokens"), "bm25_depth"))


@query(f"WITH {_CHANNELS}, {_RRF} SELECT question_id, chunk_id, rank, score FROM rrf")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, d, s = _channels(spark, sf_dir)
    return fusion.fuse_rrf(d, s, asked).select("question_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_CHANNELS}, {_WEIGHTED} SELECT question_id, chunk_id, rank, score FROM weighted")
def weighted_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, d, s = _channels(spark, sf_dir)
    return fusion.fuse_weighted(d, s, asked).select("question_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_CHANNELS}, u AS (SELECT question_id, count(d.chunk_id) FILTER (s.chunk_id IS NOT NULL) AS shared, count(*) AS every FROM d FULL JOIN s USING (question_id, chunk_id) GROUP BY 1)
SELECT question_id, round(shared / every, 6)::DOUBLE AS jaccard FROM u"""
)
def channel_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, d, s = _channels(spark, sf_dir)
    return fusion.jaccard(d, s).withColumn("jaccard", F.round("jaccard", 6))


_HYBRID = f"WITH {CHUNKS}, {_CHANNELS}, {_WEIGHTED} SELECT question_id, rank, w.chunk_id, score, 'weighted' AS fusion, file_path, content, chunk_type, chunk_name FROM weighted w JOIN chunks USING (chunk_id)"


@query(_HYBRID)
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieve.hybrid(chunks(spark, sf_dir), vectors(spark, sf_dir), questions(spark, sf_dir), index=fts_index(spark, sf_dir))
    return out.withColumn("score", F.round("score", 6))


FLAGSHIP = hybrid_retrieve


# --- chunks and context ------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT chunk_id, 'File: ' || file_path || chr(10) || chunk_type || ': ' || coalesce(chunk_name, 'anonymous') || chr(10) || chr(10) || content AS body FROM chunks")
def index_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = T.index_body(F.col("file_path"), F.lit(None).cast("string"), F.col("chunk_type"), F.col("chunk_name"), F.col("content"))
    return chunks(spark, sf_dir).select("chunk_id", body.alias("body"))


@query(
    r"""WITH RECURSIVE f AS (SELECT doc_id, source AS repo_id, source || '/' || lang || '/' || doc_id || '.txt' AS file_path, text, length(text) > 1500 AS long, CASE WHEN contains(text, chr(10)) THEN chr(10) ELSE ' ' END AS sep FROM documents),
p1 AS (SELECT doc_id, sep, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM (SELECT doc_id, sep, string_split(text, sep) AS parts FROM f WHERE long)),
p2 AS (SELECT doc_id, i, CASE WHEN i > 1 THEN sep ELSE '' END || part AS piece, sep = chr(10) AND length(piece) > 1500 AS big FROM p1),
p3 AS (SELECT *, 2 * sum(big::INT) OVER (PARTITION BY doc_id ORDER BY i) + CASE WHEN big THEN -1 ELSE 0 END AS part FROM p2),
p4 AS (SELECT doc_id, part, i, piece FROM p3 WHERE NOT big UNION ALL SELECT doc_id, part, generate_subscripts(ws, 1), CASE WHEN generate_subscripts(ws, 1) > 1 THEN ' ' ELSE '' END || unnest(ws) FROM (SELECT doc_id, part, string_split(piece, ' ') AS ws FROM p3 WHERE big)),
c0 AS (SELECT doc_id, part, piece, length(piece) AS n, row_number() OVER w AS j, sum(length(piece)) OVER w AS upto, count(*) OVER (PARTITION BY doc_id, part) AS last FROM p4 WINDOW w AS (PARTITION BY doc_id, part ORDER BY i ROWS UNBOUNDED PRECEDING)),
c1 AS (SELECT *, least(200, 1500 - coalesce(lead(n) OVER (PARTITION BY doc_id, part ORDER BY j), 0)) AS back FROM c0),
c AS MATERIALIZED (SELECT *, max(j) OVER (PARTITION BY doc_id, part ORDER BY upto RANGE BETWEEN CURRENT ROW AND (1500 - n) FOLLOWING) AS fit, 1 + min(j) OVER (PARTITION BY doc_id, part ORDER BY upto RANGE BETWEEN back PRECEDING AND CURRENT ROW) AS next FROM c1),
w AS (SELECT doc_id, part, j AS s, fit AS e FROM c WHERE j = 1 UNION ALL SELECT w.doc_id, w.part, y.j, y.fit FROM w JOIN c x ON x.doc_id = w.doc_id AND x.part = w.part AND x.j = w.e AND x.j < x.last JOIN c y ON y.doc_id = x.doc_id AND y.part = x.part AND y.j = x.next),
t AS (SELECT w.doc_id, w.part, w.s, regexp_replace(string_agg(c.piece, '' ORDER BY c.j), '^\s+|\s+$', '', 'g') AS content FROM w JOIN c ON c.doc_id = w.doc_id AND c.part = w.part AND c.j BETWEEN w.s AND w.e GROUP BY ALL),
parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, s) - 1 AS k, content FROM t WHERE content <> '' UNION ALL SELECT doc_id, 0, text FROM f WHERE NOT long)
SELECT repo_id, file_path, k::INT AS part, content, 'generic' AS chunk_type, 'generic_1' AS chunk_name, 1::INT AS start_line, len(string_split(text, chr(10)))::INT AS end_line FROM parts JOIN f USING (doc_id)"""
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents in parts of at most 1500 characters that overlap by up to 200."""
    files = chunks(spark, sf_dir).select("repo_id", F.col("file_path").alias("path"), "content")
    out = chunking.chunk_files(files).withColumn("whole", F.monotonically_increasing_id())  # a file's parts come in their order, from one task
    place = F.row_number().over(Window.partitionBy("repo_id", "file_path").orderBy("whole")) - 1
    return out.select("repo_id", "file_path", place.alias("part"), "content", "chunk_type", "chunk_name", "start_line", "end_line")


_RULES = "Answer from the given code only. Name the files that you rely on. Say so if the context doesn''t tell."


@query(
    f"""WITH {CHUNKS}, {_CHANNELS}, {_WEIGHTED}, ch AS (SELECT question_id, rank, 'Path: ' || file_path || chr(10) || chunk_type || ': ' || coalesce(chunk_name, 'anonymous') AS header, content FROM weighted w JOIN chunks USING (chunk_id)),
cr AS (SELECT *, 2000 - 7 * (count(*) OVER pq - 1) - sum(length(header) + 9) OVER pq AS room, coalesce(sum(length(content)) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ch WINDOW pq AS (PARTITION BY question_id)),
cs AS (SELECT question_id, rank, header || chr(10) || '```' || chr(10) || left(content, greatest(0, room - used)::BIGINT) || chr(10) || '```' AS section FROM cr),
cc AS (SELECT question_id, count(*)::INT AS n_results, string_agg(section, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM cs GROUP BY 1)
SELECT question_id, n_results, context, '[system]' || chr(10) || '{_RULES}' || chr(10) || chr(10) || '[context]' || chr(10) || context || chr(10) || chr(10) || '[question]' || chr(10) || question AS prompt FROM cc JOIN q USING (question_id)"""
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieve.hybrid(chunks(spark, sf_dir), vectors(spark, sf_dir), questions(spark, sf_dir), index=fts_index(spark, sf_dir))
    packed = context.pack_results(out, 500).join(questions(spark, sf_dir).select("question_id", "question"), "question_id")
    return packed.select("question_id", "n_results", "context", context.prompt(F.col("question"), F.col("context")).alias("prompt"))


#: Token budgets from one that has no room for a header to one that has room for all.
_BUDGETS = (2, 3, 5, 12, 20, 60, 120, 500, 2000)
_LADDER_ROWS = ", ".join(f"({k}, {str(i).lower()}, {1 << 30 if p is None else p}, {1 << 30 if n is None else n})" for k, (i, p, n) in enumerate(context.LADDER))


def _sql_header(p: str, n: str, imports: str) -> str:
    return f"""'Path: ' || CASE WHEN length(path) > {p} THEN '…' || right(path, {p} - 1) ELSE path END || chr(10) || kind || ': ' || CASE WHEN length(name) > {n} THEN left(name, {n} - 1) || '…' ELSE name END
  || CASE WHEN {imports} AND imports <> '' THEN chr(10) || 'Imports:' || chr(10) || imports ELSE '' END"""


@query(
    f"""WITH l(step, full_, p, n) AS (VALUES {_LADDER_ROWS}), t AS (SELECT unnest([{', '.join(map(str, _BUDGETS))}]) AS tokens),
it AS (SELECT doc_id // 5 AS g, doc_id % 5 + 1 AS pos, repeat(source || '/', (doc_id % 40)::INT) || lang || '.txt' AS path, CASE WHEN doc_id % 2 = 0 THEN 'function' ELSE 'class' END AS kind, repeat('name', (doc_id % 60)::INT) || 'x' AS name, text AS content,
  CASE WHEN doc_id % 3 = 0 THEN 'import ' || repeat('a, ', (doc_id % 400)::INT) || 'z' ELSE '' END AS imp FROM documents),
i AS (SELECT *, CASE WHEN length(imp) > 800 THEN regexp_replace(left(imp, 800), '\\s+$', '') || '…' ELSE imp END AS imports FROM it),
h AS (SELECT tokens, g, pos, step, {_sql_header('p', 'n', 'full_')} AS header FROM i, l, t),
c AS (SELECT *, sum(length(header) + 16) OVER (PARTITION BY tokens, g, step ORDER BY pos) - 7 AS size FROM h),
b AS (SELECT tokens, g, pos, step, size FROM c WHERE size <= greatest(1, 4 * tokens) QUALIFY row_number() OVER (PARTITION BY tokens, g ORDER BY pos DESC, step) = 1),
lone AS (SELECT tokens, g, {_sql_header('least(length(path) + 120, greatest(280, 4 * tokens - 9))', 'least(length(name) + 100, greatest(16, 4 * tokens - 9))', 'false')} AS wide, kind FROM i, t WHERE pos = 1),
cut AS (SELECT tokens, g, regexp_replace(left(CASE WHEN 4 * tokens - 9 >= 4 THEN wide ELSE kind || ':…' END, greatest(1, 4 * tokens - 9)), '\\s+$', '') AS header FROM lone),
s AS (SELECT tokens, g, i.pos, coalesce(h.header, cut.header) AS header, content, 4 * tokens - coalesce(b.size, length(cut.header) + 9) AS room,
  coalesce(sum(length(content)) OVER (PARTITION BY tokens, g ORDER BY i.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM i CROSS JOIN t LEFT JOIN b USING (tokens, g) LEFT JOIN h ON h.tokens = t.tokens AND h.g = i.g AND h.pos = i.pos AND h.step = b.step JOIN cut USING (tokens, g) WHERE i.pos <= coalesce(b.pos, 1))
SELECT tokens::INT AS tokens, g AS question_id, n::INT AS n_results, CASE WHEN min(room) >= 0 THEN string_agg(header || chr(10) || '```' || chr(10) || left(content, greatest(0, room - used)::BIGINT) || chr(10) || '```', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) ELSE '' END AS context
FROM s JOIN (SELECT g, count(*) AS n FROM i GROUP BY g) USING (g) GROUP BY tokens, g, n"""
)
def context_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every five documents as the results of a question, with long paths, names and imports, packed for many budgets."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    times = lambda text, n: F.repeat(text, (i % n).cast("int"))
    rows = d.select(
        F.floor(i / 5).alias("question_id"),
        (i % 5 + 1).alias("rank"),
        F.concat(times(F.concat("source", F.lit("/")), 40), "lang", F.lit(".txt")).alias("file_path"),
        F.when(i % 2 == 0, "function").otherwise("class").alias("chunk_type"),
        F.concat(times(F.lit("name"), 60), F.lit("x")).alias("chunk_name"),
        F.col("text").alias("content"),
        F.when(i % 3 == 0, F.concat(F.lit("import "), times(F.lit("a, "), 400), F.lit("z"))).alias("import_summary"),
    )
    return context.pack_budgets(rows, _BUDGETS)


@query(
    """SELECT conv_id, turn, greatest(0, least(length(coalesce(text, '')), 1000 - coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken
FROM conversations"""
)
def body_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    return context.body_budget(turns, 1000, ["conv_id"], ["turn"]).select("conv_id", "turn", "taken")


@query("SELECT page_id, CASE WHEN length(trim(html)) > 800 THEN rtrim(left(trim(html), 800)) || '…' ELSE trim(html) END AS capped, CASE WHEN length(url) <= 22 THEN url ELSE '…' || right(url, 21) END AS short_url, len(string_split(html, chr(10)))::INT AS lines FROM pages")
def text_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.cap_summary(F.col("html")).alias("capped"), T.shorten_path(F.col("url"), 22).alias("short_url"), T.line_count(F.col("html")).alias("lines"))


_REF = "SELECT question_id, list({'chunk_id': chunk_id, 'file_path': file_path, 'snippet': content, 'score': score} ORDER BY rank) AS refs FROM h GROUP BY question_id"


@query(f"WITH h AS ({_HYBRID}), r AS ({_REF}) SELECT question_id, len(refs)::INT AS n, refs[1].file_path AS first_path, md5(refs[1].snippet) AS first_md5 FROM r")
def reference_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = retrieve.references(hybrid_retrieve(spark, sf_dir))
    return r.select("question_id", F.size("references").alias("n"), F.col("references")[0]["file_path"].alias("first_path"), F.md5(F.col("references")[0]["snippet"].cast("binary")).alias("first_md5"))


@query(f"WITH {CHUNKS}, h AS ({_HYBRID.replace('WITH ' + CHUNKS + ', ', 'WITH ')}) SELECT question_id, rank, h.chunk_id, md5(c.content) AS source_md5 FROM h LEFT JOIN chunks c ON c.file_path = h.file_path".replace("(WITH ", "(WITH " + CHUNKS + ", ", 1))
def result_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = chunks(spark, sf_dir).select(F.concat(F.lit("./"), F.replace(F.col("file_path"), F.lit("/"), F.lit("\\"))).alias("path"), "content")
    out = retrieve.with_sources(hybrid_retrieve(spark, sf_dir), files)
    return out.select("question_id", "rank", "chunk_id", F.md5(F.col("source").cast("binary")).alias("source_md5"))


# --- store -------------------------------------------------------------------------------------------


def _changed(c: DataFrame) -> DataFrame:
    new = c.where("chunk_id % 10 = 0").withColumn("content", F.lit("changed"))
    more = c.where("chunk_id % 10 = 1").withColumns({"chunk_id": F.col("chunk_id") + 1_000_000_000, "content": F.lit("new")})
    return new.unionByName(more)


@query(
    f"""WITH {CHUNKS}, n AS (SELECT chunk_id, repo_id, 'changed' AS content FROM chunks WHERE chunk_id % 10 = 0 UNION ALL SELECT chunk_id + 1000000000, repo_id, 'new' FROM chunks WHERE chunk_id % 10 = 1)
SELECT chunk_id, repo_id, md5(content) AS md5 FROM (SELECT chunk_id, repo_id, content FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM n) UNION ALL SELECT * FROM n)"""
)
def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a stored table: partitions that the new rows name are read and written again."""
    s = store.Store(spark, shared_folder(spark, "store"))
    rows = lambda df: df.withColumns({"id": F.col("chunk_id").cast("string"), "created_at": F.current_timestamp()})
    c = chunks(spark, sf_dir)
    s.upsert("chunks", rows(c))
    s.upsert("chunks", rows(_changed(c)))
    return s.read("chunks").select(F.col("id").cast("long").alias("chunk_id"), "repo_id", F.md5(F.col("content").cast("binary")).alias("md5"))


@query("SELECT vec_id AS chunk_id, label::VARCHAR AS repo_id, CASE WHEN vec_id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE AS first FROM embeddings")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    new = v.where("chunk_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return store.add_vectors(v, new).select("chunk_id", "repo_id", F.col("embedding")[0].cast("double").alias("first"))


@query("SELECT 'repo' AS how, count(*) AS n FROM embeddings WHERE label <> 3 UNION ALL SELECT 'ids', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'both', count(*) FROM embeddings WHERE NOT (label = 3 AND vec_id IN (SELECT doc_id FROM labels)) UNION ALL SELECT 'all', 0")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By repository, by ids and by both through stored tables, each of which tells how many went."""
    ids = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"))
    v = vectors(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("id"), F.col("chunk_id").cast("string").alias("chunk_id"), "repo_id", "embedding", F.lit("m").alias("model"), F.current_timestamp().alias("created_at"))
    kept = {"all": store.delete(v)}
    for how in ("repo", "ids", "both"):
        s = store.Store(spark, shared_folder(spark, "store"))
        before = s.append("embeddings", v)
        gone = s.drop("embeddings", "3") if how == "repo" else s.delete("embeddings", ids, "3" if how == "both" else None)
        kept[how] = s.read("embeddings")
        assert before - gone == kept[how].count()
    counts = [df.agg(F.lit(how).alias("how"), F.count("*").alias("n")) for how, df in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(f"WITH {CHUNKS} SELECT 'repos' AS name, count(DISTINCT repo_id) AS n FROM chunks WHERE repo_id NOT IN ('src1', 'src2') UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE repo_id NOT IN ('src1', 'src2') UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE 'src' || label NOT IN ('src1', 'src2')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two repositories' partitions of stored tables go."""
    c = chunks(spark, sf_dir)
    s = store.Store(spark, shared_folder(spark, "store"))
    now = F.current_timestamp()
    s.append("repos", repos(spark, sf_dir).withColumns({"updated_at": now, "embedding_model_id": F.lit("m"), "embedding_dimension": F.lit(64)}))
    s.append("chunks", c.withColumns({"id": F.col("chunk_id").cast("string"), "created_at": now}))
    v = vectors(spark, sf_dir).withColumns({"id": F.col("chunk_id").cast("string"), "chunk_id": F.col("chunk_id").cast("string"), "repo_id": F.concat(F.lit("src"), "repo_id"), "model": F.lit("m"), "created_at": now})
    s.append("embeddings", v)
    for repo in ("src1", "src2"):
        for name in ("embeddings", "chunks", "repos"):
            s.drop(name, repo)
    left = {name: s.read(name) for name in ("repos", "chunks", "embeddings")}
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select(F.col("repo_id").alias("id")).distinct()
    n = F.substring("id", 4, 9).cast("int")
    return c.select("id", F.concat(F.lit("/data/"), "id").alias("path"), F.when(n % 2 == 0, "local").otherwise("git").alias("type"), F.when(n % 5 == 0, "indexing").otherwise("indexed").alias("status"), F.timestamp_seconds(F.lit(1_700_000_000) + (n % 7)).alias("created_at"), F.lit(0).cast("long").alias("chunk_count"), F.lit(0).cast("long").alias("file_count"))


REPOS = """repos AS (SELECT DISTINCT source AS id, '/data/' || source AS path, CASE WHEN substring(source, 4)::INT % 2 = 0 THEN 'local' ELSE 'git' END AS type,
  CASE WHEN substring(source, 4)::INT % 5 = 0 THEN 'indexing' ELSE 'indexed' END AS status, 1700000000 + substring(source, 4)::INT % 7 AS created FROM documents)"""


@query(f"WITH {REPOS} SELECT id, status, created::BIGINT AS created, row_number() OVER (ORDER BY created DESC, id DESC)::INT AS place FROM repos")
def repo_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = tables.list_repos(repos(spark, sf_dir))
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id")))  # a row per repository
    return listed.select("id", "status", F.unix_seconds("created_at").alias("created"), place.alias("place"))


@query(f"WITH {REPOS}, {CHUNKS}, n AS (SELECT repo_id, count(*) AS c, count(DISTINCT file_path) AS f FROM chunks GROUP BY 1) SELECT id, CASE WHEN id = 'src3' THEN 'failed' ELSE status END AS status, c AS chunk_count, f AS file_count FROM repos JOIN n ON repo_id = id")
def repo_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = store.set_counts(repos(spark, sf_dir), chunks(spark, sf_dir))
    return store.update(counted, F.col("id") == "src3", status=F.lit("failed")).select("id", "status", "chunk_count", "file_count")


@query(f"WITH {REPOS} SELECT id, path, type FROM repos WHERE type = 'local'")
def duplicate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories offered again: those with an even number as they are, the others as local ones."""
    r = repos(spark, sf_dir)
    return store.duplicates(r, r.withColumn("type", F.lit("local"))).select("id", "path", "type")


@query(f"WITH {REPOS} SELECT id, status AS shown, CASE WHEN id IN ('src5', 'src10') THEN 'indexed' ELSE status END AS now, status = 'indexing' AND id IN ('src5', 'src10') AS changed FROM repos")
def status_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list shown joined with what a poll of those still indexing brought."""
    r = repos(spark, sf_dir)
    polled = r.where("status = 'indexing'").select("id", F.when(F.col("id").isin("src5", "src10"), "indexed").otherwise("indexing").alias("status"))
    return tables.polled(r, polled)


@query(f"WITH {REPOS} SELECT CASE WHEN status = 'indexed' THEN 'ready' ELSE 'waiting' END AS side, type, count(*) AS n FROM repos GROUP BY 1, 2")
def repo_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, waiting = tables.by_readiness(repos(spark, sf_dir))
    sides = ready.withColumn("side", F.lit("ready")).unionByName(waiting.withColumn("side", F.lit("waiting")))
    return sides.groupBy("side", "type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN starts_with(trim(source), 'https://') OR starts_with(trim(source), 'git@') THEN 'git' ELSE 'local' END AS kind, len(string_split(text, chr(10)))::INT AS lines, length(text) AS chars FROM documents")
def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", T.source_kind(F.col("source")).alias("kind"), T.line_count(F.col("text")).alias("lines"), F.length("text").cast("long").alias("chars"))


@query(f"WITH {CHUNKS} SELECT chunk_id, file_path, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line, row_number() OVER (ORDER BY file_path, coalesce(start_line, 0), chunk_id)::INT AS place FROM chunks WHERE repo_id = 'src7'")
def repo_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.chunks_of(chunks(spark, sf_dir).withColumnRenamed("chunk_id", "id"), "src7")
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("file_path", "start_line", "id"))
    return rows.select(F.col("id").alias("chunk_id"), "file_path", "start_line", "end_line", place.alias("place"))


@query("SELECT doc_id AS chunk_id, source AS repo_id, text AS content FROM documents WHERE doc_id = 17")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lookup(chunks(spark, sf_dir), chunk_id=17).select("chunk_id", "repo_id", "content")


# --- history -----------------------------------------------------------------------------------------


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("repo_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("references_json"), F.timestamp_seconds(F.col("turn")).alias("created_at"))


@query("SELECT conv_id::VARCHAR AS repo_id, turn AS seq, role, md5(text) AS md5 FROM conversations WHERE conv_id = 3")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.history_of(history(spark, sf_dir), "3").select("repo_id", "seq", "role", F.md5(F.col("content").cast("binary")).alias("md5"))


@query(
    """WITH l AS (SELECT conv_id, max(turn) + 1 AS next FROM conversations GROUP BY 1) SELECT conv_id::VARCHAR AS repo_id, turn AS seq, role, NULL::VARCHAR AS refs FROM conversations
UNION ALL SELECT conv_id::VARCHAR, next, 'assistant', '[]' FROM l UNION ALL SELECT conv_id::VARCHAR, next + 1, 'error', NULL FROM l"""
)
def chat_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer with references and an error, appended to every conversation."""
    h = history(spark, sf_dir)
    one = h.select("repo_id").distinct()
    new = lambda n, role: one.select(F.concat(F.lit(role), "repo_id").alias("id"), "repo_id", F.lit(n).cast("long").alias("seq"), F.lit(role).alias("role"), F.lit("x").alias("content"), F.lit("[]").alias("references_json"), F.timestamp_seconds(F.lit(0)).alias("created_at"))
    return store.append_message(h, new(0, "assistant").unionByName(new(1, "error"))).select("repo_id", "seq", "role", F.col("references_json").alias("refs"))


@query("SELECT conv_id::VARCHAR AS repo_id, turn AS seq FROM conversations WHERE conv_id <> 3")
def chat_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete(history(spark, sf_dir), "3").select("repo_id", "seq")


@query(
    """SELECT vec_id, CASE WHEN vec_id % 5 IN (0, 1, 4) THEN 1 END::INT AS n, CASE WHEN vec_id % 5 = 1 THEN 'rrf' END AS mode, CASE WHEN vec_id % 5 IN (0, 1, 4) THEN 'p' || vec_id END AS path FROM embeddings"""
)
def chat_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored references in all shapes: array, object with and without a known mode, no array, no JSON."""
    one = F.format_string('[{"chunk_id":"c","file_path":"p%s","snippet":"s","score":0.5}]', F.col("vec_id").cast("string"))
    shape = F.col("vec_id") % 5
    json = F.when(shape == 0, one).when(shape == 1, F.concat(F.lit('{"references":'), one, F.lit(',"retrieval_fusion":"rrf"}'))).when(shape == 2, '{"references":1}').when(shape == 3, "{oops").otherwise(F.concat(F.lit('{"references":'), one, F.lit(',"retrieval_fusion":"odd"}')))
    parsed = read(spark, sf_dir, "embeddings").select("vec_id", store.parse_references(json).alias("r"))
    return parsed.select("vec_id", F.when(F.col("r.references").isNotNull(), F.size("r.references")).alias("n"), F.col("r.retrieval_fusion").alias("mode"), F.col("r.references")[0]["file_path"].alias("path"))


# --- evaluation and logs -----------------------------------------------------------------------------

_EVAL = """e AS (SELECT b.item_id AS question_id, contains(lower(d.text), lower(split_part(b.text, ' ', 3))) AS keyword_hit, contains(d.source || '/' || d.lang || '/' || d.doc_id || '.txt', 'src' || b.item_id % 20 || '/') AS file_hit
  FROM benchmark b JOIN documents d ON d.doc_id = b.item_id + 20)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document 20 after an item's number as its answer; its third word and a directory are expected."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.array(F.split("text", " ")[2]).alias("expected_keywords"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"), F.lit("/"))).alias("expected_files"))
    d = chunks(spark, sf_dir).select((F.col("chunk_id") - 20).alias("question_id"), F.col("content").alias("answer"), F.array("file_path").alias("paths"))
    return evaluate.hits(b.join(d, "question_id"))


@query(f"WITH {_EVAL} SELECT question_id, keyword_hit, file_hit, keyword_hit OR file_hit AS matched FROM e")
def eval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)


@query(f"WITH {_EVAL} SELECT count(*) AS total, sum((keyword_hit OR file_hit)::INT)::BIGINT AS matched, round(avg((keyword_hit OR file_hit)::INT::DOUBLE) * 100, 2) AS rate FROM e")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(_evaluated(spark, sf_dir))


@query("SELECT event_type, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(max(value), 4) AS worst FROM events GROUP BY 1, 2")
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = indexing.event_stages(read(spark, sf_dir, "events").where("ts is not null"))
    return out.select("event_type", F.unix_seconds("start").alias("start"), "n", *(F.round(c, 4).alias(c) for c in ("total", "mean", "worst")))


# --- paths -------------------------------------------------------------------------------------------

_EXT = "lower(regexp_extract(url, '([.][^./]+)\\z', 1))"


@query(
    f"""SELECT page_id, regexp_replace(trim(url || '//'), '/+\\z', '') AS normalized, CASE WHEN starts_with(trim(url), 'https://') OR starts_with(trim(url), 'git@') THEN 'git' ELSE 'local' END AS kind,
  regexp_replace(replace('./' || url, '/', '/'), '^\\./', '') AS path, {_EXT} AS extension FROM pages"""
)
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, u = read(spark, sf_dir, "pages"), F.col("url")
    twice = F.concat(F.lit(".\\"), F.replace(u, F.lit("/"), F.lit("\\")))
    return p.select("page_id", T.normalize_source(F.lit("local"), F.concat(u, F.lit("//"))).alias("normalized"), T.source_kind(u).alias("kind"), T.normalize_path(twice).alias("path"), T.extension(u).alias("extension"))


_NAMES = ("a.ts", "lib/b.min.js", "node_modules/c.js", "d.PY", "e.lock", "dist.js", "x/dist/f.ts", "g.map", "h.png", "i")


@query(
    f"""WITH n AS (SELECT page_id, ({list(_NAMES)})[page_id % 10 + 1] AS path FROM pages)
SELECT page_id, path, NOT regexp_matches(path, '(^|/)({"|".join(d.replace(".", "[.]") for d in T.IGNORED_DIRECTORIES)})/') AND lower(regexp_extract(path, '([.][^./]+)\\z', 1)) IN {T.EXTENSIONS} AND NOT regexp_matches(path, '[.]min[.](js|css)\\z') AS wanted,
  CASE WHEN lower(path) LIKE '%.py' THEN 'python' WHEN regexp_matches(path, '[.](ts|js)\\z') THEN 'js' END AS language FROM n"""
)
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % 10 + 1).cast("int"))
    p = read(spark, sf_dir, "pages").select("page_id", name.alias("path"))
    return p.select("page_id", "path", T.wanted_file(F.col("path")).alias("wanted"), T.source_language(F.col("path")).alias("language"))
