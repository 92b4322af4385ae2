"""The store, file sources, streaming and the service surface."""

import subprocess
import tempfile
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry import schemas
from quarry.api import Engine
from quarry.functions import text as T
from quarry.operators import chunking, evaluate, sparse, store
from quarry.sources import files, trees
from quarry.streaming import indexing


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for name, text in {"src/auth/login.ts": "import x from 'x';\nexport class Login {\n  run() { return 'login user'; }\n}\n", "lib/math.py": "def add(a, b):\n    return a + b\n", "node_modules/a.ts": "no", "app.min.js": "no", "README.md": "no"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def test_source_files(spark, tree):
    got = files.source_files(spark, tree, "r").collect()
    assert sorted(r.path for r in got) == ["lib/math.py", "src/auth/login.ts"]
    assert files.tree_size(spark, tree).first().files == 5
    with pytest.raises(files.TooLarge):
        files.source_files(spark, tree, "r", 0)


def test_question_set(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text('{"questions": [{"id": "1", "category": "c", "question": "q", "expectedFiles": ["f"], "expectedKeywords": ["k"]}]}')
    assert files.question_set(spark, str(p)).first().expected_files == ["f"]


def test_engine(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), answerer=lambda prompt: "answer")
    assert e.health()["code"] == 0
    made = e.import_repo(tree + "//")
    assert (made["code"], made["data"]["file_count"]) == (0, 2)
    repo = made["data"]["repo_id"]
    assert e.import_repo(tree)["code"] == 1002
    assert e.import_repo("/no/such/dir")["code"] == 1001
    q = spark.createDataFrame([(1, repo, "where is login user handled")], "question_id int, repo_id string, question string")
    assert e.ask(q)["code"] == 2001
    assert e.forget_files(repo) == 2
    assert e.ensure_files(repo)
    assert not e.ensure_files("none")
    assert e.build_index(repo)["data"]["status"] == "indexed"
    assert [df.count() for df in e.indexed()] == [1, 0]
    assert e.build_index(repo)["code"] == 2002
    got = e.ask(q, 2)
    row = got["data"].first()
    assert got["code"] == 0
    assert row.answer == "answer"
    assert row.references[0].file_path == "src/auth/login.ts"
    assert "Imports:\nimport x" in row.context
    assert e.ask(q.withColumn("repo_id", F.lit("none")))["code"] == 1003
    assert e.ask(q, 2, spark.createDataFrame([], "id string"))["code"] == 3001
    assert e.save_message(repo, "user", "hi")["code"] == 0
    e.save_message(repo, "error", "no", "[]")
    assert [(r.seq, r.role, r.references_json) for r in e.history(repo)["data"].collect()] == [(0, "user", None), (1, "error", None)]
    assert e.reload(repo)["code"] == 0
    assert Engine(spark, str(tmp_path / "store"), e.cfg.__class__(embedding_model="other")).ask(q)["code"] == 4003
    assert e.clear_history(repo)["code"] == 0
    assert e.history(repo)["data"].count() == 0
    gone = e.delete_repo(repo)
    assert gone["code"] == 0
    assert gone["data"]["deleted"]["files"] == 2
    assert gone["data"]["deleted"]["repos"] == 1
    assert e.store.read("segments").count() == 0
    log = {r.event_type: r.counts for r in e.stage_log().collect() if r.counts}
    assert {"import", "chunk", "embed", "store", "retrieve"} <= set(log)
    assert log["import"] == {"files": 2}
    assert log["retrieve"]["kept"] + log["retrieve"]["dropped"] == log["retrieve"]["fused"]
    assert e.repos()["data"].count() == 0
    assert e.status(repo)["code"] == 1003


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", "x")], "id string, repo_id string, v string")
    new = spark.createDataFrame([("2", "b", "y"), ("3", "b", "z")], old.schema)
    assert sorted(map(tuple, store.upsert(old, new).collect())) == [("1", "a", "x"), ("2", "b", "y"), ("3", "b", "z")]
    assert store.delete(old).count() == 0
    assert [r.id for r in store.delete(old, "a").collect()] == ["2"]
    with pytest.raises(Exception, match="required"):
        store.add_vectors(old.withColumn("chunk_id", F.col("id")), new.withColumn("chunk_id", F.lit(None).cast("string"))).collect()


def test_constraints(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([("1", "p", "odd")], "id string, path string, type string").selectExpr("*", "'idle' status", "0L file_count", "0L chunk_count", "current_timestamp() created_at", "current_timestamp() updated_at", "cast(null as string) embedding_model_id", "cast(null as int) embedding_dimension")
    assert schemas.violations("repos", row).count() == 1
    with pytest.raises(Exception, match="constraints"):
        s.replace("repos", "1", row)
    assert s.read("repos").count() == 0
    fine = row.withColumn("type", F.lit("local"))
    with pytest.raises(Exception, match="constraints"):
        s.replace("repos", "1", fine.unionByName(fine))


def _times(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_partitions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    files_of = lambda repo, *names: spark.createDataFrame([(repo, n, "x") for n in names], "repo_id string, path string, content string")
    assert s.replace("files", "a b/%", files_of("a b/%", "1", "2")) == 2
    assert s.replace("files", "b", files_of("b", "1")) == 1
    assert s.append("files", files_of("a b/%", "3")) == 1
    assert sorted(r.path for r in s.read("files", "a b/%").collect()) == ["1", "2", "3"]
    other = _times(tmp_path / "s" / "files" / "repo_id=b")
    s.compact("files", "a b/%")
    assert len(s.read("files", "a b/%").inputFiles()) == 1
    assert s.replace("files", "a b/%", files_of("a b/%", "4")) == 1
    assert s.replace("files", "a b/%", files_of("a b/%").where("false")) == 0
    assert s.read("files", "a b/%").count() == 0
    assert _times(tmp_path / "s" / "files" / "repo_id=b") == other  # other partitions stay as they are
    assert s.drop("files", "b") == 1
    assert s.drop("files", "none") == 0


def _chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, repo_id string, content string").selectExpr("id", "repo_id", "'p' file_path", "content", "'generic' chunk_type", "'n' chunk_name", "1 start_line", "1 end_line", "current_timestamp() created_at")


def test_upserts_and_deletes_by_id(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.upsert("chunks", _chunk_rows(spark, [(f"{r}{k}", r, "old") for r in "abc" for k in range(3)])) == 9
    held = {r: _times(tmp_path / "s" / "chunks" / f"repo_id={r}") for r in "abc"}
    assert s.upsert("chunks", _chunk_rows(spark, [("a1", "a", "new"), ("a9", "a", "new")])) == 2
    assert sorted((r.id, r.content) for r in s.read("chunks", "a").collect()) == [("a0", "old"), ("a1", "new"), ("a2", "old"), ("a9", "new")]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert s.delete("chunks", ids("a0", "b0", "none")) == 2
    assert s.delete("chunks", ids("a1", "b1"), "b") == 1
    assert s.delete("chunks", ids("b2", "none")) == 1  # the last of its partition
    assert sorted(r.id for r in s.read("chunks").collect()) == ["a1", "a2", "a9", "c0", "c1", "c2"]
    assert not (tmp_path / "s" / "chunks" / "repo_id=b").exists()
    assert _times(tmp_path / "s" / "chunks" / "repo_id=c") == held["c"]
    few = s.of("chunks", spark.createDataFrame([("c",)], "r string"))
    assert few.count() == 3
    assert "dynamicpruning" in few._jdf.queryExecution().toString()


def test_versions(spark, tmp_path):
    store.Store(spark, str(tmp_path / "s"))
    store.Store(spark, str(tmp_path / "s"))
    (tmp_path / "t" / "version=1").mkdir(parents=True)
    with pytest.raises(ValueError, match="version=1"):
        store.Store(spark, str(tmp_path / "t"))


def test_listing(tmp_path, monkeypatch):
    """Ignored directories are never listed; names pass the same rules as in columns."""
    for name in ("a.ts", "src/x/b.py", "node_modules/c.ts", "src/.git/d.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    seen, plain = [], trees.entries
    monkeypatch.setattr(trees, "entries", lambda system, place: seen.append(place) or plain(system, place))
    reader = trees.Reader({"path": str(tmp_path)})
    assert [(p.kind, [x.removeprefix(str(tmp_path)) for x in p.places]) for p in reader.partitions()] == [("files", ["/a.ts"]), ("walk", ["/src"])]
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["a.ts", "src/x/b.py"]
    assert {x.removeprefix(str(tmp_path)) for x in seen} == {"", "/src", "/src/x"}


def test_name_rules(spark):
    names = ["a.ts", "a.TSX", "a.min.js", "a.lock", "ts", ".py", "a.b.rs", "x.svg", "a.map", "a.", "b.hpp", "noext"]
    rows = spark.createDataFrame([(n,) for n in names], "path string").select("path", T.wanted_file(F.col("path"))).collect()
    assert {r[0]: r[1] for r in rows} == {n: trees.wanted(n) for n in names}


def test_clone(spark, tree, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q", tree)
    git("-C", tree, "add", "-f", ".")
    git("-C", tree, "commit", "-qm", "one")
    before = set(Path(tempfile.gettempdir()).glob("clone-*"))
    got = files.source_files(spark, f"file://{tree}", "r", 1, git=True).collect()
    assert sorted(r.path for r in got) == ["lib/math.py", "src/auth/login.ts"]
    with pytest.raises(Exception, match="1001"):
        files.tree(spark, f"file://{tree}", git=True, limit_bytes=10).count()
    assert set(Path(tempfile.gettempdir()).glob("clone-*")) == before


def test_background_build(spark, tree, tmp_path):
    gate = tmp_path / "gate"

    def slow(rows, cfg):
        def wait(parts):
            while not gate.exists():
                time.sleep(0.1)
            yield from parts

        return chunking.chunk_files(rows.mapInPandas(wait, rows.schema), cfg)

    e = Engine(spark, str(tmp_path / "store"), chunker=slow)
    repo = e.import_repo(tree)["data"]["repo_id"]
    assert e.build_index(repo, background=True)["data"] == {"status": "indexing"}
    until = time.time() + 60
    while time.time() < until and not e.status(repo)["data"]["progress"]["tasks"]:
        time.sleep(0.1)
    now = e.status(repo)["data"]
    assert now["status"] == "indexing"
    assert now["progress"]["stage"] == "chunk"
    assert now["progress"]["tasks"] > now["progress"]["done"]
    assert e.build_index(repo)["code"] == 1004
    assert e.cancel(repo)
    assert e.status(repo)["data"]["status"] == "failed"
    assert e.build_index(repo, background=True)["code"] == 0
    thread = e.builds[repo].thread
    gate.write_text("")
    thread.join(120)
    assert e.status(repo)["data"] | {"id": 0} == {"id": 0, "status": "indexed", "file_count": 2, "chunk_count": 3, "progress": None}
    assert not e.cancel(repo)
    one = e.store.read("chunks", repo).limit(1).select("id").collect()
    assert e.delete_chunks(repo, spark.createDataFrame(one, "id string"))["data"] == {"deleted": 1}
    assert [e.store.read(t, repo).count() for t in ("chunks", "embeddings")] == [2, 2]
    assert e.fts_index().stats().first().n_chunks == 2


def test_evaluation(spark):
    rows = [(1, "uses JWT", ["jwt"], ["a.ts"], ["b.ts"]), (2, "x", ["jwt"], ["a.ts"], ["src/a.ts"]), (3, "x", ["jwt"], ["a.ts"], None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "question_id int, answer string, expected_keywords array<string>, expected_files array<string>, paths array<string>")
    got = evaluate.hits(df)
    assert [r.matched for r in got.orderBy("question_id").collect()] == [True, True, False, False]
    assert evaluate.summary(got).first().rate == 50.0
    assert "Matched 2 of 4 (50.00%)" in evaluate.report(got)


def test_streams(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    py = lambda *names: "".join(f"def {n}():\n    return 1\n" for n in names)
    batches = [
        [("r", "a.py", 1, py("old", "kept")), ("r", "b.py", 1, py("b")), ("s", "c.py", 1, py("c"))],
        [("r", "a.py", 3, py("new")), ("r", "a.py", 2, py("never")), ("r", "b.py", 2, py("b"))],  # changed twice; again the same
        [("r", "a.py", 1, py("late")), ("s", "c.py", 2, None)],  # late; gone
    ]
    want = [({"old", "kept", "b", "c"}, 4), ({"new", "b", "c"}, 3), ({"new", "b"}, 2)]
    times = []
    for rows, (names, n) in zip(batches, want, strict=True):
        spark.createDataFrame(rows, indexing.FILES).coalesce(1).write.mode("append").parquet(src)
        indexing.index_files(spark, src, out, ck).awaitTermination()
        s = store.Store(spark, out)
        assert {r.chunk_name for r in s.read("chunks").collect()} == names
        assert sparse.Index(s.read("segments")).stats().first().n_chunks == n
        assert s.read("segments").where("term = 'return'").agg(F.sum("df")).first()[0] == n
        times.append(_times(tmp_path / "out" / "chunks" / "repo_id=s"))
    assert times[0] == times[1]  # an untouched repository
    assert times[2] == {}


def test_event_stream(spark, tmp_path):
    from testdata import SF

    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = indexing.event_stages(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF))
    q = stream.writeStream.format("memory").queryName("stages").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = indexing.event_stages(spark.read.parquet(f"{SF}/events.parquet").where("ts is not null"))
    assert spark.table("stages").count() == batch.count()


def test_model_edge(spark, tmp_path):
    from quarry.api import embed_and_persist, hashing_embedder, model_text

    assert [model_text(x) for x in ("a", ["a", {"type": "text", "text": "b"}, {"type": "image"}], None, 3)] == ["a", "ab", "", ""]
    rows = spark.createDataFrame([("c1", "r", "x y"), ("c2", "s", "z")], "chunk_id string, repo_id string, body string")
    embed_and_persist(rows, "body", hashing_embedder(8), str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).count() == 2
