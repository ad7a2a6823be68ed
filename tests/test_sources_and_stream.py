import hashlib
import hmac
import json
import subprocess

import pytest

from lodestone.operators import chunks, retrieval
from lodestone.plans.engine import Engine, Settings
from lodestone.sources import tables, tree
from lodestone.streaming import webhook

FILES = {"app/__init__.py": b"", ".env": b"A=1\n", "app/main.py": b"a\nb\nc", "web/x.js": b"let a;\n", "node_modules/y.js": b"no", "img.png": b"\x89"}


@pytest.fixture
def repo(tmp_path):
    for name, content in FILES.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(content)
    return tmp_path / "r"


def test_local(spark, repo):
    row = Engine(spark).ingest(str(repo)).first()
    assert [f["path"] for f in row["files"]] == [".env", "app/__init__.py", "app/main.py", "web/x.js"]
    assert (row["total_files"], row["total_source_files"], row["total_lines"]) == (4, 3, 5)
    assert row["language_breakdown"] == {"python": 2, "javascript": 1, "unknown": 1}
    assert {f["path"]: f["sha256"] for f in row["files"]}["app/main.py"] == hashlib.sha256(b"a\nb\nc").hexdigest()
    with pytest.raises(FileNotFoundError):
        Engine(spark).ingest(str(repo / "missing"))


def test_zip(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(tree.zip_bytes({"top/" + n: c for n, c in FILES.items()}))
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    assert sorted(r["path"] for r in tree.from_zip(spark, str(tmp_path / "a.zip")).collect()) == [".env", "app/__init__.py", "app/main.py", "web/x.js"]
    with pytest.raises(ValueError, match="Not a valid ZIP"):
        tree.from_zip(spark, str(tmp_path / "bad.zip"))


def test_git(spark, repo):
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("add", "-f", "app")
    run("commit", "-q", "-m", "x")
    assert Engine(spark).ingest(f"file://{repo}").first()["total_files"] == 2
    with pytest.raises(RuntimeError):
        with tree.GitClone(f"file://{repo}-missing"):
            pass
    with tree.GitClone(f"file://{repo}", "main", f"{repo}-shared/new") as folder:
        assert folder.startswith(f"{repo}-shared/new/") and tree.from_local(spark, folder).count() == 2
    assert tree.mounted(None, True) is None and tree.mounted("s3a://b/c", True) is None
    assert tree.mounted("file:///mnt/shared/", False) == tree.mounted("/mnt/shared", False) == "/mnt/shared"
    for where in (None, "s3a://b/c"):
        with pytest.raises(RuntimeError):
            tree.mounted(where, False)


def test_chunks(spark):
    code = "\n".join(f"l{i}" for i in range(120))
    got = chunks.chunk_lines(spark.createDataFrame([("f", code), ("g", " \n ")], "f string, c string"), "f", "c").orderBy("chunk_index").collect()
    assert [r["content"].split("\n")[0] for r in got] == ["l0", "l50", "l100"] and [r["chunk_index"] for r in got] == [0, 1, 2]
    assert chunks.tile_starts("import a\n\n\n@d\ndef f():\n    pass\n\nclass B:\n    pass\n") == [0, 4, 6, 7, 9]
    assert len(chunks.mock_vector("x", 384)) == 384 and chunks.mock_vector("x", 5) == chunks.mock_vector("x", 5)


def test_upsert_replaces_files(spark):
    schema = "id string, filepath string, v int"
    old = spark.createDataFrame([("a0", "a", 1), ("a1", "a", 1), ("b0", "b", 1)], schema)
    new = spark.createDataFrame([("a0", "a", 2)], schema)
    assert sorted((r["id"], r["v"]) for r in chunks.upsert(old, new).collect()) == [("a0", 2), ("a1", 1), ("b0", 1)]
    assert sorted((r["id"], r["v"]) for r in chunks.upsert(old, new, True).collect()) == [("a0", 2), ("b0", 1)]


def test_hybrid(spark):
    rows = [("1", "a.py", "alpha beta", [1.0, 0.0]), ("2", "b.py", "gamma", [0.0, 1.0]), ("3", "c.py", "delta", [-1.0, 0.0])]
    c = spark.createDataFrame(rows, "id string, filepath string, content string, embedding array<float>")
    q = spark.createDataFrame([(1, "alpha", [1.0, 0.1]), (2, "  ", [1.0, 0.0])], "query_id int, query_text string, query_vec array<float>")
    e = spark.createDataFrame([("a", "c")], "src string, dst string")
    got = retrieval.hybrid(c, q, e, 1).orderBy("rank").collect()
    assert [(r["query_id"], r["id"], r["score"], r["retrieval_method"]) for r in got] == [(1, "1", 1.0, "hybrid_vector+bm25"), (1, "3", 0.8, "graph_expansion")]
    whole, cut = retrieval.vector_topk(c, q, 2), retrieval.vector_topk(c, q, 2, tile_bytes=8, group_bytes=8)
    assert sorted(whole.collect()) == sorted(cut.collect()) and whole.count() == 4


def test_stream(spark, tmp_path):
    secret = "s"
    body = lambda action: json.dumps({"action": action, "number": 3, "pull_request": {"diff_url": "u"}, "repository": {"full_name": "o/r"}})
    sign = lambda b: "sha256=" + hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest()
    events = [("pull_request", sign(body("opened")), body("opened")), ("pull_request", sign(body("closed")), body("closed")), ("pull_request", "sha256=0", body("opened")), ("push", sign("{}"), "{}")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text("\n".join(json.dumps(dict(zip(("event_type", "signature", "body"), e))) for e in events))
    diffs = spark.createDataFrame([("u", "+x = eval(y)")], "diff_url string, diff string")
    run = Engine(spark, Settings(webhook_secret=secret)).review_stream(str(tmp_path / "in"), diffs, str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination(120)
    done = spark.read.parquet(f"{tmp_path}/out/reviews").collect()
    assert [(r["repository"], r["number"], r["overall_status"]) for r in done] == [("o/r", 3, "BLOCKED")]
    assert spark.read.parquet(f"{tmp_path}/out/ignored").count() == 3
    assert not webhook.signed("x", None, secret) and not webhook.signed("x", "md5=1", secret)


def test_store(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "edges"), tables.EDGES)
    assert store.read().count() == 0
    edges = spark.createDataFrame([("a", "b", "IMPORTS"), ("a", "b", "IMPORTS"), ("b", "c", "IMPORTS")], tables.EDGES)
    store.upsert_edges(edges)
    store.upsert_edges(edges.limit(1))
    assert store.read().count() == 2
    store.clear()
    assert store.read().count() == 0
