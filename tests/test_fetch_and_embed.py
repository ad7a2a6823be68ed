import os

from pyspark.sql import functions as F

from lodestone.operators import chunks
from lodestone.plans.engine import Engine, Settings
from lodestone.streaming import diffs


def sessions(folder):
    """Sessions that note each opening, request and closing as a file."""

    class Session:
        def __init__(self):
            self.note("open")

        def note(self, what):
            open(f"{folder}/{what}-{os.getpid()}-{id(self)}-{len(os.listdir(folder))}", "w").close()

        def get(self, url, headers, timeout):
            assert headers["Authorization"] == "token t" and timeout == 2.0
            self.note("get")
            if url.endswith("slow"):
                raise TimeoutError("too\nslow")
            return (200, f"+x = eval({url!r})") if url.endswith("ok") else (404, "")

        def close(self):
            self.note("close")

    return Session


def test_fetch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a/ok"), (2, "b/slow"), (3, "c/gone"), (4, "a/ok"), (5, None), (6, "")], "pr_id int, diff_url string").repartition(3)
    fetcher = diffs.Fetcher("t", sessions(str(tmp_path)), 2.0)
    got = {r["pr_id"]: (r["diff"], r["fetch_error"]) for r in fetcher.add(rows).collect()}
    assert got[1] == got[4] == ("+x = eval('a/ok')", None) and got[5] == got[6] == (None, None)
    assert got[2][0] == "+# The diff could not be fetched: TimeoutError: too slow\n" and got[2][1] == "TimeoutError: too\nslow"
    assert got[3] == ("+# The diff could not be fetched: HTTP 404\n", "HTTP 404")
    notes = [n.split("-")[0] for n in os.listdir(tmp_path)]
    assert notes.count("get") == 3 and 1 <= notes.count("open") == notes.count("close") <= 3
    reviewed = {r["pr_id"]: r["overall_status"] for r in Engine(spark).review(fetcher.add(rows)).collect()}
    assert reviewed[1] == "BLOCKED" and reviewed[2] == reviewed[3] == "CHANGES_REQUESTED"
    assert Engine(spark, Settings(diff_token="")).fetcher().add(rows).where("pr_id = 1").first()["diff"] == diffs.SIMULATED


def test_model_is_loaded_once_a_process(spark, tmp_path):
    folder = str(tmp_path)

    def loader():
        open(f"{folder}/load-{os.getpid()}-{len(os.listdir(folder))}", "w").close()

        def encode(texts):
            open(f"{folder}/batch-{os.getpid()}-{len(os.listdir(folder))}-{len(texts)}", "w").close()
            if "bad" in texts:
                raise RuntimeError("no")
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    rows = spark.range(300).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("content")).repartition(12)
    for _ in range(2):
        got = chunks.embed_with(rows, loader, model=f"counted-{folder}", batch=10).collect()
        assert len(got) == 300 and all(r["embedding"] == [len(r["content"]), 1.0] and r["embedding_source"] == "model" for r in got)
    loads = [n.split("-")[1] for n in os.listdir(folder) if n.startswith("load")]
    sizes = [int(n.split("-")[3]) for n in os.listdir(folder) if n.startswith("batch")]
    assert 1 <= len(loads) == len(set(loads)) <= 12 and max(sizes) <= 10
    odd = spark.createDataFrame([("bad",), (None,)], "content string").coalesce(1)
    got = chunks.embed_with(odd, loader, model=f"counted-{folder}").collect()
    assert [r["embedding_source"] for r in got] == ["stand-in"] * 2 and all(len(r["embedding"]) == 384 for r in got)
    whole = Engine(spark, Settings(embedding_model="text-embedding-3-small", embedding_key="")).embed(odd).first()
    assert whole["embedding_source"] == "stand-in" and len(whole["embedding"]) == 1536
