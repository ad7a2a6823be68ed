import pytest

from lodestone.sources import tables

CHUNKS = "id string, filepath string, chunk_index int, content string"


def rows(spark, files, parts=3, text="x"):
    return spark.createDataFrame([(f"{f}_{i}", f, i, text * 50) for f in files for i in range(parts)], CHUNKS)


def sizes(folder):
    return {str(p.relative_to(folder)): p.stat().st_size for p in folder.rglob("*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path), CHUNKS, buckets=16)
    files = [f"src/f{i}.py" for i in range(60)]
    store.replace(rows(spark, files))
    before = sizes(tmp_path)
    assert store.read().count() == 180 and 10 < len(store.manifest()["buckets"]) <= 16
    assert store.upsert_chunks(rows(spark, ["src/f7.py"], 1, "new"), replace_file=True) == 1
    written = {n: s for n, s in sizes(tmp_path).items() if n not in before}
    assert len(written) == 1 and sum(written.values()) < sum(before.values()) / 5
    got = {r["id"]: r["content"] for r in store.read().collect()}
    assert len(got) == 178 and got["src/f7.py_0"] == "new" * 50 and "src/f7.py_1" not in got
    assert store.upsert_chunks(rows(spark, ["src/f8.py"], 4)) == 1 and store.read().count() == 179
    assert store.upsert_chunks(rows(spark, [])) == 0
    found = store.lookup(spark.createDataFrame([("src/f8.py",), ("none",)], "filepath string"))
    assert found.count() == 4 and len(found.inputFiles()) <= 2


def test_versions_and_two_writers(spark, tmp_path):
    one, two = (tables.Store(spark, str(tmp_path), tables.EDGES, ("src", "dst", "relation"), 4) for _ in range(2))
    edge = lambda *e: spark.createDataFrame(list(e), tables.EDGES)
    one.upsert_edges(edge(("a", "b", "IMPORTS"), ("a", "b", "IMPORTS"), ("b", "c", "CALLS")))
    stale = two.manifest()["version"]
    one.upsert_edges(edge(("c", "d", "IMPORTS"), ("a", "b", "IMPORTS")))
    with pytest.raises(tables.Conflict):
        two._commit(stale, {})
    assert one.versions() == [1, 2] and one.read().count() == 3 and one.read(1).count() == 2
    two.clear()
    assert one.read().count() == 0 and one.read(2).count() == 3
    one.replace(edge((None, "x", "R")))
    assert [tuple(r) for r in two.read().collect()] == [(None, "x", "R")]
    assert one.vacuum() and one.versions() == [4] and two.read().count() == 1 and one.vacuum() == []
