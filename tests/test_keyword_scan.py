"""Keyword ranks by a scan, and the appended chunks of the expansion: results, and that pairs are not shuffled."""

import collections

import pytest

from lodestone.operators import keyword_scan, retrieval

from test_keyword_and_vectors import slow, texts


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("tile,group,cells", [(1 << 24, 1 << 26, 1 << 22), (2000, 20000, 300)])
@pytest.mark.parametrize("k", [2, 1 << 30])
def test_ranks_of(spark, k, tile, group, cells):
    docs, asked = texts(300)
    chunks, queries = spark.createDataFrame(docs, "id string, content string").repartition(3), spark.createDataFrame(asked, "query_id int, query_text string")
    want = slow(docs, asked)
    named = [(q, w[i][0]) for q, w in want.items() if q is not None for i in (0, 3, len(w) // 2, len(w) - 1) if 0 <= i < len(w)] + [(0, "e1"), (0, "nowhere"), (0, None), (None, "e2")]
    found = keyword_scan.ranks_of(chunks, queries, spark.createDataFrame(named, "query_id int, id string"), k, tile_bytes=tile, group_bytes=group, cells=cells).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found) == sorted({(q, r, d) for q, w in want.items() if q is not None for d, _, r in w if r <= k or (q, d) in named})
    scores = {(q, d): s for q, w in want.items() for d, s, _ in w}
    assert all(abs(r["score"] - scores[r["query_id"], r["id"]]) < 2e-6 for r in found)


def test_ids_that_repeat(spark):
    """Rows of one id and length are one document, an id's lengths share a score; a null id is an id: as by joins."""
    docs = [(1, "a b c"), (1, "a a d"), (1, "b"), (2, "a c"), (None, "a b"), (None, "c c"), (3, "d d d d"), (4, " "), (5, None)]
    chunks = spark.createDataFrame(docs, "id long, content string")
    queries = spark.createDataFrame([(7, "a b"), (8, "c d d"), (9, "z")], "query_id long, query_text string")
    want = collections.defaultdict(list)
    for r in retrieval.bm25(chunks, queries).collect():
        want[r["query_id"]].append((-r["score"], r["id"] is not None, r["id"] or 0))
    also = spark.createDataFrame([(7, 2), (8, 3), (7, 5)], "query_id long, id long")
    got = collections.defaultdict(list)
    for r in sorted(keyword_scan.ranks_of(chunks, queries, also, 9).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((-r["score"], r["id"] is not None, r["id"] or 0))
    assert dict(got) == {q: sorted(w) for q, w in want.items()} and len(got) == 2
    assert keyword_scan.ranks_of(chunks.where("id = 99"), queries, also, 9).count() == 0
    assert keyword_scan.ranks_of(chunks, queries.where("query_id = 9"), also, 9).count() == 0


def test_pairs_are_not_shuffled(spark):
    """Every query shares words with every document; the hits that are asked for stand anywhere among them."""
    docs = [(i, " ".join(f"w{(i * j) % 11}" for j in range(12))) for i in range(2000)]
    chunks = spark.createDataFrame(docs, "id long, content string").repartition(2)
    queries = spark.createDataFrame([(q, " ".join(f"w{(q + j) % 11}" for j in range(6))) for q in range(60)], "query_id long, query_text string")
    also = spark.createDataFrame([(q, q * 31 % 2000) for q in range(60)], "query_id long, id long")
    before = shuffled(spark)
    assert keyword_scan.ranks_of(chunks, queries, also, 6).count() >= 360
    assert shuffled(spark) - before < 60 * 2000 / 5


def test_expansion_is_not_all_of_a_module(spark):
    """Few modules, each of many chunks: all but the first few ids of a module cannot be appended."""
    chunks = spark.createDataFrame([(i, f"m{i % 4}.py") for i in range(2000)] + [(3, "m0.py"), (None, "m1.py"), (None, "m1.py")], "id long, filepath string").repartition(2)
    edges = spark.createDataFrame([("m0", "m1"), ("m1", "m2"), ("m2", "m0"), ("m3", "m3")], "src string, dst string")
    tops = {q: [(q * 7 + j * j) % 40 for j in range(5)] for q in range(60)}
    fused = spark.createDataFrame([(q, i, 1.0, "x", r) for q, ids in tops.items() for r, i in enumerate(dict.fromkeys(ids), 1)], "query_id long, id long, score double, retrieval_method string, rank int")
    before = shuffled(spark)
    got = collections.defaultdict(list)
    for r in sorted(retrieval.expand(fused, chunks, edges, 5).where("retrieval_method = 'graph_expansion'").collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["id"])
    assert shuffled(spark) - before < 60 * 2000 / 5
    lead = {"m0": ["m1", "m2"], "m1": ["m2", "m0"], "m2": ["m0", "m1"], "m3": ["m3", "m3"]}
    held = lambda m: sorted([i for i in range(2000) if i % 4 == int(m[1])] + ([3] if m == "m0" else []))
    for q, ids in tops.items():
        want, ids = [], list(dict.fromkeys(ids))
        for i in ids:
            steps = [s for m in ([f"m{i % 4}"] + (["m0"] if i == 3 else [])) for s in enumerate(lead[m])]
            for _, near in sorted(steps):
                want += [d for d in ([None] if near == "m1" else []) + held(near)[:20] if d not in ids and d not in want]
        assert got[q] == want[:2], q
