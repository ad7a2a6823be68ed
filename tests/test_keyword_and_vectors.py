"""Keyword and vector search against plain code: words of very different frequency, ties, odd rows, other partitions."""

import collections
import math
import random

import numpy as np
import pytest

from lodestone.functions.stage_log import StageLog
from lodestone.operators import keyword, retrieval


def texts(n):
    """Few words are in nearly all texts, most in a few: as in real ones."""
    draw = random.Random(8)
    words, weights = [f"w{i}" for i in range(3000)], [1 / (i + 1) for i in range(3000)]
    docs = [(f"d{i:04}", " ".join(draw.choices(words, weights, k=draw.choice([5, 20, 80, 300])))) for i in range(n)]
    asked = [(q, " ".join(draw.choices(words, weights, k=6) + draw.choices(words[200:], k=4) + ["w1", "w1", "absent"])) for q in range(40)]
    return docs + [("e0", None), ("e1", ""), ("e2", docs[3][1]), ("e3", docs[3][1].upper())], asked + [(90, ""), (91, None), (92, "absent"), (93, docs[3][1]), (None, "w1")]


def slow(docs, asked):
    tf = {d: collections.Counter((t or "").lower().split()) for d, t in docs}
    lengths = [sum(c.values()) if t is not None else None for (d, t), c in zip(docs, tf.values())]
    n, avg = len(docs), sum(x for x in lengths if x is not None) / sum(x is not None for x in lengths)
    df = collections.Counter(w for c in tf.values() for w in c)
    out = {}
    for q, text in asked:
        scored = []
        for d, c in tf.items():
            s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in (text or "").lower().split() if c[w])
            if round(s, 6) > 0:
                scored.append((-round(s, 6), d))
        out[q] = [(d, -s, r) for r, (s, d) in enumerate(sorted(scored), 1)]
    return out


def close(got, want):
    return [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want] and all(abs(x[1] - y[1]) < 2e-6 for x, y in zip(got, want))


@pytest.mark.parametrize("k", [1, 7])
def test_best_hits(spark, tmp_path, k):
    docs, asked = texts(700)
    chunks, queries = spark.createDataFrame(docs, "id string, content string"), spark.createDataFrame(asked, "query_id int, query_text string")
    want, log = slow(docs, asked), StageLog(spark)
    index = keyword.build(chunks)
    index.write(f"{tmp_path}/index")
    for source in (index, keyword.Index.read(spark, f"{tmp_path}/index")):
        got = collections.defaultdict(list)
        for r in keyword.search(source, queries, k, log if source is index else None).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["id"], r["score"], r["rank"]))
        assert {q for q, w in want.items() if w and q is not None} == set(got)
        assert all(close(got[q], want[q][:k]) for q in got)
    pairs = sum(len(w) for q, w in want.items() if q is not None)
    print("pairs", log.values(), pairs)
    assert log.values()["pairs"]["rows"] < pairs / (10 if k == 1 else 5)
    assert keyword.search(index, queries.where("query_id < 0"), k).count() == 0


def test_ranks_of_named(spark):
    """Documents far down keep their ranks among all, without these being sorted."""
    docs, asked = texts(300)
    chunks, queries = spark.createDataFrame(docs, "id string, content string"), spark.createDataFrame(asked, "query_id int, query_text string")
    want = slow(docs, asked)
    named = [(q, w[i][0]) for q, w in want.items() if q is not None for i in (0, 3, len(w) // 2, len(w) - 1) if 0 <= i < len(w)] + [(0, "e1"), (0, "nowhere")]
    found = keyword.ranks_with(keyword.build(chunks, only=keyword.asked_terms(queries)), queries, spark.createDataFrame(named, "query_id int, id string"), 2)
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in found.collect())
    assert got == sorted({(q, r, d) for q, w in want.items() if q is not None for d, _, r in w if r <= 2 or (q, d) in named})


def test_depth_of_the_keyword_leg():
    for k in (1, 5, 100, 400):
        depth = retrieval.keyword_depth(k)
        score = lambda b: round(round(1 / (60 + b), 9) / (2 / 61), 4)
        assert depth >= k and score(depth + 1) < score(k)


@pytest.mark.parametrize("tile,group", [(1 << 24, 1 << 28), (400, 3000)])
def test_nearest(spark, tile, group):
    draw = np.random.default_rng(3)
    rows = [(f"v{i:03}", draw.integers(-3, 4, 6).astype(float).tolist()) for i in range(500)] + [("n0", None), ("n1", []), ("n2", [0.0] * 6), ("n3", [None] + [1.0] * 5), ("n4", [1.0, 2.0]), (None, [1.0] * 6)]
    chunks = spark.createDataFrame([(*r, 1) for r in rows], "id string, embedding array<float>, side int").repartition(3)
    asked = [(q, rows[q][1]) for q in range(0, 60, 2)] + [(700, [2.0, 1.0]), (701, [0.0] * 6), (702, None), (None, [1.0] * 6), (703, [1.0] * 9)]
    found = retrieval.vector_topk(chunks, spark.createDataFrame(asked, "query_id int, query_vec array<float>"), 9, tile_bytes=tile, group_bytes=group)
    want = []
    for q, v in asked:
        scored = []
        for i, w in rows:
            if q is not None and i and v and w and len(v) == len(w) and None not in w and any(v) and any(w):
                scored.append((-round(float(np.dot(v, w) / math.sqrt(np.dot(v, v)) / math.sqrt(np.dot(w, w))), 6), i))
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:9], 1)]
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect()) == sorted(want)
    assert retrieval.vector_topk(chunks.where("id = ''"), spark.createDataFrame(asked, "query_id int, query_vec array<float>"), 9).count() == 0
