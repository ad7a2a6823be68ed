"""The retrieval queries over all their queries and documents, against plain code on small tables."""

import collections
import math

import pytest

from lodestone.plans import catalog

WORDS = "ash birch cedar dogwood elm fir gum hazel ivy juniper".split()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Ids go past 10 and 200, the bounds of the queries that their SQL names."""
    where = str(tmp_path_factory.mktemp("small"))
    vectors = [(i, [math.cos(i * i * 0.7), math.sin(i * 1.3), math.cos(i + 0.4)], 0) for i in range(0, 30)]
    docs = [(i * 9, " ".join(WORDS[(i * j * j + j) % 10] for j in range(3 + i % 5)), f"src{i % 20}") for i in range(40)]
    asked = [(i, " ".join(WORDS[(i * 3 + j * j) % 10] for j in range(3))) for i in range(0, 26, 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{where}/embeddings.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, {r["vec_id"]: list(r["embedding"]) for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()}, docs, asked


def slow_vector(vectors, k):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = {}
    for q, v in vectors.items():
        scored = sorted((-round(dot(v, w) / math.sqrt(dot(v, v)) / math.sqrt(dot(w, w)), 6), i) for i, w in vectors.items())[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def slow_bm25(docs, asked):
    tf = {d: collections.Counter(t.split()) for d, t, _ in docs}
    n, avg = len(docs), sum(sum(c.values()) for c in tf.values()) / len(docs)
    df = collections.Counter(w for c in tf.values() for w in c)
    out = {}
    for q, text in asked:
        scored = []
        for d, c in tf.items():
            s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in text.split() if c[w])
            if round(s, 6) > 0:
                scored.append((-round(s, 6), d))
        out[q] = [(d, -s) for s, d in sorted(scored)]
    return out


def slow_fused(vectors, docs, asked):
    near, words, out = slow_vector(vectors, 15), slow_bm25(docs, asked), {}
    for q, _ in asked:
        v = {i: r for r, (i, _) in enumerate(near.get(q, []), 1)}
        b = {i: r for r, (i, _) in enumerate(words[q], 1)}
        raw = {i: round((1 / (60 + v[i]) if i in v else 0) + (1 / (60 + b[i]) if i in b else 0), 9) for i in v.keys() | b.keys()}
        out[q] = sorted((-round(min(s / (2 / 61), 1), 4), i) for i, s in raw.items())[:5]
    return out


def by_query(rows, *columns):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append(tuple(r[c] for c in columns))
    return dict(out)


def test_vectors(spark, small):
    where, vectors, _, _ = small
    got = by_query(catalog.QUERIES["vector_topk_all"](spark, where).collect(), "id", "score")
    want = slow_vector(vectors, 5)
    assert got.keys() == want.keys() and len(got) == 30
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)


def test_bm25(spark, small):
    where, _, docs, asked = small
    want = slow_bm25(docs, asked)
    got = by_query(catalog.QUERIES["bm25_topk_all"](spark, where).collect(), "id")
    assert got == {q: [(i,) for i, _ in rows[:5]] for q, rows in want.items()}
    hits = {r["query_id"]: (r["hits"], r["best"]) for r in catalog.QUERIES["bm25_scores_all"](spark, where).collect()}
    assert hits.keys() == want.keys() and all(hits[q][0] == len(want[q]) and hits[q][1] == pytest.approx(want[q][0][1], abs=2e-6) for q in want)


def test_fusion_and_expansion(spark, small):
    where, vectors, docs, asked = small
    want = slow_fused(vectors, docs, asked)
    got = by_query(catalog.QUERIES["hybrid_rrf_all"](spark, where).collect(), "id")
    assert got == {q: [(i,) for _, i in rows] for q, rows in want.items()}
    edges = {(k, (k * 3 + 1) % 20) for k in range(20)}
    module = {d: int(s[3:]) for d, _, s in docs}
    added = collections.defaultdict(list)
    for q, rows in want.items():
        have = {i for _, i in rows}
        for _, i in rows:
            steps = [(0, b) for a, b in edges if a == module.get(i)] + [(1, a) for a, b in edges if b == module.get(i)]
            for _, near in sorted(steps, key=lambda s: (s[0], f"s{s[1]}")):
                for d in sorted(d for d, m in module.items() if m == near and d not in have):
                    if len(added[q]) < 2:
                        added[q].append(d)
                        have.add(d)
    rows = [r for r in catalog.QUERIES["hybrid_graph_expansion_all"](spark, where).collect() if r["retrieval_method"] == "graph_expansion"]
    assert by_query(rows, "id") == {q: [(d,) for d in ids] for q, ids in added.items() if ids}
    assert any(r["id"] >= 200 for r in rows)
