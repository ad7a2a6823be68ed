"""Manifest, substring dedup and vector codes against plain code, on odd tables: nulls, empty and very long texts, ties,
repeated rows, other columns that clash with names used inside."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import merkle, substring_dedup, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAN, INF = float("nan"), float("inf")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def slow_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    of = collections.defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        own = sha(*map(enc, (doc_id, source, lang, n_chars, text)))
        lower = None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        of[source].append((doc_id, own, sha(*map(enc, (doc_id, source, lang, n_chars, lower))) if changed else own))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        of[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([x[1] for x in of[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, own, acc) in enumerate(of[s]):
            beside = []
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    first = at // 16 * 16
                    run, j = level[first : first + 16], at - first
                    beside += run[:j] + run[j + 1 :]
                    acc, at = sha(*run[:j], acc, *run[j + 1 :]), at // 16
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], sha(*beside), acc, acc == top[-1][0]))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def some_documents(n, sources):
    draw = random.Random(3)
    rows = [(i, draw.choice(sources), draw.choice(["en", None]), draw.choice([i, None]), draw.choice([None, "", "Ab é\n" * i, "X" * 30000])) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "s1", "", 0, "No id"), (3, "s1", "en", 3, "again"), rows[5], rows[5]]


@pytest.mark.parametrize("n,sources", [(0, ["a"]), (700, ["big", "big", "big", "", None, "é", "z"]), (300, [f"s{i}" for i in range(290)])])
def test_manifest(spark, n, sources):
    rows = some_documents(max(n, 6), sources) if n else [(7, "a", "en", 1, "T")]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, at int, leaf string, path string")
    assert rows_of(merkle.verified_manifest(docs)) == sorted(slow_manifest(rows), key=repr)


def test_manifest_of_other_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.verified_manifest(docs).collect() == []
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = slow_manifest([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert rows_of(merkle.verified_manifest(docs)) == sorted(want, key=repr)


def test_paths(spark):
    """The operator itself gives whole paths, which anyone can fold."""
    rows = spark.range(600).selectExpr("'s' AS source", "id AS doc_id", "sha2(string(id), 256) AS leaf", "id * 2 AS more")
    found = merkle.manifest(rows, ["doc_id", "leaf", "more"]).collect()
    assert len(found) == 600 and {len(r["path"]) for r in found} == {3}
    for r in found[::50]:
        acc = r["leaf"]
        for step in r["path"]:
            acc = sha(step["left"], acc, step["right"])
        assert acc == r["subroot"] == r["root"] and r["more"] == 2 * r["doc_id"]


def slow_substrings(rows):
    words = [(doc_id, WORD.findall(text or "")) for doc_id, text in rows]
    least = {}
    for doc_id, w in words:
        for i in range(len(w) - 49 if doc_id is not None else 0):
            k = tuple(w[i : i + 50])
            least[k] = min(doc_id, least.get(k, doc_id))
    out = []
    for doc_id, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 49 if doc_id is not None else 0):
            if least[tuple(w[i : i + 50])] < doc_id:
                gone[i : i + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc_id, len(w), len(w) - len(kept), sha(" ".join(kept))))
    return sorted(out, key=repr)


def some_texts():
    draw = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)] + ["é", " ", "\U0001f600"]
    passages = [[draw.choice(vocabulary) for _ in range(n)] for n in (49, 50, 51, 70, 200)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, " ".join(passages[4])), (None, " ".join(passages[4])), (4, "a " * 400), (5, "a " * 49), (6, "a\n" * 50), (7, "b a " * 30), (8, "x" * 60000)]
    for i in range(10, 150):
        body = [draw.choice(vocabulary) for _ in range(draw.randint(0, 120))]
        for p in draw.sample(passages, draw.randint(0, 3)):
            at = draw.randint(0, len(body))
            body[at:at] = p
        rows.append((i, draw.choice([" ", "\n", "  \t"]).join(body)))
    rows += [(900 + i, rows[30][1]) for i in range(40)] + [rows[20], rows[20], (30, rows[21][1]), (5000, " ".join(draw.choice(vocabulary) for _ in range(40000)) + " " + " ".join(passages[3]))]
    return rows


@pytest.mark.parametrize("cells,windows,tile,bucket", [(2_000_000, 1_000_000, 1_000_000, 2_000_000), (200, 300, 50, 400)])
def test_substrings(spark, monkeypatch, cells, windows, tile, bucket):
    """Whole, and cut into many sketches, tiles, blocks and buckets, where the sizes hold in the driver's process."""
    for name, value in (("SKETCH_CELLS", cells), ("BLOCK_WINDOWS", windows), ("TILE_CELLS", tile), ("BUCKET_WINDOWS", bucket)):
        monkeypatch.setattr(substring_dedup, name, value)
    rows = some_texts()
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, part int, spans string, k1 string")
    assert rows_of(substring_dedup.dedup_substrings(docs)) == slow_substrings(rows)


def test_substrings_of_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(substring_dedup.dedup_substrings(docs)) == slow_substrings([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert substring_dedup.dedup_substrings(docs.where("doc_id < 0")).collect() == []


def test_sketch_never_underestimates():
    """Texts dealt to several sketches: every window that two of them hold is estimated repeated, most others are not."""
    import pyarrow as pa

    draw = random.Random(1)
    shared = [b"s%d" % draw.randint(0, 999) for _ in range(80)]
    texts = [[b"w%d" % draw.randint(0, 9999) for _ in range(300)] + (shared if i % 3 == 0 else []) for i in range(30)]
    found = [[np.unique(c) for c in substring_dedup.cells(t)] for t in texts]
    parts = []
    for at in (0, 10, 20):
        for r in range(2):
            cell, count = np.unique(np.concatenate([f[r] for f in found[at : at + 10]]), return_counts=True)
            parts.append((at, r, cell.tobytes(), np.minimum(count, 2).astype(np.uint8).tobytes()))
    often = [set(), set()]
    for r in range(2):
        mine = [p for p in parts if p[1] == r]
        out = substring_dedup._merged(pa.table({n: list(c) for n, c in zip(("part", "tile", "cells", "counts"), zip(*mine))}))
        for x in out.column("often").to_pylist():
            often[r] |= set(np.frombuffer(x, np.uint64).tolist())
    windows = collections.Counter(w for t in texts for w in {tuple(t[i : i + 50]) for i in range(len(t) - 49)})
    estimated = {tuple(t[i : i + 50]) for t in texts for i in range(len(t) - 49) if all(int(c[i]) in o for c, o in zip(substring_dedup.cells(t), often))}
    true = {w for w, n in windows.items() if n > 1}
    assert len(true) == 31 and true <= estimated and len(estimated) < len(windows) / 4


def slow_codes(rows):
    rows = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    z = np.floor(np.array([r[1] for r in rows], np.float64) * 256).astype(np.int64).reshape(len(rows), 16, -1)
    books = z[:64].swapaxes(0, 1).copy()

    def assigned():
        return np.array([((z[:, p, None] - books[p]) ** 2).sum(axis=2).argmin(axis=1) for p in range(16)])

    for _ in range(2):
        at = assigned()
        for p in range(16):
            for e in set(at[p].tolist()):
                of = z[at[p] == e, p]
                books[p, e] = of.sum(axis=0) // len(of)
    at = assigned()
    error = sum(((z[:, p] - books[p][at[p]]) ** 2).sum(axis=1) for p in range(16))
    totals = collections.Counter()
    for r, e in zip(rows, error.tolist()):
        totals[r[2]] += e
    name = sha(",".join(map(str, books.ravel().tolist())))
    return sorted([(r[0], bytes(at[:, i].tolist()).hex(), int(error[i]), totals[r[2]], name) for i, r in enumerate(rows)], key=repr)


def some_vectors(n, dim):
    draw = np.random.default_rng(4)
    one = lambda: [float(np.float32(x)) for x in draw.integers(-3, 4, dim) / 256 * draw.choice([1, 100])]  # noqa: E731  many ties
    rows = [(int(i), one(), int(draw.integers(0, 3))) for i in draw.permutation(n)]
    rows += [(5000 + i, rows[0][1], None) for i in range(200)] + [(None, one(), 1), (None, None, 1), (3, one(), 2), rows[1], rows[1]]
    return rows + [(-1, None, 1), (-2, [NAN] * dim, 1), (-3, [INF] + [0.0] * (dim - 1), 1), (-4, [None] + [1.0] * (dim - 1), 1)]


@pytest.mark.parametrize("n,dim", [(900, 32), (20, 64), (400, 16)])
def test_codes(spark, n, dim):
    rows = some_vectors(n, dim)
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, item int, code string, of int").repartition(3)
    assert rows_of(vector_codes.vector_codes(table)) == slow_codes(rows)
    assert vector_codes.vector_codes(table.where("vec_id < -90")).collect() == []


def test_codes_of_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = slow_codes([(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()])
    assert rows_of(vector_codes.vector_codes(table)) == want
    odd = table.selectExpr("vec_id", "slice(embedding, 1, 60) AS embedding", "label").unionByName(table.where("vec_id < 3").selectExpr("vec_id", "slice(embedding, 1, 32) AS embedding", "label"))
    assert {r["vec_id"] for r in vector_codes.vector_codes(odd).collect()} == {0, 1, 2}  # 60 parts cannot be cut into 16


def test_bounds_skip_and_lose_nothing():
    """Entries that hardly move: equal entries and distances to plain code, for a fraction of the distances."""
    draw = np.random.default_rng(6)
    centres = draw.integers(-4000, 4000, (64, 4))
    x = centres[draw.integers(0, 64, 5000)] + draw.integers(-40, 41, (5000, 4))
    group = vector_codes.grouped(centres)
    entry, best, bounds, took = vector_codes.nearest(x, centres, group, None, None)
    assert took >= 64 * len(x)
    for _ in range(3):
        later = centres + draw.integers(-15, 16, centres.shape)
        drift = np.sqrt(((later - centres) ** 2).sum(axis=1)) * (1 + vector_codes.SLACK)
        fall = np.array([drift[group == g].max() for g in range(group.max() + 1)])
        entry, best, bounds, took = vector_codes.nearest(x, later, group, entry, bounds.astype(np.float16) - fall)
        d = ((x[:, None] - later) ** 2).sum(axis=2)
        assert (entry == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        assert took < 64 * len(x) / 3
        centres = later
