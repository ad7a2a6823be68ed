"""Approximate nearest neighbours by cosine: a forest of sorted hash-string arrays over all rows.

A tree's hash string of a vector has SYMBOLS binary symbols: on which side of as many random directions it lies. Each tree
is a sorted array of strings, kept in parts: the rows of one group. A binary search takes a query to its longest matches
in every tree; from there all trees ascend together, a symbol at a time. An entry is met in a tree at every length from
its own longest match with the query upwards, so an entry of long matches in many trees has been met often when the ascent
ends, and entries met often enough are ranked by exact cosine.

Where a query's ascent ends, and how often is enough, follows from its floor: the cosine of its k-th best among a sample
of rows, which its k-th best among all rows cannot lie under. Two vectors of that cosine share a symbol with a known
probability, from which the meetings of their strings have a known mean and spread: the ascent ends where MEETINGS trees
are expected to have met such a neighbour, and enough is what such neighbours have with probability TARGET. Both depend on
the query and the sample alone, not on how rows are dealt to parts."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import GROUP_BYTES, TILE_BYTES, deal, merge_tree, searcher, settle, usable

TREES, SYMBOLS, SEED = 192, 48, 17
MEETINGS, TARGET = 20, 0.95
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 16 << 20  # rows whose nearest are each query's floor
BLOCK_ROWS, BLOCK_QUERIES = 8192, 128


def directions(dim: int, trees: int) -> np.ndarray:
    """(dim, trees * SYMBOLS) directions, a rule of the seed and the sizes, so every part and query uses the same; those
    of a tree are orthogonal as far as there is room."""
    draw, axes = np.random.default_rng([SEED, dim]), min(dim, SYMBOLS)
    tree = lambda: np.concatenate([np.linalg.qr(draw.standard_normal((dim, axes)))[0] for _ in range(-(-SYMBOLS // axes))], axis=1)[:, :SYMBOLS]
    return np.concatenate([tree() for _ in range(trees)], axis=1).astype(np.float32)


_kept: dict[tuple[int, int], np.ndarray] = {}


def unit(mat: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that very large or very small rows keep their direction."""
    mat = mat / np.abs(mat).max(axis=1, keepdims=True)
    return mat / np.sqrt((mat * mat).sum(axis=1, keepdims=True))


def hash_strings(mat: np.ndarray, trees: int) -> np.ndarray:
    """(trees, rows) strings of unit vectors as integers, the first symbol in the highest of SYMBOLS bits."""
    dim = mat.shape[1]
    if (dim, trees) not in _kept:
        _kept.clear()
        _kept[dim, trees] = directions(dim, trees)
    out, way, small = np.zeros((trees, len(mat)), np.uint64), _kept[dim, trees], mat.astype(np.float32)
    for at in range(0, len(mat), 512):
        sides = (small[at : at + 512] @ way > 0).reshape(-1, trees, SYMBOLS)
        packed = np.zeros((*sides.shape[:2], 8), np.uint8)
        packed[..., 8 - SYMBOLS // 8 :] = np.packbits(sides, axis=2)
        out[:, at : at + 512] = packed.view(">u8")[..., 0].T
    return out


def ascent(floor: np.ndarray, trees: int, target: float) -> tuple[np.ndarray, np.ndarray]:
    """For each floor the length at which the ascent ends, and how many meetings are enough there."""
    same = np.clip(1 - np.arccos(np.clip(floor, -1, 1)) / math.pi, 0.05, 0.995)  # that two vectors of this cosine share a symbol
    end = np.clip(np.floor(math.log(min(MEETINGS, trees / 2) / trees) / np.log(same)), 1, SYMBOLS).astype(np.int64)
    length = np.arange(1, SYMBOLS + 1)
    alike = np.where(length >= end[:, None], same[:, None] ** length, 0.0)  # that strings match to this length
    mean = trees * alike.sum(axis=1)
    spread = np.sqrt(trees * np.maximum((alike * (2 * (length - end[:, None]) + 1)).sum(axis=1) - alike.sum(axis=1) ** 2, 0))
    return end, np.maximum(1, np.floor(mean - NormalDist().inv_cdf(target) * spread)).astype(np.int64)


def meetings(codes: np.ndarray, orders: np.ndarray, asked: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(queries, entries): at how many lengths, over all trees, a query has met an entry when its ascent ends. A tree's
    entries within the query's prefix of length `end` stand together; one that matches to length m was met m - end + 1
    times there."""
    trees, n = codes.shape
    below = (np.uint64(1) << (SYMBOLS - end).astype(np.uint64)) - np.uint64(1)
    out = np.zeros(asked.shape[1] * n)
    places, weights, held = [], [], 0
    for t in range(trees):
        first = np.searchsorted(codes[t], asked[t] & ~below)
        size = np.searchsorted(codes[t], asked[t] | below, side="right") - first
        if size.any():
            query = np.repeat(np.arange(len(size)), size)
            at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            unlike = np.frexp((codes[t][at] ^ asked[t][query]).astype(np.float64))[1]  # symbols after the match
            places.append(query * n + orders[t][at])
            weights.append(SYMBOLS - unlike - end[query] + 1)
            held += len(at)
        if places and (held > 2_000_000 or t == trees - 1):
            out += np.bincount(np.concatenate(places), np.concatenate(weights), len(out))
            places, weights, held = [], [], 0
    if places:
        out += np.bincount(np.concatenate(places), np.concatenate(weights), len(out))
    return out.reshape(-1, n)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Correctly rounded sums, so that equal vectors always score alike."""
    sa, sb = np.abs(a).max(), np.abs(b).max()
    if not 1e-140 < sa < 1e140:
        a = a / sa
    if not 1e-140 < sb < 1e140:
        b = b / sb
    return math.fsum((a * b).tolist()) / (math.sqrt(math.fsum((a * a).tolist())) * math.sqrt(math.fsum((b * b).tolist())))


def _rank(i: int, found: np.ndarray, asked, normal, q_ids, q, first, twins, mat, best) -> None:
    """Offers the found entries of a block that can still be among the k best of query i."""
    near = normal[found] @ asked[i]
    if len(found) > best.k + 1:
        edge = np.partition(near, len(near) - best.k - 1)[len(near) - best.k - 1]
        found, near = found[near >= edge - 1e-9], near[near >= edge - 1e-9]
    last = best.last(i)
    if last is not None:
        found = found[near >= -last - 1e-9]
    neg, ids = [], []
    for j in found:
        own = twins[first[j] : first[j + 1]]
        own = own[own != q_ids[i]]
        if len(own):
            neg.append(np.full(len(own), -exact_cosine(q[i], mat[j])))
            ids.append(own)
    if neg:
        best.offer(i, np.concatenate(neg), np.concatenate(ids))


def distinct(ids: np.ndarray, mat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors of a block, the borders of each one's ids, and these: the k + 1 smallest, all that a result can hold."""
    _, lead, inverse = np.unique(np.ascontiguousarray(mat + 0.0).view(f"V{8 * mat.shape[1]}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, inverse))
    place = np.arange(len(ids)) - np.searchsorted(inverse[order], inverse[order])
    order = order[place <= k]
    return mat[lead], np.r_[0, np.cumsum(np.bincount(inverse[order], minlength=len(lead)))], ids[order]


def floors(asked: np.ndarray, q_ids: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The cosine of each query's k-th best among the sample, rows of its own id aside; -2 where the sample has fewer."""
    ids, normal = sample
    out = np.full(len(asked), -2.0)
    if len(ids) < k:
        return out
    for at in range(0, len(asked), 1024):
        near = asked[at : at + 1024] @ normal.T
        near[q_ids[at : at + 1024, None] == ids] = -2
        out[at : at + 1024] = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
    return out


def _search(k: int, trees: int, target: float, samples: dict[int, tuple[np.ndarray, np.ndarray]], ranked=None):
    """Search of one block. A target of 1 or more, and a query without a floor, ranks all entries. `ranked` counts
    candidates (of this process)."""

    def search(state, q_ids, q, ids, mat, best):
        if "floor" not in state:
            sample = samples.get(q.shape[1])
            state["floor"] = floors(state["asked"], q_ids, sample, k) if sample is not None and target < 1 else np.full(len(q), -2.0)
            state["end"], state["enough"] = ascent(state["floor"], trees, min(target, 0.9999))
        own, first, twins = distinct(ids, mat, k)
        normal, n = unit(own), len(own)
        led = state["floor"] > -2
        if led.any():
            codes = hash_strings(normal, trees)
            orders = np.argsort(codes, axis=1, kind="stable").astype(np.int64)
            codes = np.take_along_axis(codes, orders, 1)
        for at in range(0, len(q_ids), BLOCK_QUERIES):
            here = np.arange(at, min(at + BLOCK_QUERIES, len(q_ids)))
            with_floor = here[led[here]]
            met = meetings(codes, orders, state["strings"][:, with_floor], state["end"][with_floor]) if len(with_floor) else None
            row = dict(zip(with_floor.tolist(), range(len(with_floor))))
            for i in here.tolist():
                found = np.flatnonzero(met[row[i]] >= state["enough"][i]) if i in row else np.arange(n)
                if ranked is not None:
                    ranked[0] += len(found)
                if len(found):
                    _rank(i, found, state["asked"], normal, q_ids, q, first, twins, own, best)

    return search


FOUND = "query_id long, src int, best array<struct<neg:double,vec_id:long>>"


def _run(k: int, trees: int, target: float, samples: dict, block_rows: int):
    def prepare(q):
        asked = unit(q)
        return {"asked": asked, "strings": hash_strings(asked, trees) if target < 1 else None}

    return searcher(k, np.dtype(np.float64), block_rows, prepare, _search(k, trees, target, samples))


def sample_of(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the SAMPLE_ROWS rows of smallest hashes, fewer where that is more than SAMPLE_BYTES, by
    dimension: all that the driver gets, whatever the table's size."""
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 1
    # any rows would do: the hash only has to know nothing of where a vector points
    some = rows.orderBy(F.xxhash64(F.lit("sample"), "id"), "id", "vec").limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * longest)))).collect()
    out = {}
    for dim in {len(r["vec"]) for r in some}:
        mine = [r for r in some if len(r["vec"]) == dim]
        out[dim] = np.array([r["id"] for r in mine], np.int64), unit(np.array([r["vec"] for r in mine]))
    return out


def forest_search(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, target: float = TARGET, tile_bytes: int = TILE_BYTES, group_bytes: int = GROUP_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest rows by cosine that the forest finds for each query row of `vectors`.

    Every row is indexed. `is_query` is a condition on the column `id`. Scores are exact cosines of the original
    vectors; ties go to the smaller id; rows with the query's own id are no candidates. Vectors null, zero, empty or
    holding null or non-finite components, and rows without an id, take no part; unlike lengths never meet. An id that
    repeats among queries is answered once (smallest vector). Equal vectors of a block share one entry that keeps their
    k + 1 smallest ids, all that a result can hold. A query that has found fewer than k rows ranks all rows, so it has
    fewer only where there are no more; so does every query if target is 1 or more. Empty table: no rows.
    Returns query_id, rank, vec_id, score."""
    rows = usable(vectors, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    queries = rows.where(is_query).groupBy("id").agg(F.min("vec").alias("vec"))

    def found(asked: DataFrame, aim: float, samples: dict) -> DataFrame:
        dealt, parts, _ = deal(rows, asked, tile_bytes, group_bytes)
        return settle(merge_tree(dealt.mapInArrow(_run(k, trees, aim, samples, block_rows), FOUND), k, parts).select("query_id", "best"), "forest")

    merged = found(queries, target, sample_of(rows) if target < 1 else {})
    full = merged.where(F.size("best") >= k)
    short = queries.join(full.select(F.col("query_id").alias("id")), "id", "left_anti")
    if target < 1 and not short.isEmpty():
        merged = full.unionByName(found(short, 1.0, {}))
    return (
        merged.select("query_id", F.posexplode("best").alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))
    )
