"""Exact top-k inner products: tiled matrix products, partial selection per tile, tree merging of top lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import GROUP_BYTES, TILE_BYTES, deal, merge_tree, searcher, usable

BLOCK_ROWS = 8192
_EXACT = float(2**53)
_LONG = 2**63


def scores_of(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued double rows as longs, exact; sums beyond a long are held at its ends."""
    most = np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * q.shape[1]
    if most < _EXACT:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(q).dot(whole(c).T), -_LONG, _LONG - 1).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, at_least) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best (score desc, id asc) of one block whose ids ascend, of the scores that reach
    what at_least(query) asks for; `own` are the query ids."""
    out = []
    for i, (row, me) in enumerate(zip(scores, own)):
        least = at_least(i)
        keep = np.arange(len(ids)) if least is None else np.flatnonzero(row >= least)
        keep = keep[ids[keep] != me]
        s = row[keep]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            above, level = np.flatnonzero(s > edge), np.flatnonzero(s == edge)
            pick = np.concatenate([above, level[: k - len(above)]])
            keep, s = keep[pick], s[pick]
        if len(s):
            out.append((i, ids[keep], s))
    return out


def _tile_product(k: int):
    def search(state, q_ids, q, ids, mat, best):
        c = np.floor(mat * 64)
        for at in range(0, len(q_ids), 256):

            def at_least(i, at=at):
                last = best.last(at + i)
                return None if last is None else -last

            for i, hits, scores in select(scores_of(state[at : at + 256], c), ids, q_ids[at : at + 256], k, at_least):
                best.offer(at + i, -np.maximum(scores, 1 - _LONG), hits)  # the least long has no negative

    return search


def exact_topk(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", tile_bytes: int = TILE_BYTES, group_bytes: int = GROUP_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k rows with the highest integer inner product of floor(64 * x) for each query row of `vectors`.

    `is_query` is a condition on the column `id`. Ties go to the smaller id; rows with the query's own id are no
    candidates. Vectors null, empty or holding null or non-finite components, and rows without an id, take no part;
    vectors of unlike length are never paired. An id that repeats among queries is answered once (for its smallest
    vector); among candidates each row counts. Fewer than k candidates: all of them. Empty table: no rows. Other
    columns are not read. Returns query_id, rank, vec_id, score."""
    rows = usable(vectors, id_col, vec_col)
    queries = rows.where(is_query).groupBy("id").agg(F.min("vec").alias("vec"))
    dealt, parts, _ = deal(rows, queries, tile_bytes, group_bytes)
    run = searcher(k, np.dtype(np.int64), block_rows, lambda q: np.floor(q * 64), _tile_product(k))
    partial = dealt.mapInArrow(run, "query_id long, src int, best array<struct<neg:long,vec_id:long>>")
    return (
        merge_tree(partial, k, parts)
        .select("query_id", F.posexplode("best").alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))
    )
