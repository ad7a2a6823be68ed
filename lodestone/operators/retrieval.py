"""Retrieval for many queries in one plan: exact vectors, BM25, rank fusion, expansion along the module graph."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.lineage import cut
from lodestone.functions.text import module_lenient, tokens
from lodestone.operators import keyword_scan

K1, B, RRF, PLACES = 1.5, 0.75, 60, 6
TILE_BYTES, GROUP_BYTES, BLOCK_ROWS, BLOCK_QUERIES = 16 << 20, 256 << 20, 4096, 1024
LEAST_ROWS = 4096  # fewer are not worth a task of their own


def _unit(vec, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that have this many numbers and a length, as unit vectors, and which rows these are."""
    ends = vec.offsets.to_numpy()
    rows = np.flatnonzero(np.diff(ends) == dim)
    mat = vec.values.to_numpy(zero_copy_only=False)[ends[rows][:, None] + np.arange(dim)]
    length = np.sqrt((mat * mat).sum(axis=1))
    fine = np.isfinite(length) & (length > 0)
    return rows[fine], mat[fine] / length[fine, None]


class _Tile:
    """The queries of one length of one tile, with the k best rows that each has seen: micros, scores in units of the last
    place that counts, falling, and ids, rising among equal ones."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, k: int) -> None:
        self.ids, self.mat, self.k = ids, mat, k
        self.micros, self.found = np.full((len(ids), 0), 0, np.int64), np.empty((len(ids), 0), object)

    def see(self, ids: np.ndarray, mat: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, mat, places = ids[order], mat[order], np.arange(len(ids))
        take = min(self.k, len(ids))
        for at in range(0, len(self.ids), BLOCK_QUERIES):
            scores = np.rint(self.mat[at : at + BLOCK_QUERIES] @ mat.T * 10**PLACES).astype(np.int64)
            key = places - scores * len(ids)  # least is best: the highest score, of equal ones the smallest id
            best = np.argpartition(key, take - 1, axis=1)[:, :take] if take < len(ids) else np.broadcast_to(places, key.shape)
            self._merge(at, np.take_along_axis(scores, best, axis=1), ids[best])

    def _merge(self, at: int, micros: np.ndarray, ids: np.ndarray) -> None:
        if self.micros.shape[1] < self.k:  # room for k, filled with what never counts
            more = self.k - self.micros.shape[1]
            self.micros = np.pad(self.micros, ((0, 0), (0, more)), constant_values=np.iinfo(np.int64).min)
            self.found = np.concatenate([self.found, np.full((len(self.ids), more), ids.flat[0], object)], axis=1)
        here = slice(at, at + len(micros))
        micros, ids = np.concatenate([self.micros[here], micros], axis=1), np.concatenate([self.found[here], ids.astype(object)], axis=1)
        by_id = np.argsort(ids, axis=1, kind="stable")
        micros, ids = np.take_along_axis(micros, by_id, axis=1), np.take_along_axis(ids, by_id, axis=1)
        order = np.argsort(-np.maximum(micros, -(1 << 62)), axis=1, kind="stable")[:, : self.k]
        self.micros[here], self.found[here] = np.take_along_axis(micros, order, axis=1), np.take_along_axis(ids, order, axis=1)


def _search(k: int, query_kind, id_kind):
    """mapInArrow function over dealt rows, sorted by part and side: keeps a part's queries, passes its rows by them in
    blocks, and gives the best of each query at the end of the part."""
    import pyarrow as pa

    def run(batches):
        part, tiles, waiting = None, {}, {}

        def finish():
            for dim in list(waiting):
                flush(dim)
            for tile in (t for ts in tiles.values() for t in ts):
                for at in range(0, len(tile.ids), BLOCK_QUERIES):
                    micros, found = tile.micros[at : at + BLOCK_QUERIES], tile.found[at : at + BLOCK_QUERIES]
                    query, place = np.nonzero(micros > np.iinfo(np.int64).min)
                    if len(query):
                        columns = [pa.array(tile.ids[at + query].tolist(), query_kind), pa.array(found[query, place].tolist(), id_kind), pa.array(micros[query, place] / 10**PLACES)]
                        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])

        def flush(dim):
            ids, mat = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
            for tile in tiles.get(dim, []):
                for at in range(0, len(ids), BLOCK_ROWS):
                    tile.see(ids[at : at + BLOCK_ROWS], mat[at : at + BLOCK_ROWS])

        for batch in batches:
            parts, sides, vec = batch.column("part").to_numpy(), batch.column("side").to_numpy(), batch.column("vec")
            edges = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (sides[1:] != sides[:-1]), True]) if len(parts) else []
            for a, z in zip(edges, edges[1:]):
                if parts[a] != part:
                    yield from finish()
                    part, tiles, waiting = parts[a], {}, {}
                piece = vec.slice(a, z - a)
                names = batch.column("id" if sides[a] else "query_id").slice(a, z - a).to_numpy(zero_copy_only=False)
                for dim in np.unique(np.diff(piece.offsets.to_numpy())).tolist():
                    rows, mat = _unit(piece, dim) if dim else ([], None)
                    if not len(rows):
                        continue
                    if sides[a]:
                        waiting.setdefault(dim, []).append((names[rows], mat))
                        if sum(len(x) for x, _ in waiting[dim]) >= BLOCK_ROWS:
                            flush(dim)
                    else:
                        tiles.setdefault(dim, []).append(_Tile(names[rows], mat, k))
        yield from finish()

    return run


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", tile_bytes: int = TILE_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, id, score, rank): the k chunks of highest cosine for each query (query_id, query_vec), rounded to PLACES,
    ties by id. Vectors that are null, zero, hold nulls or have another length than the query's have no cosine.

    Queries are dealt to tiles and chunks to groups, by hash, both of bounded bytes; each tile meets each group in one
    partition, where the queries come first and the chunks pass by as a stream. Nothing is collected or broadcast, however
    many queries there are, and of each partition only the k best of its queries are shuffled on."""
    fit = lambda v: F.col(v).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull())
    asked = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("vec")).where(F.col("query_id").isNotNull() & fit("vec"))
    rows = chunks.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & fit("vec"))
    facts = [d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("numbers")).first() for d in (asked, rows)]  # two rows of counts
    tiles = max(1, -(-facts[0]["numbers"] * 8 // tile_bytes))
    busy = -(-int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")) // tiles)
    groups = max(1, -(-facts[1]["numbers"] * 8 // group_bytes), min(busy, -(-facts[1]["n"] // LEAST_ROWS)))
    tile, group = F.pmod(F.xxhash64("query_id", F.lit("tile")), F.lit(tiles)), F.pmod(F.xxhash64("id", F.lit("group")), F.lit(groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    null = lambda d, c: F.lit(None).cast(d.schema[c].dataType).alias(c)
    left = asked.select("query_id", null(rows, "id"), "vec", F.lit(0).alias("side"), tile.alias("tile"), every(groups).alias("group"))
    right = rows.select(null(asked, "query_id"), "id", "vec", F.lit(1).alias("side"), group.alias("group"), every(tiles).alias("tile"))
    dealt = left.unionByName(right).select("query_id", "id", "vec", "side", (F.col("tile") * groups + F.col("group")).cast("int").alias("part"))
    dealt = dealt.repartitionById(tiles * groups, "part").sortWithinPartitions("part", "side")
    kinds = [asked.schema["query_id"].dataType, rows.schema["id"].dataType]
    scored = dealt.mapInArrow(_search(k, *map(to_arrow_type, kinds)), f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double")
    return ranked(scored, "query_id", k)


def ranked(scored: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """Adds rank by score, ties by id. Spark cuts groups to k before the shuffle when k is given."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("id"))
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def corpus_size(chunks: DataFrame, content: str = "content") -> DataFrame:
    """One row: n chunks and their average length (1 where there are none)."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(tokens(F.col(content)))), F.lit(1.0)).alias("avgdl"))


def bm25(chunks: DataFrame, queries: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """(query_id, id, score > 0) for queries (query_id, query_text). A term counts as often as the query has it.

    Only the queries' terms are counted in the chunks: the stated queries are joined to the term rows on the term."""
    asked = queries.select("query_id", F.explode(tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    words = chunks.select(F.col(id_col).alias("id"), tokens(F.col(content)).alias("words"))
    rows = words.select("id", F.size("words").alias("dl"), F.explode("words").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = rows.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = corpus_size(chunks, content)  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df, "term").join(F.broadcast(size), F.lit(True)).select("id", "term", (idf * weight).alias("part"))
    return scored.join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("qtf") * F.col("part")), PLACES).alias("score")).where("score > 0")


def keyword_depth(k: int) -> int:
    """How deep a keyword leg must be ranked for the k best of a fusion: a document in no other list that stands deeper
    scores less than the k-th keyword hit, even when rounded."""
    least = (RRF + 1) / 2 / (RRF + k) - 1e-4
    return math.ceil((RRF + 1) / 2 / least) - RRF if least > 0 else (1 << 31) - 1


def fuse(vector: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, retrieval_method, rank): reciprocal rank fusion of two ranked lists, scaled so that rank 1
    in both is 1."""
    v = vector.select("query_id", "id", F.col("rank").alias("v"))
    b = keyword.select("query_id", "id", F.col("rank").alias("b"))
    both = v.join(b, ["query_id", "id"], "full_outer")
    raw = F.coalesce(1 / (RRF + F.col("v")), F.lit(0.0)) + F.coalesce(1 / (RRF + F.col("b")), F.lit(0.0))
    method = F.concat(F.lit("hybrid_"), F.concat_ws("+", F.when(F.col("v").isNotNull(), "vector"), F.when(F.col("b").isNotNull(), "bm25")))
    scored = both.select("query_id", "id", F.round(F.least(F.round(raw, 9) / (2 / (RRF + 1)), F.lit(1.0)), 4).alias("score"), method.alias("retrieval_method"))
    return ranked(scored, "query_id", k)


def expand(fused: DataFrame, chunks: DataFrame, edges: DataFrame, k: int, id_col: str = "id", file_col: str = "filepath") -> DataFrame:
    """The fused results with chunks of neighbouring modules appended: of each result's module, in order, those it
    leads to, then those that lead to it; each new chunk once, at 0.8 of the result's score, half of k at most (one at
    least)."""
    where = chunks.select(F.col(id_col).alias("id"), module_lenient(F.col(file_col)).alias("module"))
    both = edges.select(F.col("src").alias("module"), F.col("dst").alias("near"), F.lit(0).alias("side")).unionByName(edges.select(F.col("dst").alias("module"), F.col("src").alias("near"), F.lit(1).alias("side"))).distinct()
    steps = fused.join(where, "id").join(both, "module").select("query_id", F.col("rank").alias("parent"), F.col("score").alias("from_score"), "side", "near")
    half = max(1, k // 2)
    # of a module no more than its first chunks can be appended: k at most are results, and `half` are enough
    least = Window.partitionBy("module").orderBy("id")
    first_ids = where.withColumn("nth", F.dense_rank().over(least)).where(F.col("nth") <= k + half).select("id", F.col("module").alias("near")).distinct()
    found = steps.join(first_ids, "near").join(fused.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = Window.partitionBy("query_id", "id").orderBy("parent", "side", "near")
    order = Window.partitionBy("query_id").orderBy("parent", "side", "near", "id")
    fresh = found.withColumn("nth", F.row_number().over(first)).where("nth = 1").withColumn("place", F.row_number().over(order)).where(F.col("place") <= half)
    added = fresh.select("query_id", "id", F.round(F.col("from_score") * 0.8, 4).alias("score"), F.lit("graph_expansion").alias("retrieval_method"), (F.col("place") + k).alias("rank"))
    return fused.unionByName(added.select(*fused.columns))


def hybrid(chunks: DataFrame, queries: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Results for queries (query_id, query_text, query_vec). The vector leg is three times as deep as k. Of the keyword
    leg the best keyword_depth(k) count, and the vector hits, with their ranks among all scored documents. Blank queries have none."""
    asked = queries.where(F.size(tokens(F.col("query_text"))) > 0)
    near = cut(vector_topk(chunks, asked, 3 * k))
    fused = fuse(near, keyword_scan.ranks_of(chunks, asked, near, keyword_depth(k)), k)
    out = expand(fused, chunks, edges, k)
    return out.join(chunks.select("id", F.col("filepath").alias("source_file"), "content"), "id")
