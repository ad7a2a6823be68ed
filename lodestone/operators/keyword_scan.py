"""Keyword ranks by a scan: every document is scored for every query where it stands, and no pair of them is shuffled.

An index (keyword.py) pays where floors leave few pairs. Ranks of documents far down leave nearly all, each with all its
shared terms. Here queries are dealt to tiles and documents to groups, both of bounded bytes, as vectors are; a task keeps
a tile's queries, reads a group's documents as a stream, in order of their ids, and sends on each query's best and how
many documents stand before each one that is asked for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.lineage import cut
from lodestone.functions.text import tokens
from lodestone.operators.keyword import B, K1, PLACES, asked_terms

TILE_BYTES, GROUP_BYTES, LEAST_ROWS = 16 << 20, 64 << 20, 2048
CELLS, BLOCK_ROWS, BLOCK_BYTES = 1 << 22, 4096, 16 << 20
FEW_IDS = 100_000  # so many are broadcast; they are counted first


class _Tile:
    """A tile's queries: for each word the queries that have it and its weight there, and the documents asked for."""

    def __init__(self, rows, norm: float, k: int) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        column = lambda c: pa.concat_arrays([r.column(c) for r in rows])
        self.ids, self.norm, self.k, terms, few = column("query_id"), norm, k, column("terms"), column("few")
        flat, n = terms.flatten(), len(self.ids)
        self.words = flat.unique()
        self.words = self.words.take(pc.sort_indices(self.words))  # one order of a query's words, in whichever tile it is
        code, owner = pc.index_in(flat, self.words).to_numpy(), np.repeat(np.arange(n), np.diff(terms.offsets.to_numpy()))
        order = np.lexsort((owner, code))
        self.owner, self.weight = owner[order], column("weights").flatten().to_numpy()[order]
        self.starts = np.searchsorted(code[order], np.arange(len(self.words) + 1))
        sizes = np.diff(few.offsets.to_numpy())
        named = few.flatten()
        self.named, self.named_micros = named.field("id"), named.field("micros").to_numpy(zero_copy_only=False)
        self.asker, self.nth = np.repeat(np.arange(n), sizes), np.concatenate([np.arange(s) for s in sizes]) if n else np.zeros(0, np.int64)
        self.ahead, self.low = np.zeros(len(self.named), np.int64), np.ones(n, np.int64)

    def scores(self, ids, texts) -> tuple:
        """The documents of a block, which comes by id, and the queries' scores of them in units of the last place.
        Rows of one id and length are one document, those of one id share a score."""
        import pyarrow.compute as pc

        lists = pc.split_pattern(texts, " ")
        code = pc.index_in(lists.flatten(), self.words).fill_null(-1).to_numpy()
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        row, new_doc = np.repeat(np.arange(len(texts)), lengths), np.r_[True, ~same_ids(ids)]
        both, group = np.unique((np.cumsum(new_doc) - 1) << 32 | lengths, return_inverse=True)
        doc, groups = both >> 32, len(both)
        norm = K1 * (1 - B + B * (both & 0xFFFFFFFF) / self.norm)
        known = code >= 0
        key, tf = np.unique(code[known].astype(np.int64) * groups + group[row[known]], return_counts=True)
        word, at = key // groups, key % groups
        part, at = tf * (K1 + 1) / (tf + norm[at]), doc[at]
        out = np.zeros((len(self.ids), int(new_doc.sum())))
        edges = np.flatnonzero(np.r_[True, word[1:] != word[:-1], True]) if len(word) else []
        for a, z in zip(edges, edges[1:]):
            lo, hi = self.starts[word[a]], self.starts[word[a] + 1]
            cells, more = (self.owner[lo:hi, None], at[None, a:z]), self.weight[lo:hi, None] * part[None, a:z]
            if groups == out.shape[1]:
                out[cells] += more
            else:
                np.add.at(out, cells, more)  # an id may come with two lengths
        return ids.filter(_mask(new_doc)), np.floor(out * 10**PLACES + 0.5).astype(np.int64)

    def places(self, ids) -> tuple[np.ndarray, np.ndarray]:
        """How many of a block's documents have smaller ids than each that is asked for, and whether it is among them."""
        nulls = ids.null_count  # they come first
        have, want = ids.slice(nulls).to_numpy(zero_copy_only=False), self.named.to_numpy(zero_copy_only=False)
        place = np.searchsorted(have, want) if len(want) else np.zeros(0, np.int64)
        here = np.zeros(len(want), bool)
        inside = place < len(have)
        here[inside] = have[place[inside]] == want[inside]
        return place + nulls, here

    def find(self, ids, micros: np.ndarray) -> tuple:
        """(query, document, score) of those asked for that are in the block."""
        place, here = self.places(ids)
        at = np.flatnonzero(here)
        at = at[micros[self.asker[at], place[at]] > 0]
        return self.asker[at], place[at], micros[self.asker[at], place[at]]

    def see(self, ids, micros: np.ndarray) -> tuple:
        """(query, document, score) of a block that may be among the k best, and counts who stands before those asked for."""
        n = micros.shape[1]
        key = np.arange(n) - micros * n  # least is best: the highest score, of equal ones the smallest id
        if len(self.named):
            before = self.places(ids)[0] - self.named_micros * n
            for nth in range(int(self.nth.max()) + 1):
                at = np.flatnonzero(self.nth == nth)
                self.ahead[at] += np.count_nonzero(key[self.asker[at]] < before[at, None], axis=1)
        if self.k < n:
            best = np.argpartition(key, self.k - 1, axis=1)[:, : self.k]
            found = np.take_along_axis(micros, best, axis=1)
            query, place = np.nonzero(found >= self.low[:, None])
            hits = query, best[query, place], found[query, place]
            self.low = np.maximum(self.low, found.min(axis=1))  # k documents reach it
            return hits
        query, place = np.nonzero(micros >= self.low[:, None])
        return query, place, micros[query, place]


def _mask(x: np.ndarray):
    import pyarrow as pa

    return pa.array(x)


def same_ids(ids) -> np.ndarray:
    """Whether each id but the first is the one before it; nulls are alike."""
    import pyarrow.compute as pc

    a, b = ids.slice(1), ids.slice(0, max(0, len(ids) - 1))
    return pc.or_(pc.equal(a, b).fill_null(False), pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def _scan(k: int, norm: float, find: bool, query_kind, id_kind, cells: int):
    """mapInArrow function over dealt rows, by part, side and id: with `find` the scores of documents that are asked
    for, else the best ones of each query, and how many stand before each that is asked for."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["query_id", "id", "micros", "ahead"]

    def rows(query, ids, micros, ahead):
        for at in range(0, len(query), BLOCK_ROWS * 4):
            cut_ = slice(at, at + BLOCK_ROWS * 4)
            yield pa.RecordBatch.from_arrays([query[cut_].cast(query_kind), ids[cut_].cast(id_kind), micros[cut_], ahead[cut_]], names=names)

    def run(batches):
        part, asked, tile, waiting = None, [], None, []

        def flush(last):
            """Scores what waits but, before the end, for the last id's rows, which may go on."""
            nonlocal waiting, tile
            if tile is None and asked:
                tile = _Tile(asked, norm, k)
            if not waiting or tile is None:
                waiting = []
                return
            ids, texts = (pa.concat_arrays([w.column(c) for w in waiting]) for c in ("id", "text"))
            end = len(ids)
            if not last:
                changes = np.flatnonzero(~same_ids(ids))
                end = int(changes[-1]) + 1 if len(changes) else 0
            waiting = [pa.RecordBatch.from_arrays([x.slice(end) for x in (ids, texts)], names=["id", "text"])] if end < len(ids) else []
            ids, texts = ids.slice(0, end), texts.slice(0, end)
            starts = np.flatnonzero(np.r_[True, ~same_ids(ids), True]) if end else np.zeros(1, int)
            step = max(1, min(BLOCK_ROWS, cells // max(1, len(tile.ids))))
            for at in range(0, len(starts) - 1, step):
                lo, hi = int(starts[at]), int(starts[min(at + step, len(starts) - 1)])
                docs, micros = tile.scores(ids.slice(lo, hi - lo), texts.slice(lo, hi - lo))
                query, place, found = (tile.find if find else tile.see)(docs, micros)
                yield from rows(tile.ids.take(pa.array(query)), docs.take(pa.array(place)), pa.array(found, pa.int64()), pa.nulls(len(query), pa.int64()))

        def finish():
            yield from flush(True)
            if tile is not None and not find:
                at = pa.array(np.flatnonzero(tile.ahead))
                yield from rows(tile.ids.take(pa.array(tile.asker)).take(at), tile.named.take(at), pa.nulls(len(at), pa.int64()), pa.array(tile.ahead).take(at))

        for batch in batches:
            parts, sides = batch.column("part").to_numpy(), batch.column("side").to_numpy()
            edges = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (sides[1:] != sides[:-1]), True]) if len(parts) else []
            for a, z in zip(edges, edges[1:]):
                if parts[a] != part:
                    yield from finish()
                    part, asked, tile, waiting = parts[a], [], None, []
                if not sides[a]:
                    asked.append(batch.slice(a, z - a))
                    continue
                for at in range(a, z, BLOCK_ROWS):
                    waiting.append(batch.slice(at, min(BLOCK_ROWS, z - at)).select(["id", "text"]))
                    if sum(map(len, waiting)) >= BLOCK_ROWS or sum(pc.sum(pc.binary_length(w.column("text"))).as_py() or 0 for w in waiting) >= BLOCK_BYTES:
                        yield from flush(False)
        yield from finish()

    return run


def _dealt(asked: DataFrame, docs: DataFrame, tiles: int, groups: int) -> DataFrame:
    """Each tile of queries next to each group of documents, in a partition of their own."""
    tile, group = F.pmod(F.xxhash64("query_id", F.lit("tile")), F.lit(tiles)), F.pmod(F.xxhash64("id", F.lit("group")), F.lit(groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    null = lambda d, c: F.lit(None).cast(d.schema[c].dataType).alias(c)
    left = asked.select("query_id", "terms", "weights", "few", null(docs, "id"), null(docs, "text"), F.lit(0).alias("side"), tile.alias("tile"), every(groups).alias("group"))
    right = docs.select(*[null(asked, c) for c in ("query_id", "terms", "weights", "few")], "id", "text", F.lit(1).alias("side"), group.alias("group"), every(tiles).alias("tile"))
    dealt = left.unionByName(right).withColumn("part", (F.col("tile") * groups + F.col("group")).cast("int")).drop("tile", "group")
    return dealt.repartitionById(tiles * groups, "part").sortWithinPartitions("part", "side", "id")


def ranks_of(chunks: DataFrame, queries: DataFrame, also: DataFrame, k: int, id_col: str = "id", content: str = "content", tile_bytes: int = TILE_BYTES, group_bytes: int = GROUP_BYTES, cells: int = CELLS) -> DataFrame:
    """(query_id, id, score, rank) of the k best documents of each query (query_id, query_text) and of those named by `also`
    (query_id, id) that have a score, with their ranks among all documents: what scoring and sorting all of them would give,
    ties by id. Rows of one id and length count as one document."""
    raw = chunks.select(F.col(id_col).alias("id"), F.col(content).cast("string").alias("content"))
    docs = lambda rows: rows.select("id", F.array_join(tokens(F.col("content")), " ").alias("text"))
    asked = cut(asked_terms(queries))
    # in how many documents a word is, counted before the join with the queries' words, so that none but counts are
    # shuffled; the row without a word counts documents, words and bytes
    words = raw.select("id", "content", tokens(F.col("content")).alias("words"))
    each = words.select("id", F.size("words").alias("dl"), F.octet_length("content").alias("bytes"), F.explode(F.concat(F.coalesce(F.array_distinct("words"), F.array()), F.array(F.lit(None).cast("string")))).alias("term"))
    once = lambda c: F.sum(F.when(F.col("term").isNull(), F.col(c))).alias(c)
    wanted = asked.select("term").distinct().unionByName(asked.sparkSession.range(1).select(F.lit(None).cast("string").alias("term"))).withColumnRenamed("term", "wanted")
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count(F.when(F.col("term").isNull(), F.col("dl"))).alias("texts"), once("dl"), once("bytes"))
    counts = cut(counts.join(wanted, F.col("term").eqNullSafe(F.col("wanted")), "left_semi"))
    facts = counts.where("term IS NULL").first()  # one row, none where there are no documents
    n, size = (facts["df"], facts["bytes"] or 0) if facts else (0, 0)
    avgdl = facts["dl"] / facts["texts"] if facts and facts["dl"] else 1.0
    df = counts.where("term IS NOT NULL").select("term", "df")
    twice = cut(raw.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("id").alias("one")))
    if not twice.isEmpty():  # rows of one id and length were counted as several documents
        again = each.where("term IS NOT NULL").join(twice, F.col("id").eqNullSafe(F.col("one")), "left_semi").groupBy("id", "dl", "term").agg((1 - F.count(F.lit(1))).alias("df"))
        df = df.unionByName(again.select("term", "df").join(asked.select("term").distinct(), "term", "left_semi")).groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    terms = asked.join(df, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("qtf") * idf).alias("weight"))).alias("terms"))
    terms = cut(terms.select("query_id", F.col("terms.term").alias("terms"), F.col("terms.weight").alias("weights")))
    held = terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()["terms"] * 40
    tiles = max(1, -(-held // tile_bytes))
    busy = -(-int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")) // tiles)
    groups = lambda rows, bytes_: max(1, -(-bytes_ // group_bytes), min(busy, -(-rows // LEAST_ROWS)))
    query_kind, id_kind = asked.schema["query_id"].dataType, raw.schema["id"].dataType

    def scan(named, rows, groups, find):
        """`named` (query_id, id, micros) go with their queries."""
        few = named.groupBy("query_id").agg(F.collect_list(F.struct(F.col("id").cast(id_kind).alias("id"), "micros")).alias("few"))  # as many as `also` names
        few = terms.join(few, "query_id", "left").withColumn("few", F.coalesce("few", F.array().cast(few.schema["few"].dataType)))
        run = _scan(k, avgdl, find, to_arrow_type(query_kind), to_arrow_type(id_kind), cells)
        return _dealt(few, rows, tiles, groups).mapInArrow(run, f"query_id {query_kind.simpleString()}, id {id_kind.simpleString()}, micros long, ahead long")

    named = cut(also.select("query_id", "id").where("query_id IS NOT NULL AND id IS NOT NULL").distinct())
    ids = cut(named.select(F.col("id").alias("one")).distinct())
    few_ids = ids.count()
    theirs = docs(raw.join(F.broadcast(ids) if few_ids <= FEW_IDS else ids, F.col("id") == F.col("one"), "left_semi"))
    found = cut(scan(named.withColumn("micros", F.lit(0).cast("long")), theirs, groups(few_ids, few_ids * size // max(1, n)), True).drop("ahead"))
    seen = cut(scan(found, docs(raw), groups(n, size), False))
    score = (F.col("micros") / 10**PLACES).alias("score")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    top = seen.where("ahead IS NULL").select("query_id", "id", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ahead = seen.where("ahead IS NOT NULL").groupBy("query_id", "id").agg(F.sum("ahead").alias("ahead"))
    placed = found.join(ahead, ["query_id", "id"], "left").select("query_id", "id", score, (F.coalesce("ahead", F.lit(0)) + 1).cast("int").alias("rank"))
    return top.unionByName(placed.join(top.select("query_id", "id"), ["query_id", "id"], "left_anti"))
