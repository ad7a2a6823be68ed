"""What the operators share: tables in the cluster's shared folder, rows dealt to queries, top-list merging."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_open: list["Scratch"] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (single-machine tests). A cluster must
    set one, as its machines share no temporary folder."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if "at" not in _own:
        _own["at"] = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, _own["at"], ignore_errors=True)
    return f"file://{_own['at']}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/lodestone/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    if _open:
        _open[-1].paths[path] = df.sparkSession
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df._settled_at)
        for scratch in _open:
            scratch.paths.pop(df._settled_at, None)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sliced(batches, rows: int = 512):
    """Arrow batches of few rows, so that what Python makes of one stays small where texts are long."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


BITS_A_KEY, MOST_BITS, BUCKET = 16, 1 << 27, 1 << 15


def perhaps(rows: DataFrame, key: list[Column], keys: DataFrame, of: list[Column], flag: str) -> DataFrame:
    """`rows` with a column `flag`: false where `key` is surely not among the keys `of` in the table `keys`, true where it
    is or (1 row in 16 while bits suffice) its bit is set by another. An exact join of the true ones follows, so that rows
    with long texts need not be shuffled to learn that nothing matches them. The bits are broadcast, 16 MB at most."""
    bits = min(MOST_BITS, max(BUCKET, 1 << (keys.count() * BITS_A_KEY - 1).bit_length()))
    slot = lambda columns: F.pmod(F.xxhash64(F.lit("perhaps"), *columns), F.lit(bits))
    held, bucket, place = f"{flag}_bits", f"{flag}_bucket", f"{flag}_place"
    sets = keys.select(slot(of).alias("slot")).select(F.floor(F.col("slot") / BUCKET).alias(bucket), (F.col("slot") % BUCKET).alias("place"))
    sets = sets.groupBy(bucket).agg(F.bitmap_construct_agg("place").alias(held))
    at = rows.withColumn(place, slot(key))
    found = at.join(F.broadcast(sets), F.floor(F.col(place) / BUCKET) == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(F.col(place) % BUCKET / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.expr(f"shiftright(256, 8 - cast(`{place}` % 8 as int))").bitwiseAND(byte) != 0
    return found.withColumn(flag, F.coalesce(is_set, F.lit(False))).drop(held, bucket, place)


class Scratch:
    """Context in which settled tables are scratch: they are deleted at its end, but for those that `keep` names."""

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.pop(df._settled_at, None)
        return df

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, *_) -> None:
        _open.remove(self)
        for path, spark in self.paths.items():
            _delete(spark, path)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, vec array<double>) of the rows whose id is known and whose vector is not null, empty, or holding null or non-finite parts."""
    big = 1.7976931348623157e308
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        .where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
        .where(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) <= big)))
    )


DEALT = "kind int, id long, vec array<double>"
TILE_BYTES, GROUP_BYTES, LEAST_ROWS = 16 << 20, 256 << 20, 4096


def deal(rows: DataFrame, queries: DataFrame, tile_bytes: int = TILE_BYTES, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int, int]:
    """Every row of `rows` next to every row of `queries` (both id, vec), one tile of queries and one group of rows in
    a partition: queries (kind 0) come first, then rows (kind 1), which a task reads as a stream. Tiles are of bounded
    bytes, as a task keeps one; so are groups, and each query goes to as many partitions as there are groups, each row
    to as many as there are tiles. Both are chosen by hashes, so a task that runs again gets the same.

    Returns the dealt rows, the number of partitions and that of groups."""
    facts = [df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("parts")).first() for df in (rows, queries)]
    tiles = max(1, math.ceil(facts[1]["parts"] * 8 / tile_bytes))
    busy = math.ceil(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) / tiles)
    groups = max(1, math.ceil(facts[0]["parts"] * 8 / group_bytes), min(busy, math.ceil(facts[0]["n"] / LEAST_ROWS)))
    tile, group = F.pmod(F.xxhash64("id", F.lit("tile")), F.lit(tiles)), F.pmod(F.xxhash64("id", "vec"), F.lit(groups))
    asked = queries.select(F.lit(0).alias("kind"), "id", "vec", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    held = rows.select(F.lit(1).alias("kind"), "id", "vec", group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    dealt = asked.unionByName(held).select("kind", "id", "vec", (F.col("tile") * groups + F.col("group")).cast("int").alias("part"))
    return dealt.repartitionById(tiles * groups, "part").sortWithinPartitions("kind").select("kind", "id", "vec"), tiles * groups, groups


class Best:
    """The k best (neg, id) pairs of each of n queries so far, least first."""

    def __init__(self, n: int, k: int, kind) -> None:
        self.k, self.size = k, np.zeros(n, np.int32)
        self.neg, self.ids = np.zeros((n, k), kind), np.zeros((n, k), np.int64)

    def last(self, i: int):
        """The worst value that still counts, None while there is room."""
        return self.neg[i, self.k - 1] if self.size[i] == self.k else None

    def offer(self, i: int, neg: np.ndarray, ids: np.ndarray) -> None:
        n = self.size[i]
        neg, ids = np.concatenate([self.neg[i, :n], neg]), np.concatenate([self.ids[i, :n], ids])
        order = np.lexsort((ids, neg))[: self.k]
        self.size[i] = n = len(order)
        self.neg[i, :n], self.ids[i, :n] = neg[order], ids[order]


def searcher(k: int, kind, block_rows: int, prepare, search):
    """mapInArrow function over one partition of `deal`: keeps the queries, by dimension, and hands rows over in blocks.

    prepare(mat) makes of a dimension's queries what search(state, q_ids, q, ids, mat, best) needs to offer hits of a
    block to `best`. Yields query_id, src and the sorted list best of (neg, vec_id) once, at the end."""
    import pyarrow as pa
    from pyspark import TaskContext

    out = pa.list_(pa.struct([("neg", pa.from_numpy_dtype(kind)), ("vec_id", pa.int64())]))

    def run(batches):
        parts: dict[int, dict[int, list]] = {0: {}, 1: {}}
        ready: dict[int, tuple] = {}
        waiting: dict[int, int] = {}

        def block(dim):
            ids, mat = (np.concatenate(x) for x in zip(*parts[1].pop(dim)))
            waiting[dim] = 0
            if dim not in ready and dim in parts[0]:
                q_ids, q = (np.concatenate(x) for x in zip(*parts[0].pop(dim)))
                ready[dim] = prepare(q), q_ids, q, Best(len(q), k, kind)
            if dim in ready:
                state, q_ids, q, best = ready[dim]
                for at in range(0, len(ids), block_rows):
                    order = at + np.argsort(ids[at : at + block_rows], kind="stable")
                    search(state, q_ids, q, ids[order], mat[order], best)

        for batch in batches:
            if not batch.num_rows:
                continue
            what, ids, vec = batch.column("kind").to_numpy(), batch.column("id").to_numpy(), batch.column("vec")
            ends, flat = vec.offsets.to_numpy(), vec.values.to_numpy(zero_copy_only=False)
            dims = np.diff(ends)
            for one in (0, 1):
                for dim in np.unique(dims[what == one]).tolist():
                    of = np.flatnonzero((dims == dim) & (what == one))
                    parts[one].setdefault(dim, []).append((ids[of], flat[ends[of][:, None] + np.arange(dim)]))
                    if one:
                        waiting[dim] = waiting.get(dim, 0) + len(of)
                        if waiting[dim] >= block_rows:
                            block(dim)
        for dim in list(parts[1]):
            block(dim)
        src = TaskContext.get().partitionId()
        for _, q_ids, _, best in ready.values():
            for at in range(0, len(q_ids), 1024):
                mine = [i for i in range(at, min(at + 1024, len(q_ids))) if best.size[i]]
                lists = [[{"neg": a, "vec_id": b} for a, b in zip(best.neg[i, : best.size[i]].tolist(), best.ids[i, : best.size[i]].tolist())] for i in mine]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[mine], pa.int64()), pa.array([src] * len(mine), pa.int32()), pa.array(lists, out)], names=["query_id", "src", "best"])

    return run


def merge_tree(partial: DataFrame, k: int, parts: int, fan_in: int = 16) -> DataFrame:
    """Merges per-query sorted lists (query_id, src, best array<struct>) level by level, at most fan_in lists at a time on average."""
    levels = max(1, math.ceil(math.log(max(parts, 2)) / math.log(fan_in)))
    for level in range(levels):
        src = F.lit(0) if level == levels - 1 else F.floor(F.col("src") / F.lit(fan_in)).cast("int")
        partial = partial.groupBy("query_id", src.alias("src")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return partial
