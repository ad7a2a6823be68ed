"""Merkle manifest of a table: a tree of digests for each source, one of their subroots, and a path for every row.

A leaf is the digest of a row's fields; while several nodes of a tree remain, every FANOUT consecutive ones become the
digest of their digests. Positions in a tree follow from a range partitioning and counts of its parts. BLOCK = FANOUT **
LEVELS consecutive nodes from a multiple of BLOCK on make one row that holds their digests side by side: a numpy matrix
whose rows, FANOUT at a time, are hashed level by level. Blocks' tops are the nodes of the next table, so a tree of n
nodes takes log(n) / log(BLOCK) of them, and no task sees more of a tree than its blocks, however large the tree. Paths
come back the same way: a block's path goes to its nodes, whose siblings are found by their places in the matrices."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import forget, settle

FANOUT, LEVELS, WIDTH = 16, 2, 64  # WIDTH: characters of a digest
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as its length in bytes, a colon and itself, a null as a hyphen."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])


def hashed(level: np.ndarray) -> np.ndarray:
    """The next level of an (n, WIDTH) matrix of digests; the last run may be shorter."""
    whole = len(level) // FANOUT * FANOUT
    runs = [*level[:whole].reshape(-1, FANOUT * WIDTH), *([level[whole:].reshape(-1)] if whole < len(level) else [])]
    return np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in runs).encode(), np.uint8).reshape(-1, WIDTH)


def levels_of(raw, block: int) -> list[np.ndarray]:
    """Matrices of a block's levels, its nodes first, its top last. A tree's first block ends where one node remains: if
    there are others it is full, and that is after LEVELS levels; the others always have so many."""
    out = [np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)]
    while len(out) <= LEVELS and (block or len(out[-1]) > 1):
        out.append(hashed(out[-1]))
    return out


def _tops(batches):
    """Adds each block's top."""
    import pyarrow as pa

    for batch in batches:
        tops = [levels_of(raw.as_buffer(), block)[-1].tobytes().decode() for raw, block in zip(batch.column("raw"), batch.column("block").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], names=[*batch.schema.names, "top"])


def siblings(levels: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
    """For each node of a block, level after level, the digests left and right of it in its run."""
    left, right, nodes = [], [], np.arange(len(levels[0]))
    sides = []
    for depth, level in enumerate(levels[:-1]):
        own, raw = nodes // FANOUT**depth, level.tobytes()
        first = own - own % FANOUT
        last = np.minimum(first + FANOUT, len(level))
        sides.append([(raw[a * WIDTH : o * WIDTH], raw[(o + 1) * WIDTH : z * WIDTH]) for a, o, z in zip(first.tolist(), own.tolist(), last.tolist())])
    for node in zip(*sides):
        left += [x for x, _ in node]
        right += [x for _, x in node]
    return left, right


def _paths(batches):
    """A row for each node of a block: its own siblings within the block, then the block's path."""
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            nodes = one.column("nodes").flatten()
            n, block = len(nodes), one.column("block")[0].as_py()
            levels = levels_of(one.column("raw")[0].as_buffer(), block)
            left, right = siblings(levels)
            own, above = len(levels) - 1, one.column("path").flatten()
            k = len(above)
            inside = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
            steps = pa.concat_arrays([inside, above.cast(inside.type)])
            at = np.concatenate([np.arange(n * own).reshape(n, own), np.broadcast_to(n * own + np.arange(k), (n, k))], axis=1)
            path = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (own + k), pa.int32()), steps.take(pa.array(at.ravel(), pa.int64())))
            tree, top = (pa.array([one.column(c)[0].as_py()] * n, pa.string()) for c in ("tree", "subroot"))
            yield pa.RecordBatch.from_arrays([tree, pa.array(np.arange(n) + block * BLOCK, pa.int64()), nodes.field("item"), path, top], names=["tree", "at", "item", "path", "subroot"])


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds `at`, the place of each row within its tree in the order of the columns named, from 0. Rows are sorted over
    the cluster; a part's rows know their place in it, and the counts of earlier parts, one row for each tree in a part,
    do the rest."""
    part = F.shiftright("row", 33)
    rows = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("row", F.monotonically_increasing_id())
    rows = settle(rows, "merkle-order").withColumn("part", part)
    counts = rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("start"))
    return rows.join(starts, ["tree", "part"]).select(*nodes.columns, (F.col("row") + F.col("start")).alias("at"))


def grown(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of trees of `nodes` (tree, at, digest, item), then blocks of their tops, until each tree has one block."""
    out = []
    while True:
        item = nodes.schema["item"].dataType.simpleString()
        held = F.array_sort(F.collect_list(F.struct("at", "digest", "item")))
        blocks = nodes.groupBy("tree", F.floor(F.col("at") / BLOCK).alias("block")).agg(held.alias("nodes"))
        blocks = blocks.withColumn("raw", F.array_join(F.transform("nodes", lambda x: x["digest"]), ""))
        kind = f"tree string, block bigint, nodes array<struct<at:bigint,digest:string,item:{item}>>, raw string"
        blocks = settle(blocks.select("tree", "block", "nodes", "raw").mapInArrow(_tops, f"{kind}, top string"), "merkle-blocks")
        out.append(blocks)
        if blocks.where("block > 0").isEmpty():
            return out
        nodes = blocks.select("tree", F.col("block").alias("at"), F.col("top").alias("digest"), F.lit(0).alias("item"))


def descended(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, at, item, path, subroot) of every node, from (tree, path, subroot) of the trees' tops."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(levels):
        item = blocks.schema["nodes"].dataType.elementType["item"].dataType.simpleString()
        read = blocks.join(above, ["tree", "block"]).select("tree", "block", "nodes", "raw", "path", "subroot")
        nodes = read.mapInArrow(_paths, f"tree string, at bigint, item {item}, path {PATH}, subroot string")
        above = nodes.select("tree", F.col("at").alias("block"), "path", "subroot")
    return nodes


def manifest(rows: DataFrame, carry: list[str]) -> DataFrame:
    """The columns named by `carry` of each row of `rows` (source, doc_id, leaf and these), with subroot, root and path:
    the digests left and right of its own in each run from the leaf up to the root.

    Leaves of a source stand by doc_id (null first), equal ones by leaf; sources by their bytes, null, a source of its own,
    first. Repeated rows are leaves of their own next to each other. A table of one row has its leaf as root and an empty
    path; an empty table gives no rows."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null, then by bytes
    leaves = settle(rows.select(tree.alias("tree"), "doc_id", F.col("leaf").alias("digest"), F.struct(*carry).alias("item")), "merkle-leaves")
    trees = grown(placed(leaves, ["doc_id", "digest"]))
    tops = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"))
    over = grown(placed(tops, ["name"]).select("tree", "at", "digest", F.struct("name", "digest").alias("item")))
    top = over[-1].select("top").first()
    start = over[-1].select("tree", F.expr(f"cast(array() as {PATH})").alias("path"), F.lit(None).cast("string").alias("subroot"))
    of_trees = descended(over, start).select(F.col("item.name").alias("tree"), "path", F.col("item.digest").alias("subroot"))
    forget(leaves)
    return descended(trees, of_trees).select("item.*", "subroot", F.lit(top["top"] if top else None).cast("string").alias("root"), "path")


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, own, lambda acc, step: digest(step["left"], acc, step["right"]))


def proof(path: Column) -> Column:
    """Digest of all digests of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def verified_manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row: its path is folded from the leaf
    of the row as it is, or, for a fifth of the ids, with the text's A-Z in lower case, as if someone had changed it.

    Nulls in any field are leaves' hyphens; a null doc_id is never changed; an empty or very long text is hashed like
    any other; other columns are not read."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    rows = documents.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in FIELDS])
    lower = F.translate("text", A_TO_Z, A_TO_Z.lower())
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    own = leaf(*map(F.col, FIELDS))
    rows = rows.select("source", "doc_id", own.alias("leaf"), F.when(changed, leaf(*[lower if c == "text" else F.col(c) for c in FIELDS])).otherwise(own).alias("shown"))
    found = manifest(rows, ["doc_id", "leaf", "shown"])
    found = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("shown"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
