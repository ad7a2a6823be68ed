"""Near-duplicates by SimHash: BK-trees over shards of fingerprints.

Two fingerprints that differ in at most 3 of 64 bits agree on one of 4 bit blocks, so shards keyed by a block and its
value hold every link. A shard beyond `split` members is dealt again by the blocks of its remaining bits, level by
level; at the last level a shard has at most 2**15 members, as only 15 bits are open. Each shard goes to one task,
which keeps a BK-tree (children keyed by their integer distance to the parent) and follows only edges within the
radius. A member leaves its tree when reached, so a shard of m members yields at most m - 1 links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import forget, perhaps, settle

RADIUS, SPLIT, BITS, WORDS = 3, 1024, 64, 3
_NO_ID = 2**63 - 1


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a whole text over its word shingles, as an unsigned integer; 0 for a text without words."""
    import xxhash

    if not text:
        return 0
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return 0
    line, digest = b" ".join(parts), xxhash.xxh64_digest
    if n <= words:
        h = digest(line, 42)
        return int.from_bytes(h, "big")
    sizes = np.fromiter(map(len, parts), np.int64, n)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = (starts + sizes)[words - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n - words + 1, 1 << 16):
        a, b = starts[at : min(at + (1 << 16), n - words + 1)].tolist(), ends[at : at + (1 << 16)].tolist()
        raw = b"".join([digest(line[x:y], 42) for x, y in zip(a, b)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n - words + 1).tobytes(), "big")


def text_key(text) -> list:
    """128 bits that tell rows of one doc_id apart."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")]


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, the text's key (h1, h2) and fp (the fingerprint as a signed long) of every document."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h1"), batch.column("h2"), pa.array(fps, pa.int64())], names=["doc_id", "h1", "h2", "fp"])

    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long"), *text_key(text), text.alias("text")).mapInArrow(run, "doc_id long, h1 long, h2 long, fp long")


def masks_below(mask: int) -> list[int]:
    """The 4 masks that add one block of a mask's open bits each."""
    open_bits = [b for b in range(BITS) if not mask >> b & 1]
    n, out, at = len(open_bits), [], 0
    for i in range(RADIUS + 1):
        size = n // (RADIUS + 1) + (i < n % (RADIUS + 1))
        out.append(mask | sum(1 << b for b in open_bits[at : at + size]))
        at += size
    return out


class BKTree:
    """Fingerprints by integer Hamming distance to their parent; `live` counts what a subtree still holds."""

    def __init__(self, items: list[int]) -> None:
        self.items, n = items, len(items)
        self.children: list[dict[int, int]] = [{} for _ in range(n)]
        self.parent, self.live, self.here = [-1] * n, [1] * n, [True] * n
        for i in range(1, n):
            at, x = 0, items[i]
            while True:
                self.live[at] += 1
                d = (x ^ items[at]).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = i
                    self.parent[i] = at
                    break
                at = below

    def remove(self, i: int) -> None:
        self.here[i] = False
        while i >= 0:
            self.live[i] -= 1
            i = self.parent[i]

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [0]
        items, children, live, here = self.items, self.children, self.live, self.here
        while todo:
            at = todo.pop()
            d = (x ^ items[at]).bit_count()
            if d <= radius and here[at]:
                found.append(at)
            for e, below in children[at].items():
                if live[below] and d - radius <= e <= d + radius:
                    todo.append(below)
        return found


def shard_links(items: list[int], order: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, its component's first member by `order`) of every component of two or more in a shard."""
    tree, links = BKTree(items), []
    for start in sorted(range(len(items)), key=order.__getitem__):
        if not tree.here[start]:
            continue
        tree.remove(start)
        todo = [start]
        while todo:
            for i in tree.within(items[todo.pop()], radius):
                tree.remove(i)
                todo.append(i)
                links.append((i, start))
    return links


def _shard_runner():
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ends, flat = batch.column("members").offsets.to_pylist(), batch.column("members").values
            fp, rep = flat.field("fp").to_pylist(), flat.field("rep").to_pylist()
            a, b = [], []
            for lo, hi in zip(ends, ends[1:]):
                own, ids = [x & 0xFFFFFFFFFFFFFFFF for x in fp[lo:hi]], list(zip(rep[lo:hi], fp[lo:hi]))
                if hi - lo == 2 and (own[0] ^ own[1]).bit_count() > RADIUS:
                    continue
                for i, j in shard_links(own, ids):
                    a.append(fp[lo + i])
                    b.append(fp[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(groups: DataFrame, split: int = SPLIT) -> DataFrame:
    """Links (a, b) that keep the components of all fingerprints in `groups` (fp, rep) under distance <= 3."""
    found, todo, level_masks = [], groups, {0: 0}
    for level in range(5):
        below = {p * 4 + i: m for p, mask in level_masks.items() for i, m in enumerate(masks_below(mask))}
        if level == 0:
            children = F.array(*[F.lit(i) for i in below])
        else:
            children = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("mask_no") * 4 + i)
        table = F.create_map(*[F.lit(x) for i, m in below.items() for x in (i, m - (1 << 64) if m >> 63 else m)])
        keyed = todo.select("fp", "rep", F.explode(children).alias("mask_no")).withColumn("part", F.col("fp").bitwiseAND(table[F.col("mask_no")]))
        last = level == 4
        if last:
            small = keyed
        else:
            hot = settle(keyed.groupBy("mask_no", "part").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > split).drop("size"), f"simhash-hot{level}")
            last = hot.isEmpty()
            small = keyed if last else keyed.join(hot, ["mask_no", "part"], "left_anti")
        shards = small.groupBy("mask_no", "part").agg(F.collect_list(F.struct("fp", "rep")).alias("members")).where(F.size("members") > 1)
        found.append(shards.select("members").mapInArrow(_shard_runner(), "a long, b long"))
        if last:
            break
        todo, level_masks = settle(keyed.join(hot, ["mask_no", "part"], "left_semi").select("fp", "rep", "mask_no"), f"simhash-level{level}"), below
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, lab) for every node with a link: lab is the component's smallest (rep, fp). Least neighbour labels and
    pointer jumping by turns, each round a settled table, until nothing changes."""
    both = settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "simhash-edges")
    mine = F.struct("rep", "fp").alias("lab")
    labels = stored = settle(nodes.join(both.select(F.col("a").alias("fp")).distinct(), "fp").select("fp", mine), "simhash-labels")
    if labels.isEmpty():
        return labels
    while True:
        near = both.join(labels, F.col("a") == F.col("fp")).groupBy(F.col("b").alias("fp")).agg(F.min("lab").alias("near"))
        step = settle(labels.join(near, "fp", "left").select("fp", F.col("lab").alias("was"), F.least("lab", F.coalesce("near", "lab")).alias("lab")), "simhash-near")
        up = step.select(F.col("fp").alias("up"), F.col("lab").alias("up_lab"))
        jumped = step.join(up, F.col("lab.fp") == F.col("up"), "left").select("fp", "was", F.coalesce("up_lab", "lab").alias("lab"))
        after = settle(jumped, "simhash-jump")
        forget(step, stored)  # only the last round's labels are read again
        labels = stored = after
        if labels.where(F.col("was") != F.col("lab")).isEmpty():
            forget(both)
            return labels.drop("was")
        labels = labels.drop("was")


def grouped(documents: DataFrame, split: int = SPLIT) -> DataFrame:
    """doc_id, h1, h2, fp, least (the smallest doc_id of the component, or _NO_ID) and comp (which component) of every row."""
    fps = settle(fingerprints(documents), "simhash-fps")
    groups = settle(fps.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(_NO_ID)).alias("rep")), "simhash-groups")
    comps = components(groups, links(groups, split))
    named = groups.join(comps, "fp", "left").select(F.col("fp").alias("key"), F.coalesce("lab.rep", "rep").alias("least"), F.coalesce("lab.fp", "fp").alias("comp"))
    return fps.join(named, F.col("fp") == F.col("key"), "left").drop("key")


def near_duplicates(documents: DataFrame, split: int = SPLIT) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of `documents` (doc_id, text).

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest doc_id of all rows that links reach,
    the row's own included. Null, empty and blank texts have fingerprint zero and link like any other. A null doc_id
    stays null and never names a component (component_id is null where a component has no other). Repeated rows are
    returned as often as they come. An empty table gives no rows. Other columns are not read. Joins with the keys of
    large components are split by adaptive execution."""
    least = F.when(F.col("least") != _NO_ID, F.col("least"))
    return grouped(documents, split).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), least.alias("component_id"))


def keep_first(documents: DataFrame, split: int = SPLIT, rows: DataFrame | None = None) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (rows without one come last; of one
    id the smallest hash of the text). A row that comes more than once with one id and text stays once. `rows` (doc_id,
    h1, h2, comp) are components of another rule. The rows to drop are joined to the documents, not those to keep, and
    only to documents that may be among them: the texts of the others are never shuffled."""
    rows = settle((grouped(documents, split) if rows is None else rows).select("doc_id", "h1", "h2", "comp"), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2")
    several = rows.groupBy(F.col("comp").alias("of")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = rows.join(several, F.col("comp") == F.col("of")).groupBy(*[F.col(c).alias(f"kept_{c}") for c in ("doc_id", "h1", "h2")]).agg(F.any_value(order == F.col("first")).alias("is_first"), F.count(F.lit(1)).alias("n"))
    marked = settle(marked.where("NOT is_first OR n > 1"), "simhash-dropped")
    clash = "kept_"
    while any(c.lower().startswith(clash) for c in documents.columns):
        clash += "_"
    marked = marked.select(*[F.col(f"kept_{c}").alias(f"{clash}{c}") for c in ("doc_id", "h1", "h2")], "is_first")
    h1, h2 = text_key(F.col("text").cast("string"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{clash}doc_id")) & (h1 == F.col(f"{clash}h1")) & (h2 == F.col(f"{clash}h2"))
    flag = f"{clash}perhaps"
    key = lambda doc_id, h1, h2: [F.coalesce(doc_id, F.lit(_NO_ID)), h1, h2]
    known = perhaps(documents, key(F.col("doc_id").cast("long"), h1, h2), marked, key(*[F.col(f"{clash}{c}") for c in ("doc_id", "h1", "h2")]), flag)
    maybe = known.where(flag).drop(flag)
    out = known.where(~F.col(flag)).drop(flag).unionByName(maybe.join(marked, same, "left_anti"))
    repeated = marked.where("is_first").drop("is_first")
    return out if repeated.isEmpty() else out.unionByName(maybe.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
