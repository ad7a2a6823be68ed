"""Near-duplicates by SimHash at a similarity of 0.8: five-word shingles, BK-trees, exact confirmation.

As in op2, fingerprints go to shards, each shard is searched by a BK-tree, and a member leaves its tree when reached, so
m members give at most m - 1 links. What differs is the reach: pairs of Jaccard similarity 0.8 differ in 10 of 64 bits on
average, and in RADIUS or more with probability 1e-6, a radius that leaves no blocks of equal bits to shard by. Shards
are therefore keyed by minhashes, 25 bands of 4: a pair at 0.8 shares none with probability 2e-6, and less above. Sets of
fewer than SMALL shingles, whose bits say little, are compared with all of their shard. Equal shingle sets are one member
throughout. Of a shard's members only those go on
whose sketch (a byte of each minhash) agrees with another's in NEAR of 100 places; a pair at 0.8 agrees in fewer with
probability 1e-8, chance meetings, which grow with the square of the corpus, hardly ever in as many. These are read again, and each pair that the tree finds is decided by
the exact similarity of their sets of 64-bit shingle hashes. A shard beyond `most` members or SHARD_BYTES is dealt to
groups by hash, and each two groups meet in a task of their own: a task's memory is bounded and no pair is lost, but the
work of a shard grows with the square of its different sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import perhaps, settle, sliced
from lodestone.llm.simhash import _NO_ID, BITS, BKTree, components, keep_first, text_key

WORDS, LEAST, BANDS, ROWS = 5, 0.8, 25, 4
RADIUS, SMALL, NEAR = 24, 50, 0.55
MOST, SHARD_BYTES = 2048, 16 << 20
_draw = np.random.default_rng(42)
_WORD = _draw.integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _draw.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(1, 1 << 63, BANDS * ROWS, np.uint64)
KEPT_WORDS = 200_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, kept: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word shingles (of all its words where they are fewer)."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(kept) > KEPT_WORDS:
        kept.clear()
    hashes = np.empty(len(parts), np.uint64)
    for i, p in enumerate(parts):
        h = kept.get(p)
        if h is None:
            h = xxhash.xxh64_intdigest(p, 42)
            if len(p) <= 48:
                kept[p] = h
        hashes[i] = h
    if len(parts) < WORDS:
        return _mixed(np.array([int(sum(int(h) * int(m) for h, m in zip(hashes, _WORD)) + len(parts)) & 0xFFFFFFFFFFFFFFFF], np.uint64))
    n = len(parts) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for j in range(WORDS):
        total += _mixed(hashes[j : j + n]) * _WORD[j]
    return np.unique(_mixed(total))


def set_hash(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), 7) if len(hashes) else 0


def minhashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024, None] * _TURN + _ADD
        least = np.minimum(least, _mixed(part).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band of minhashes, the same for both of a pair where the band's minhashes are."""
    bands = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = _mixed(key * _WORD[0] + bands[:, j])
    return key


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _prints(batches):
    import pyarrow as pa

    kept: dict[bytes, int] = {}
    for batch in sliced(batches):
        sets = [shingles(t, kept) for t in batch.column("text").to_pylist()]
        fp = np.array([set_hash(s) for s in sets], np.uint64).view(np.int64)
        least = [minhashes(s) if len(s) else None for s in sets]
        keys = [np.zeros(0, np.int64) if x is None else band_keys(x).view(np.int64) for x in least]
        sketch = [b"" if x is None else x.astype(np.uint8).tobytes() for x in least]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "h1", "h2")], pa.array(fp, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "h1", "h2", "fp", "size", "keys", "sketch"])


def near_members(sketches: np.ndarray) -> np.ndarray:
    """Which rows of a matrix of sketches agree with another row in NEAR of their places or more."""
    out = np.zeros(len(sketches), bool)
    for at in range(0, len(sketches), 64):
        same = (sketches[at : at + 64, None] == sketches[None]).sum(axis=2) >= NEAR * sketches.shape[1]
        out[at : at + 64] = same.sum(axis=1) > 1  # each agrees with itself
    return out


def _near(batches):
    import pyarrow as pa

    for batch in sliced(batches):
        members = batch.column("members")
        ends = members.offsets.to_numpy()
        fp, raw = members.values.field("fp").to_numpy(), members.values.field("sketch").to_pylist()
        keep = [lo + np.flatnonzero(near_members(np.frombuffer(b"".join(raw[lo:hi]), np.uint8).reshape(hi - lo, -1))) for lo, hi in zip(ends, ends[1:])]
        at = pa.array(np.repeat(np.arange(len(keep)), [len(k) for k in keep]), pa.int64())
        found = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("shard").take(at), batch.column("tile").take(at), pa.array(fp[found], pa.int64())], names=["shard", "tile", "fp"])


def _sets(batches):
    import pyarrow as pa

    kept: dict[bytes, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(t, kept) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("asked"), part.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["asked", "rep", "shingles"])


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes: the bits that over half of them have."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def shard_links(sets: list[np.ndarray], order: list) -> list[tuple[int, int]]:
    """(member, its component's first member by `order`) of every component of two or more in a shard."""
    tree, out = BKTree([fingerprint(s) for s in sets] if len(sets) > 2 else [0] * len(sets)), []
    for start in sorted(range(len(sets)), key=order.__getitem__):
        if not tree.here[start]:
            continue
        tree.remove(start)
        todo = [start]
        while todo:
            at = todo.pop()
            x = sets[at]
            for i in tree.within(tree.items[at], RADIUS if len(x) >= SMALL else BITS):
                y = sets[i]
                if min(len(x), len(y)) >= LEAST * max(len(x), len(y)) and similarity(x, y) >= LEAST:
                    tree.remove(i)
                    todo.append(i)
                    out.append((i, start))
    return out


def _confirmed(batches):
    import pyarrow as pa

    for batch in batches:
        ends, flat = batch.column("members").offsets.to_pylist(), batch.column("members").values
        fp, rep, raw = flat.field("fp").to_pylist(), flat.field("rep").to_pylist(), flat.field("shingles")
        a, b = [], []
        for lo, hi in zip(ends, ends[1:]):
            sets = [np.frombuffer(raw[i].as_py(), np.uint64) for i in range(lo, hi)]
            for i, j in shard_links(sets, list(zip(rep[lo:hi], fp[lo:hi]))):
                a.append(fp[lo + i])
                b.append(fp[lo + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def shards_of(groups: DataFrame, most: int = MOST) -> DataFrame:
    """(shard, tile, fp): who meets whom. Of shards with the same members one stays. A shard of several groups has a tile
    for each two of them, and a member is in every tile of its group."""
    banded = groups.select("fp", "size", F.explode("keys").alias("shard"))
    same = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes"), F.bit_xor(F.xxhash64("fp")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("same"), "fp")).alias("x2")]
    one = banded.groupBy("shard").agg(*same).where("n > 1").groupBy("n", "hashes", "x1", "x2").agg(F.min("shard").alias("shard"))
    parts = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("hashes") * 8 / SHARD_BYTES)).alias("parts")
    dealt = banded.join(one.select("shard", parts), "shard").withColumn("mine", F.pmod(F.xxhash64("fp", "shard"), F.col("parts")))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: (x != F.col("mine")) | (F.col("parts") == 1))
    tiles = F.transform(other, lambda x: F.least(x, F.col("mine")) * F.col("parts") + F.greatest(x, F.col("mine")))
    return dealt.select("shard", F.explode(tiles).alias("tile"), "fp")


def grouped_similar(documents: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, h1, h2 (the text's key), least (the smallest doc_id that links of similarity 0.8 or more reach) and comp
    (which component) of every row of `documents` (doc_id, text). Texts without words are alike."""
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(text), text.alias("text"))
    prints = settle(rows.mapInArrow(_prints, "doc_id long, h1 long, h2 long, fp long, size long, keys array<long>, sketch binary"), "similar-prints")
    one = F.min(F.struct("h1", "h2")).alias("one")  # the text that stands for its set of shingles
    groups = settle(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(_NO_ID)).alias("rep"), one, F.any_value("size").alias("size"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch")), "similar-groups")
    met = shards_of(groups, most).join(groups.select(F.col("fp").alias("who"), "sketch"), F.col("fp") == F.col("who")).groupBy("shard", "tile").agg(F.collect_list(F.struct("fp", "sketch")).alias("members"))
    shards = settle(met.mapInArrow(_near, "shard long, tile long, fp long"), "similar-shards")
    asked = settle(shards.select("fp").distinct().join(groups.select("fp", "rep", "one"), "fp").select(F.col("fp").alias("asked"), "rep", F.col("one.h1").alias("a1"), F.col("one.h2").alias("a2")), "similar-asked")
    some = perhaps(rows, [F.col("h1"), F.col("h2")], asked, [F.col("a1"), F.col("a2")], "perhaps").where("perhaps").drop("perhaps")
    read = some.join(asked, (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2"))).dropDuplicates(["h1", "h2"]).select("asked", "rep", "text")
    sets = read.mapInArrow(_sets, "asked long, rep long, shingles binary")
    members = shards.join(sets, F.col("fp") == F.col("asked")).groupBy("shard", "tile").agg(F.collect_list(F.struct("fp", "rep", "shingles")).alias("members"))
    links = settle(members.select("members").mapInArrow(_confirmed, "a long, b long").distinct(), "similar-links")  # read twice below
    mine = groups.select("fp", "rep")
    named = mine.join(components(mine, links), "fp", "left").select(F.col("fp").alias("own"), F.coalesce("lab.rep", "rep").alias("least"), F.coalesce("lab.fp", "fp").alias("comp"))
    return prints.drop("size", "keys", "sketch").join(named, F.col("fp") == F.col("own"), "left").drop("own", "fp")


def similar_documents(documents: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id and component_id of every row: the smallest doc_id of all rows that links reach, null where none has one."""
    return grouped_similar(documents, most).select("doc_id", F.when(F.col("least") != _NO_ID, F.col("least")).alias("component_id"))


def keep_first_similar(documents: DataFrame) -> DataFrame:
    """One row of each group of similar documents, with all its columns, chosen as keep_first does."""
    return keep_first(documents, rows=grouped_similar(documents))
