"""Substring dedup: words go where the LENGTH words of a window around them also start in a document of smaller doc_id.

Equal texts first: only the smallest doc_id of each distinct text (by a 128-bit hash) takes part; the others lose
all words that windows cover. Of the texts that take part a count-min sketch estimates in how many each window stands. Its
ROWS hash functions give a window the least hash of its GRAM-word runs, so windows side by side mostly share a cell and a
text sends few. Each partition counts cells in a sketch of its own; the sketch is cut into tiles, by the hash, whose
number grows with the texts, and a tile's partial sketches are summed in one task. Nothing of the sketch is broadcast:
each partition gets back which of its cells count two or more texts. An estimate is never too small, so no window that
stands in two texts is lost.

The second pass takes the windows estimated repeated, and only these, by 128-bit hashes of their words: a block of texts
sends one entry for each with the smallest doc_id that has it in the block, buckets of entries group them exactly, and
tell the blocks where a smaller one stands elsewhere."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import forget, settle
from lodestone.llm.suffix_dedup import Words, hashes, mixed, sums_of

LENGTH, GRAM, ROWS = 50, 8, 2
WIDE = LENGTH - GRAM + 1  # runs of GRAM words in a window
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)  # one for each row of the sketch
TILE_CELLS, SKETCH_CELLS, BLOCK_WINDOWS, BUCKET_WINDOWS = 1_000_000, 2_000_000, 1_000_000, 2_000_000
TEXT = ["doc_id", "k1", "k2"]


def split(text: str | None) -> list[bytes]:
    """A text's words, between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def least(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of each `wide` neighbours, by minima of twice as many at a time."""
    span = 1
    while 2 * span <= wide:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (wide - span)], values[wide - span :]) if wide > span else values


def cells(parts: list[bytes]) -> np.ndarray:
    """(ROWS, windows): the cell of each window of LENGTH words in each row of the sketch, as 64-bit numbers."""
    sums = sums_of(mixed(np.fromiter(map(zlib.crc32, parts), np.uint64, len(parts)) + np.uint64(1)), 0)
    grams = hashes(sums, np.arange(len(parts) - GRAM + 1), GRAM, 0)
    return np.array([least(mixed(grams ^ salt), WIDE) for salt in _SALTS])


def _facts(batches):
    """(doc_id, k1, k2, text) rows: number of words, digest of all of them, and each row's distinct cells."""
    import pyarrow as pa

    for batch in batches:
        number, digests, found = [], [], []
        for text in batch.column("text"):
            parts = split(text.as_py())
            number.append(len(parts))
            digests.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            found.append([np.unique(c).tobytes() for c in cells(parts)] if len(parts) >= LENGTH else [None] * ROWS)
        keys = [batch.column(c) for c in TEXT]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(number, pa.int64()), pa.array(digests, pa.string()), *[pa.array([f[r] for f in found], pa.binary()) for r in range(ROWS)]], names=[*TEXT, "n_words", "sha", "cells0", "cells1"])


def _tile(cell: np.ndarray, tiles: int) -> np.ndarray:
    return ((cell >> np.uint64(32)) % np.uint64(tiles)).astype(np.int64)


SKETCH = "part long, tile int, owners binary, sizes binary, cells binary, counts binary"


def _sketch(tiles: int):
    """A partition's own sketches: for each tile the cells that its texts have, in order, and in how many texts (two mean
    two or more); and, apart, which texts have which cells. A new sketch begins after so many cells."""
    import pyarrow as pa

    names = [x.split()[0] for x in SKETCH.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]

    def rows(part, owners, lists):
        sizes = np.array([[len(c) for c in own] for own in lists], np.int64)
        out = [[part, -1, np.array(owners, np.int64).tobytes(), sizes.tobytes(), b"".join(c.tobytes() for own in lists for c in own), None]]
        for r in range(ROWS):
            cell, count = np.unique(np.concatenate([own[r] for own in lists]), return_counts=True)
            tile = _tile(cell, tiles)
            by = np.argsort(tile, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(tile[by]) > 0, True])
            for a, z in zip(edges, edges[1:]):
                out.append([part, int(tile[by[a]]) * ROWS + r, None, None, cell[by[a:z]].tobytes(), np.minimum(count[by[a:z]], 2).astype(np.uint8).tobytes()])
        for at in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 1000]), kinds)], names=names)

    def run(batches):
        base, serial, owners, lists, held = TaskContext.get().partitionId() << 32, 0, [], [], 0
        for batch in batches:
            for key in zip(*[batch.column(c).to_pylist() for c in (*TEXT, "cells0", "cells1")]):
                owners.append(key[:3])
                lists.append([np.frombuffer(c, np.uint64) for c in key[3:]])
                held += sum(map(len, lists[-1]))
                if held >= SKETCH_CELLS:
                    yield from rows(base + serial, owners, lists)
                    serial, owners, lists, held = serial + 1, [], [], 0
        if lists:
            yield from rows(base + serial, owners, lists)

    return run


def _merged(table):
    """The partial sketches of one tile, summed; each part gets back its cells that count two texts or more."""
    import pyarrow as pa

    cell = [np.frombuffer(x, np.uint64) for x in table.column("cells").to_pylist()]
    count = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
    _, place = np.unique(np.concatenate(cell), return_inverse=True)
    often = np.bincount(place, weights=count) >= 2
    hit, out = often[place], []
    for part, tile, own, end in zip(table.column("part").to_pylist(), table.column("tile").to_pylist(), cell, np.cumsum([len(c) for c in cell])):
        mine = own[hit[end - len(own) : end]]
        if len(mine):
            out.append((part, tile, mine.tobytes()))
    return pa.table({"part": pa.array([x[0] for x in out], pa.int64()), "tile": pa.array([x[1] for x in out], pa.int32()), "often": pa.array([x[2] for x in out], pa.binary())})


def _estimated(table):
    """Of one part the texts that have cells counting two or more in every row of the sketch, and these cells."""
    import pyarrow as pa

    rows = table.to_pylist()
    own = next(r for r in rows if r["owners"] is not None)
    owners, sizes, all_cells = np.frombuffer(own["owners"], np.int64).reshape(-1, 3), np.frombuffer(own["sizes"], np.int64).reshape(-1, ROWS), np.frombuffer(own["cells"], np.uint64)
    often = [np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["often"], np.uint64) for r in rows if r["often"] is not None and r["tile"] % ROWS == i]])) for i in range(ROWS)]
    ends, out = np.cumsum(sizes.ravel()).reshape(sizes.shape), []
    for i, key in enumerate(owners.tolist()):
        mine = [all_cells[ends[i, r] - sizes[i, r] : ends[i, r]] for r in range(ROWS)]
        kept = [c[often[r][np.minimum(np.searchsorted(often[r], c), len(often[r]) - 1)] == c] if len(often[r]) else c[:0] for r, c in enumerate(mine)]
        if all(len(c) for c in kept):
            out.append((*key, *[c.tobytes() for c in kept]))
    cols = list(zip(*out)) or [()] * 5
    return pa.table({n: pa.array(c, k) for n, c, k in zip((*TEXT, "often0", "often1"), cols, (*[pa.int64()] * 3, pa.binary(), pa.binary()))})


def estimated_repeated(texts: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, often0, often1) of texts (doc_id, k1, k2, cells0, cells1) with windows that may stand in others too."""
    n = texts.agg(F.sum((F.length("cells0") + F.length("cells1")) / 8)).first()[0] or 0
    tiles = max(1, math.ceil(n / ROWS / TILE_CELLS))
    sent = settle(texts.mapInArrow(_sketch(tiles), SKETCH), "substring-sketch")
    back = sent.where("tile >= 0").select("part", "tile", "cells", "counts").groupBy("tile").applyInArrow(_merged, "part long, tile int, often binary")
    none = F.lit(None).cast("binary")
    own = sent.where("tile < 0").select("part", "tile", "owners", "sizes", "cells", none.alias("often"))
    both = own.unionByName(back.select("part", "tile", none.alias("owners"), none.alias("sizes"), none.alias("cells"), "often"))
    out = settle(both.groupBy("part").applyInArrow(_estimated, "doc_id long, k1 long, k2 long, often0 binary, often1 binary"), "substring-estimated")
    forget(sent)
    return out


SENT = "block long, bucket int, owners binary, runs binary, smaller binary, links binary, window binary, least binary"


class Block:
    """Windows estimated repeated of some texts, until there are enough of them."""

    def __init__(self) -> None:
        self.words, self.owners, self.total, self.parts = Words(), [], 0, []

    def add(self, key: tuple[int, int, int], text: str, often: list[np.ndarray]) -> None:
        parts = split(text)
        found = cells(parts)
        starts = np.flatnonzero(np.isin(found[0], often[0]) & np.isin(found[1], often[1]))
        if not len(starts):
            return
        known = self.words.of(parts)
        sums = [sums_of(self.words.hashes()[known, which], which) for which in (0, 1)]
        self.parts.append([np.full(len(starts), len(self.owners), np.int64), starts, *[hashes(s, starts, LENGTH, which) for which, s in enumerate(sums)]])
        self.owners.append(key)
        self.total += len(starts)

    def rows(self, number: int, buckets: int):
        owner, start, w1, w2 = (np.concatenate(x) for x in zip(*self.parts))
        owners = np.array(self.owners, np.int64)
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)])
        runs = np.column_stack([owner[first], start[first], np.diff(np.r_[first, len(owner)])]).astype(np.int64)
        ids = owners[owner, 0]
        order = np.lexsort((ids, w2, w1))
        a, b, d = w1[order], w2[order], ids[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        begin, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        smaller = np.zeros(len(ids), bool)
        smaller[order] = d > d[begin][group]
        lead = np.empty(len(ids), np.uint32)
        lead[order] = group  # the entry that a window was sent as
        yield [number, -1, owners.tobytes(), runs.tobytes(), np.packbits(smaller).tobytes(), lead.tobytes(), None, None]
        bucket = ((a[begin] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(bucket[by]) > 0, True])
        sent = np.column_stack([a[begin], b[begin]])
        for lo, hi in zip(edges, edges[1:]):
            part = by[lo:hi]
            yield [number, int(bucket[part[0]]), None, None, None, part.astype(np.uint32).tobytes(), sent[part].tobytes(), d[begin][part].tobytes()]


def _second_pass(buckets: int):
    import pyarrow as pa

    names, kinds = [x.split()[0] for x in SENT.split(", ")], [pa.int64(), pa.int32(), *[pa.binary()] * 6]

    def sent(block: Block, number: int):
        held, size = [], 0
        for row in block.rows(number, buckets):
            held.append(row)
            size += sum(len(x) for x in row[2:] if x is not None)
            if size > 1 << 22 or len(held) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    def run(batches):
        block, base, serial = Block(), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for key, text in zip(zip(*[batch.column(c).to_pylist() for c in (*TEXT, "often0", "often1")]), batch.column("text")):
                block.add(key[:3], text.as_py(), [np.frombuffer(x, np.uint64) for x in key[3:]])
                if block.total >= BLOCK_WINDOWS:
                    yield from sent(block, base + serial)
                    block, serial = Block(), serial + 1
        if block.total:
            yield from sent(block, base + serial)

    return run


def _grouped(table):
    """Entries of one bucket, grouped by window; those for which another block has a smaller doc_id go back."""
    import pyarrow as pa

    window = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 2) for x in table.column("window").to_pylist()])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("least").to_pylist()])
    entries = [np.frombuffer(x, np.uint32) for x in table.column("links").to_pylist()]
    order = np.lexsort((ids, window[:, 1], window[:, 0]))
    s = window[order]
    fresh = np.r_[True, (s[1:] != s[:-1]).any(axis=1)]
    hit = np.zeros(len(ids), bool)
    hit[order] = ids[order] > ids[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    ends = np.cumsum([len(e) for e in entries])
    out = [(b, mine.tobytes()) for b, e, end in zip(table.column("block").to_pylist(), entries, ends) if len(mine := e[hit[end - len(e) : end]])]
    return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "found": pa.array([x[1] for x in out], pa.binary())})


def _spans(table):
    """Of one block the texts that lose words, and the spans of these (word positions, end exclusive)."""
    import pyarrow as pa

    rows = table.to_pylist()
    own = next(r for r in rows if r["owners"] is not None)
    owners, runs = np.frombuffer(own["owners"], np.int64).reshape(-1, 3), np.frombuffer(own["runs"], np.int64).reshape(-1, 3)
    lead = np.frombuffer(own["links"], np.uint32)
    gone = np.unpackbits(np.frombuffer(own["smaller"], np.uint8))[: len(lead)].astype(bool)
    back = np.zeros(int(lead.max()) + 1, bool)
    for r in rows:
        if r["found"] is not None:
            back[np.frombuffer(r["found"], np.uint32)] = True
    at = np.flatnonzero(gone | back[lead])
    offsets = np.r_[0, np.cumsum(runs[:, 2])]
    run = np.searchsorted(offsets, at, side="right") - 1
    owner, start = runs[run, 0], runs[run, 1] + at - offsets[run]
    # a span ends where the next window starts beyond the words that this one covers
    head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + LENGTH)]) if len(at) else np.zeros(0, int)
    last = np.r_[head[1:], len(at)] - 1
    bounds = np.flatnonzero(np.r_[True, owner[head][1:] != owner[head][:-1], True]) if len(head) else np.zeros(1, int)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    spans = pa.StructArray.from_arrays([pa.array(start[head], pa.int32()), pa.array(start[last] + LENGTH, pa.int32())], names=["start", "end"]) if len(head) else pa.array([], kind.value_type)
    keys = owners[owner[head[bounds[:-1]]]] if len(head) else owners[:0]
    return pa.table({**{c: pa.array(keys[:, i]) for i, c in enumerate(TEXT)}, "spans": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans).cast(kind)})


def _kept(batches):
    """(doc_id, k1, k2, text, spans) rows: how many words the spans take, and the digest of the others."""
    import pyarrow as pa

    for batch in batches:
        removed, digests = [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            parts, at, left = split(text.as_py()), 0, []
            for s in spans:
                left += parts[at : s["start"]]
                at = s["end"]
            left += parts[at:]
            removed.append(len(parts) - len(left))
            digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in TEXT], pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=[*TEXT, "taken", "left"])


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(LENGTH), text).alias("k2"), text.alias("text"))


def removable_spans(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of `documents` (doc_id, text): every row's facts (doc_id, k1, k2, n_words, sha of all words), the
    smallest doc_id of each distinct text of LENGTH words or more (first_id, k1, k2), and of those that share windows with
    documents of smaller doc_id the text and the spans of these words (doc_id, k1, k2, text, spans). k1 and k2 are hashes
    of the text. Texts are shuffled once, to those that may share something, and only these afterwards."""
    rows = _keyed(documents)
    full = settle(rows.mapInArrow(_facts, "doc_id long, k1 long, k2 long, n_words long, sha string, cells0 binary, cells1 binary"), "substring-cells")
    long_ones = full.where(f"n_words >= {LENGTH} AND doc_id IS NOT NULL")
    firsts = settle(long_ones.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "cells0", "cells1")).alias("f")).select("f.*", "k1", "k2"), "substring-firsts")
    facts = settle(full.drop("cells0", "cells1"), "substring-facts")
    forget(full)
    candidates = estimated_repeated(firsts)
    n = candidates.agg(F.sum(F.length("often0"))).first()[0] or 0
    buckets = max(1, math.ceil(n / 8 * WIDE / 2 / BUCKET_WINDOWS))  # a cell stands for half its reach of windows on average
    fit = rows.where(F.length("text") >= 2 * LENGTH - 1)  # LENGTH words and what parts them
    texts = settle(fit.join(candidates, TEXT).select(*TEXT, "text", "often0", "often1"), "substring-texts")
    forget(candidates)
    sent = settle(texts.mapInArrow(_second_pass(buckets), SENT), "substring-windows")
    none = F.lit(None).cast("binary")
    back = sent.where("bucket >= 0").select("block", "bucket", "links", "window", "least").groupBy("bucket").applyInArrow(_grouped, "block long, found binary")
    own = sent.where("bucket < 0").select("block", "owners", "runs", "smaller", "links", none.alias("found"))
    both = own.unionByName(back.select("block", *[none.alias(c) for c in ("owners", "runs", "smaller", "links")], "found"))
    spans = settle(both.groupBy("block").applyInArrow(_spans, "doc_id long, k1 long, k2 long, spans array<struct<start:int,end:int>>"), "substring-spans")
    forget(sent)
    return facts, firsts.select(F.col("doc_id").alias("first_id"), "k1", "k2"), texts.select(*TEXT, "text").join(spans.dropDuplicates(TEXT), TEXT)


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of `documents`.

    Words stand between ASCII white space and are compared as they are. A null text has none. A null doc_id is neither
    smaller nor larger than any: its row loses nothing and takes nothing from others. Rows of one doc_id take nothing
    from each other, so repeated rows have equal results; texts under LENGTH words stay whole; an empty table gives no
    rows; other columns are not read."""
    facts, firsts, spans = removable_spans(documents)
    cut = spans.select(*TEXT, "text", "spans").mapInArrow(_kept, "doc_id long, k1 long, k2 long, taken long, left string").dropDuplicates(TEXT)
    rows = facts.join(firsts.withColumn("is_first", F.lit(True)).withColumnRenamed("first_id", "doc_id"), TEXT, "left").join(cut, TEXT, "left")
    copy = F.col("is_first").isNull() & (F.col("n_words") >= LENGTH) & F.col("doc_id").isNotNull()
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("taken", F.lit(0))).cast("long")
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.when(copy, nothing).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"))
