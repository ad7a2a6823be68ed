"""Repeated passages by sparse suffix arrays.

Suffixes start at words; kept are those at minimiser positions, chosen by content alone: the least GRAM-word hash of
each LENGTH-word window. Two equal windows of LENGTH words hold the same kept suffix, so passages of LENGTH words can
only repeat where a kept suffix' first GRAM words do. First pass: which of these come in more than one row, as a table
that is joined back to the texts, so nothing of the corpus' size is broadcast or collected.

Second pass: the kept suffixes of a block of texts are sorted by the words that follow, and once more by those that
precede, and neighbours are compared word by word. The lengths that neighbours have in common say, for every reach to
the left, which suffixes extend alike to the right and to the left: windows of LENGTH words around them are equal
exactly if both are. A block then sends one entry for each window, however many of its texts share it, to be sorted
and compared with other blocks' entries. Within a block words are compared themselves; between blocks windows are
compared by 128-bit hashes of their words."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import forget, settle

LENGTH, GRAM = 50, 8
REACH = LENGTH - GRAM  # a window's kept suffix starts at most so many words after it
BLOCK_WINDOWS, BLOCK_SUFFIXES, BLOCK_WORDS, BUCKET_WINDOWS = 1_500_000, 150_000, 3_000_000, 2_000_000
_MIX1, _MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # fixed odd multipliers
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_SHARED = np.uint32(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a rolling multiplier and its inverse, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.inverse, np.uint64)], dtype=np.uint64)
        return self.up, self.down


_powers = [Powers(b) for b in _BASES]


class Words(dict):
    """Numbers for distinct words, from 1, with two independent 64-bit hashes of each."""

    def __init__(self) -> None:
        super().__init__()
        self.raw, self.known = [bytes(16)], np.zeros((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        number = self[word] = len(self.raw)
        self.raw.append(xxhash.xxh3_128_digest(word))
        return number

    def hashes(self) -> np.ndarray:
        if len(self.known) < len(self.raw):
            self.known = np.concatenate([self.known, np.frombuffer(b"".join(self.raw[len(self.known) :]), np.uint64).reshape(-1, 2)])
        return self.known

    def of(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, parts), np.uint32, len(parts))


def words_of(text: str | None) -> list[bytes]:
    """A text's words (white space as in ASCII); none of a text of fewer than LENGTH words."""
    parts = text.encode("utf-8", "surrogatepass").split() if text else []
    return parts if len(parts) >= LENGTH else []


def sums_of(values: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums, of values of the words, from which the hash of any word range follows."""
    return np.r_[np.uint64(0), np.cumsum(values * _powers[which].get(len(values) + 1)[1][: len(values)], dtype=np.uint64)]


def hashes(sums: np.ndarray, starts: np.ndarray, size: int, which: int) -> np.ndarray:
    """Of the word ranges of `size` words from `starts`."""
    return mixed((sums[starts + size] - sums[starts]) * _powers[which].get(len(sums))[0][starts])


def kept_suffixes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of LENGTH words or more: places of its kept suffixes, hashes of their first words, and for each window
    of LENGTH words which of these it holds as its least. Words of one checksum only make these hashes say less."""
    n = len(parts)
    sums = sums_of(mixed(np.fromiter(map(zlib.crc32, parts), np.uint64, n) + np.uint64(1)), 0)
    grams, wide = hashes(sums, np.arange(n - GRAM + 1), GRAM, 0), REACH + 1
    out = []
    for at in range(0, n - LENGTH + 1, 1 << 15):  # in slices, so a very long text needs little memory
        part = np.lib.stride_tricks.sliding_window_view(grams[at : at + (1 << 15) + wide - 1], wide)
        out.append(part.argmin(axis=1) + np.arange(at, at + len(part)))
    at, least = np.unique(np.concatenate(out), return_inverse=True)
    return at, grams[at], least


def _first_pass(batches):
    """(key, text) rows to (key, n, grams): a text's kept suffixes, once for texts that a task sees n times."""
    import pyarrow as pa

    seen, held = {}, 0

    def rows():
        keys = list(seen)
        for at in range(0, len(keys), 2000):
            part = keys[at : at + 2000]
            ends = np.r_[0, np.cumsum([len(seen[k][1]) for k in part])]
            flat = np.concatenate([seen[k][1] for k in part]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([seen[k][0] for k in part], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["key", "n", "grams"])

    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            if key in seen:
                seen[key][0] += 1
                continue
            parts = words_of(text.as_py())
            if parts:
                grams = np.unique(kept_suffixes(parts)[1])
                seen[key], held = [1, grams], held + len(grams)
        if held > 2_000_000:
            yield from rows()
            seen, held = {}, 0
    yield from rows()


def repeated_suffixes(rows: DataFrame) -> DataFrame:
    """(of, grams): for each text (by its key) the kept suffixes that start like one of another row. Keys are 64-bit
    hashes: two texts of one key would only be looked at more closely than need be."""
    found = settle(rows.mapInArrow(_first_pass, "key long, n long, grams array<long>"), "suffixes-grams")
    each = found.select("key", "n", F.explode("grams").alias("gram"))
    again = each.groupBy(F.col("gram").alias("again")).agg(F.sum("n").alias("rows")).where("rows > 1").select("again")
    out = settle(each.join(again, F.col("gram") == F.col("again")).groupBy(F.col("key").alias("of")).agg(F.collect_set("gram").alias("grams")), "suffixes-repeated")
    forget(found)
    return out


def neighbours_alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of rows of numbers, and how many numbers each has in common with the one before it."""
    order = np.lexsort(rows.T[::-1]) if rows.shape[1] * len(rows) < 1 << 12 else np.argsort(np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")
    s = rows[order]
    same = s[1:] == s[:-1]
    return order, np.r_[0, np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))]


def window_classes(right: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """For suffixes with the words that follow (LENGTH columns) and precede (REACH columns, nearest first) a number for
    each of their windows, those that start far to near words before them, in this order: equal for equal windows."""
    m = len(right)
    first = np.cumsum(far - near + 1) - (far - near + 1)
    out = np.empty(int((far - near + 1).sum()), np.int64)
    by_right, common_right = neighbours_alike(right)
    by_left, common_left = neighbours_alike(left)
    after, before = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(REACH + 1):
        mine = np.flatnonzero((near <= o) & (o <= far))
        if len(mine):
            after[by_right] = np.cumsum(common_right < LENGTH - o)
            before[by_left] = np.cumsum(common_left < o)
            out[first[mine] + far[mine] - o] = (o * (m + 1) + after[mine]) * (m + 1) + before[mine]
    return out


SENT = "block long, bucket int, docs binary, runs binary, known binary, links binary, window binary, entry binary"


class Block:
    """Candidate windows of some texts, until there are enough of them."""

    def __init__(self, windows: int) -> None:
        self.words, self.docs, self.total, self.suffixes, self.windows = Words(), [], 0, 0, windows
        self.parts: list[list[np.ndarray]] = []

    def add(self, doc_id: int | None, text: str | None, grams: np.ndarray) -> None:
        parts = words_of(text)
        if not parts:
            return
        at, h, least = kept_suffixes(parts)
        chosen = np.isin(h, grams)
        starts = np.flatnonzero(chosen[least])
        if not len(starts):
            return
        place, lo = np.unique(least[starts], return_index=True)  # windows of one kept suffix follow each other
        p, hi = at[place], np.r_[lo[1:], len(starts)] - 1
        ids = self.words.of(parts)
        sums, other = (sums_of(self.words.hashes()[ids, which], which) for which in (0, 1))
        padded = np.r_[np.zeros(REACH, np.uint32), ids, np.zeros(LENGTH, np.uint32)]
        right = padded[p[:, None] + REACH + np.arange(LENGTH)]
        left = padded[p[:, None] + REACH - 1 - np.arange(REACH)]
        self.parts.append([np.full(len(starts), len(self.docs), np.int64), starts, hashes(sums, starts, LENGTH, 0), hashes(other, starts, LENGTH, 1), right, left, p - starts[hi], p - starts[lo]])
        self.docs.append(doc_id)
        self.total += len(starts)
        self.suffixes += len(p)

    def full(self) -> bool:
        return self.total >= self.windows or self.suffixes >= BLOCK_SUFFIXES or len(self.words) > BLOCK_WORDS

    def rows(self, number: int, buckets: int):
        import pyarrow as pa

        owner, start, w1, w2, right, left, near, far = (np.concatenate(x) for x in zip(*self.parts))
        fresh = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]
        first = np.flatnonzero(fresh)
        runs = np.column_stack([owner[first], start[first], np.diff(np.r_[first, len(owner)])]).astype(np.int64)
        alike = window_classes(right, left, near, far)
        order = np.lexsort((owner, alike))
        w, o = alike[order], owner[order]
        same_window = np.r_[False, w[1:] == w[:-1]]
        again = same_window & np.r_[False, o[1:] == o[:-1]]  # the window once more in the same document
        lead = order[~again][np.cumsum(~again) - 1]
        links = np.column_stack([order[again], lead[again]]).astype(np.uint32)
        c1, i1 = w[~again], order[~again]
        begin = np.flatnonzero(np.r_[True, c1[1:] != c1[:-1]])
        size = np.diff(np.r_[begin, len(c1)])
        known = np.zeros(len(alike), bool)
        known[i1[np.repeat(size > 1, size)]] = True
        sent = i1[begin]
        entry = np.where(size > 1, _SHARED, sent.astype(np.uint32)).astype(np.uint32)
        yield [number, -1, _packed_ids(pa.array(self.docs, pa.int64())), runs.tobytes(), np.packbits(known).tobytes(), links.tobytes(), None, None]
        window = np.column_stack([w1[sent], w2[sent]])
        bucket = ((window[:, 0] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1], True])
        for a, z in zip(edges, edges[1:]):
            part = by[a:z]
            yield [number, int(bucket[part[0]]), None, None, None, None, window[part].tobytes(), entry[part].tobytes()]


def _second_pass(buckets: int, windows: int):
    import pyarrow as pa

    names, kinds = [x.split()[0] for x in SENT.split(", ")], [pa.int64(), pa.int32(), *[pa.binary()] * 6]

    def batches_of(block: Block, number: int):
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
        block, base, serial = Block(windows), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for doc_id, text, grams in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("grams")):
                block.add(doc_id, text.as_py(), grams.values.to_numpy(zero_copy_only=False).view(np.uint64))
                if block.full():
                    yield from batches_of(block, base + serial)
                    block, serial = Block(windows), serial + 1
        if block.total:
            yield from batches_of(block, base + serial)

    return run


def _packed_ids(ids) -> bytes:
    """doc_ids as pairs of 64-bit values: whether there is one, and which."""
    return np.column_stack([ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)]).astype(np.int64).tobytes()


def _unpacked_ids(raw: bytes) -> list[int | None]:
    return [x if there else None for there, x in np.frombuffer(raw, np.int64).reshape(-1, 2).tolist()]


def _neighbours(table):
    """Entries of one bucket, sorted by window; those with an equal neighbour go back to their blocks."""
    import pyarrow as pa

    windows, entries, blocks = [], [], []
    for w, e in zip(table.column("window").to_pylist(), table.column("entry").to_pylist()):
        windows.append(np.frombuffer(w, np.uint64).reshape(-1, 2))
        entries.append(np.frombuffer(e, np.uint32))
        blocks.append(np.full(len(entries[-1]), len(blocks), np.int32))
    names = table.column("block").to_pylist()
    w, e, b = map(np.concatenate, (windows, entries, blocks))
    order = np.lexsort((w[:, 1], w[:, 0]))
    s = w[order]
    equal = np.r_[False, (s[1:] == s[:-1]).all(axis=1)]
    hit = order[(equal | np.r_[equal[1:], False]) & (e[order] != _SHARED)]
    by = np.argsort(b[hit], kind="stable")
    edges = np.searchsorted(b[hit][by], np.arange(len(names) + 1))
    parts = [(names[i], e[hit[by[edges[i] : edges[i + 1]]]].tobytes()) for i in range(len(names)) if edges[i] < edges[i + 1]]
    return pa.table({"block": pa.array([p[0] for p in parts], pa.int64()), "found": pa.array([p[1] for p in parts], pa.binary())})


def _passages(table):
    """Spans of the documents of one block, from its own record and what the buckets sent back."""
    import pyarrow as pa

    rows = table.to_pylist()
    own = next(r for r in rows if r["docs"] is not None)
    docs, runs = _unpacked_ids(own["docs"]), np.frombuffer(own["runs"], np.int64).reshape(-1, 3)
    total = int(runs[:, 2].sum())
    repeated = np.unpackbits(np.frombuffer(own["known"], np.uint8))[:total].astype(bool)
    for r in rows:
        if r["found"] is not None:
            repeated[np.frombuffer(r["found"], np.uint32)] = True
    links = np.frombuffer(own["links"], np.uint32).reshape(-1, 2)
    repeated[links[:, 0]] = repeated[links[:, 1]]
    offsets = np.r_[0, np.cumsum(runs[:, 2])]
    spans: dict[int, list[list[int]]] = {}
    at = np.flatnonzero(repeated)
    run = np.searchsorted(offsets, at, side="right") - 1
    owner, start = runs[run, 0], runs[run, 1] + at - offsets[run]
    fresh = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]) if len(at) else np.zeros(0, int)
    for a, z in zip(fresh, np.r_[fresh[1:], len(at)]):
        mine = spans.setdefault(int(owner[a]), [])
        lo, hi = int(start[a]), int(start[z - 1]) + LENGTH
        if mine and lo <= mine[-1][1]:
            mine[-1][1] = hi
        else:
            mine.append([lo, hi])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.table(
        {
            "doc_id": pa.array([docs[i] for i in spans], pa.int64()),
            "n_passages": pa.array([len(s) for s in spans.values()], pa.int64()),
            "n_words": pa.array([sum(b - a for a, b in s) for s in spans.values()], pa.int64()),
            "passages": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans.values()], kind),
        }
    )


def repeated_passages(documents: DataFrame) -> DataFrame:
    """doc_id, n_passages, n_words and passages (word positions, end exclusive) of every row of `documents` (doc_id,
    text) that shares LENGTH words or more in a row with another row; other rows are not returned.

    Words are what ASCII white space parts, compared exactly (by 128-bit hashes where blocks meet). A passage is a maximal run of words covered by windows
    of LENGTH words that also occur in another row; repeats within one row alone do not count. Null, empty and
    shorter texts share nothing; a null doc_id stays null; repeated rows are copies of each other; an empty table
    gives no rows; other columns are not read."""
    key = F.xxhash64("text").alias("key")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    repeated = repeated_suffixes(rows.select(key, "text"))
    size = repeated.agg(F.sum(F.size("grams"))).first()[0] or 0
    buckets = max(1, math.ceil(size * REACH / 2 / BUCKET_WINDOWS))  # a kept suffix stands for half its reach of windows on average
    read = rows.select("doc_id", "text", key).join(repeated, F.col("key") == F.col("of")).select("doc_id", "text", "grams")
    sent = settle(read.mapInArrow(_second_pass(buckets, BLOCK_WINDOWS), SENT), "suffixes")
    forget(repeated)
    found = sent.where("bucket >= 0").select("bucket", "block", "window", "entry").groupBy("bucket").applyInArrow(_neighbours, "block long, found binary")
    own = sent.where("bucket < 0").select("block", "docs", "runs", "known", "links", F.lit(None).cast("binary").alias("found"))
    back = found.select("block", *[F.lit(None).cast("binary").alias(c) for c in ("docs", "runs", "known", "links")], "found")
    return own.unionByName(back).groupBy("block").applyInArrow(_passages, "doc_id long, n_passages long, n_words long, passages array<struct<start:int,end:int>>")
