"""Vector codes: a codebook for each part of the vectors, fitted by Lloyd rounds with Yinyang bounds.

A row keeps, for each part, its entry and one lower bound for each group of entries: no entry of the group, its own
aside, is nearer. When entries move, a bound falls by the most that one of the group moved, and a group is scanned only
where its bound no longer exceeds the distance to the row's own entry. Distances that decide are sums of integers, so
ties are found exactly; bounds are floating point, rounded down. The state of a round is a table, written and read
again; what leaves the cluster are sums and counts by entry, of which there are parts x entries x (width + 1)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import forget, settle

PARTS, ENTRIES, ROUNDS, GROUPS, SCALE = 16, 64, 2, 6, 256
MOST = 1 << 28  # whole components beyond this would not leave room for exact sums
SLACK, FARTHEST = 2e-3, 6e4  # half floats are off by less than SLACK, and end a little after FARTHEST


def grouped(book: np.ndarray) -> np.ndarray:
    """A group for each entry of a codebook (entries, width): a few Lloyd rounds over entries, seeds far from each other."""
    points = book.astype(np.float64)
    seeds = [0]
    while len(seeds) < min(GROUPS, len(points)):
        near = ((points[:, None] - points[seeds]) ** 2).sum(axis=2).min(axis=1)
        seeds.append(int(near.argmax()))
    centres = points[seeds]
    for _ in range(5):
        group = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([points[group == g].mean(axis=0) if (group == g).any() else centres[g] for g in range(len(centres))])
    return group


def nearest(x: np.ndarray, book: np.ndarray, group: np.ndarray, code: np.ndarray | None, lower: np.ndarray | None):
    """(entry, squared distance, bounds) of rows x (n, width) of one part; code and lower are the rows' entries and bounds
    so far, these less what entries have moved since; None where there are none yet. Also how many distances it took."""
    n, groups = len(x), int(group.max()) + 1
    if code is None:
        own, code = np.full(n, np.iinfo(np.int64).max), np.full(n, len(book), np.int64)
        bounds, need = np.zeros((n, groups)), np.ones((n, groups), bool)
    else:
        own, bounds = ((x - book[code]) ** 2).sum(axis=1), lower.astype(np.float64)
        need = bounds <= np.sqrt(own)[:, None] * (1 + SLACK) + SLACK
    best, entry, took = own.copy(), code.copy(), n
    first, firsts, second = np.zeros((n, groups), np.int64), np.full((n, groups), -1, np.int64), np.zeros((n, groups))
    for g in range(groups):
        rows, members = np.flatnonzero(need[:, g]), np.flatnonzero(group == g)
        if not len(rows) or not len(members):
            bounds[rows, g] = FARTHEST
            need[rows, g] = False
            continue
        d = ((x[rows][:, None] - book[members]) ** 2).sum(axis=2)
        took += d.size
        at = d.argmin(axis=1)  # the first, so the lowest, of equal ones
        least, which = d[np.arange(len(rows)), at], members[at]
        first[rows, g], firsts[rows, g] = least, which
        second[rows, g] = np.sqrt(np.partition(d, 1, axis=1)[:, 1]) if len(members) > 1 else FARTHEST
        better = (least < best[rows]) | ((least == best[rows]) & (which < entry[rows]))
        best[rows[better]], entry[rows[better]] = least[better], which[better]
    bounds = np.where(need, np.where(firsts == entry[:, None], second, np.sqrt(first)), bounds)
    left = np.flatnonzero((entry != code) & (code < len(book)))  # their old entry is now one of the others
    if len(left):
        of = group[code[left]]
        bounds[left, of] = np.minimum(bounds[left, of], np.sqrt(own[left]))
    return entry, best, np.minimum(bounds, FARTHEST) * (1 - SLACK), took


def _rows(column, kind, shape) -> np.ndarray:
    ends = column.offsets.to_numpy() if hasattr(column, "offsets") else np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), *shape)


def _round(books: np.ndarray, groups: np.ndarray, fall: np.ndarray | None, last: bool):
    """mapInArrow function over (item, vec) or (item, whole, code, lower, ...) rows: entries and bounds for `books` (parts,
    entries, width), and at the end of a task the sums and counts by entry. fall: how much bounds fall, by part and group."""
    import pyarrow as pa

    parts, entries, width = books.shape
    wide = int(groups.max()) + 1

    def binary(x: np.ndarray):
        raw = np.ascontiguousarray(x).reshape(len(x), -1).view(np.uint8)
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * raw.shape[1]).astype(np.int32)), pa.py_buffer(raw)])

    def run(batches):
        totals = np.zeros((parts, entries, width + 1), np.int64)
        kinds = None
        for batch in batches:
            n, item = batch.num_rows, batch.column("item")
            kinds = item.type
            if not n:
                continue
            if fall is None:
                x = np.floor(batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, parts, width) * SCALE)
                if np.abs(x).max() > MOST:
                    raise ValueError(f"components beyond {MOST // SCALE} have no exact codes")
                x = x.astype(np.int64)
            else:
                x = _rows(batch.column("whole"), np.int32, (parts, width)).astype(np.int64)
                code = _rows(batch.column("code"), np.uint8, (parts,)).astype(np.int64)
                lower = _rows(batch.column("lower"), np.float16, (parts, wide)).astype(np.float64) - fall
            found, error, bounds = np.empty((n, parts), np.uint8), np.zeros(n, np.int64), np.empty((n, parts, wide), np.float16)
            for p in range(parts):
                had = (None, None) if fall is None else (code[:, p], lower[:, p])
                entry, d, bound, _ = nearest(x[:, p], books[p], groups[p], *had)
                found[:, p], error = entry, error + d
                bounds[:, p, : bound.shape[1]], bounds[:, p, bound.shape[1] :] = bound, FARTHEST
                if not last:
                    np.add.at(totals[p], entry, np.column_stack([x[:, p], np.ones(n, np.int64)]))
            none = pa.nulls(n, pa.int64())
            state = [pa.nulls(n, pa.binary()) if last else binary(x.astype(np.int32)), binary(found), pa.nulls(n, pa.binary()) if last else binary(bounds)]
            yield pa.RecordBatch.from_arrays([item, *state, pa.array(error), none, none], names=["item", "whole", "code", "lower", "error", "cell", "total"])
        cells = np.flatnonzero(totals)
        if len(cells):
            none = [pa.nulls(len(cells), k) for k in (kinds, pa.binary(), pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(cells, pa.int64()), pa.array(totals.ravel()[cells])], names=["item", "whole", "code", "lower", "error", "cell", "total"])

    return run


def moved(books: np.ndarray, state: DataFrame) -> np.ndarray:
    """Each entry at the mean of its parts, rounded down; entries without any stay."""
    totals = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    for row in state.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("total").alias("total")).collect():  # one row a codebook cell
        totals.ravel()[row["cell"]] = row["total"]
    counts = totals[..., -1:]
    return np.where(counts > 0, totals[..., :-1] // np.maximum(counts, 1), books)


def compress(rows: DataFrame, id_col: str, vec_col: str, carry: list[str], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray]:
    """(item, code binary, error) of every row, `item` holding the columns named by `carry`, and the final codebooks
    (parts, entries, width). Codebooks start as the `entries` rows of smallest id (null ids last, equal ids by vector); a
    table of fewer rows has as many entries.

    Rows whose vector is null or holds null or non-finite components go; so do vectors that cannot be cut into `parts`
    equal parts, and those of another length than the first row's. Repeated rows count as often as they come. An empty
    table has no codes and no codebooks. Components beyond 2^20 are refused, as sums of their squares would not be exact."""
    big = 1.7976931348623157e308
    vec = F.col(vec_col).cast("array<double>")
    held = rows.select(F.struct(*carry).alias("item"), F.col(id_col).alias("id"), vec.alias("vec")).where("vec IS NOT NULL AND size(vec) > 0").where(F.size("vec") % parts == 0)
    held = held.where(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) <= big)))
    first = held.orderBy(F.col("id").asc_nulls_last(), "vec").limit(1).select(F.size("vec").alias("n")).first()
    if first is None:
        return None, np.zeros((parts, 0, 0), np.int64)
    held = held.where(F.size("vec") == first["n"])
    seeds = held.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    books = np.floor(np.array([r["vec"] for r in seeds]) * SCALE).astype(np.int64).reshape(len(seeds), parts, -1).swapaxes(0, 1).copy()
    groups = np.array([grouped(b) for b in books])
    item = held.schema["item"].dataType.simpleString()
    kind = f"item {item}, whole binary, code binary, lower binary, error long, cell long, total long"
    state, fall = held.select("item", "vec"), None
    for turn in range(rounds + 1):
        last = turn == rounds
        new = settle(state.mapInArrow(_round(books, groups, fall, last), kind), "codes")
        if turn:
            forget(settled)
        settled = new
        if not last:
            later = moved(books, settled)
            drift = np.sqrt(((later - books) ** 2).sum(axis=2)) * (1 + SLACK)
            fall = np.array([[drift[p][groups[p] == g].max(initial=0) for g in range(int(groups.max()) + 1)] for p in range(parts)])
            books, state = later, settled.where("cell IS NULL").select("item", "whole", "code", "lower")
    return settled.select("item", "code", "error"), books


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that `compress` keeps. Errors are summed over equal
    labels, nulls being equal; labels' totals are joined to the rows, so a frequent label is no task of its own."""
    codes, books = compress(embeddings, "vec_id", "embedding", ["vec_id", "label"])
    if codes is None:
        codes = embeddings.limit(0).select(F.struct("vec_id", "label").alias("item"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = codes.select("item.vec_id", "item.label", F.lower(F.hex("code")).alias("code"), "error")
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return rows.join(totals, rows["label"].eqNullSafe(totals["of"])).select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
