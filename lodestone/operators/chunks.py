"""Chunks of code, their identifiers, seeded stand-in embeddings and the chunk table."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import lines, strip, uuid5_dns
from lodestone.operators.symbols import blocks

MAX_LINES = 50
PART = 4096  # tiles


def chunk_id(filepath, index):
    return uuid5_dns(F.concat_ws("_", filepath, index.cast("string")))


def _numbered(rows: DataFrame, tiles: Column) -> DataFrame:
    """Chunks of (filepath, array of tiles): blank ones dropped, the rest numbered in order, in place."""
    kept = rows.select("filepath", F.posexplode(F.filter(tiles, lambda x: strip(x) != "")).alias("chunk_index", "content"))
    return kept.select(chunk_id(F.col("filepath"), F.col("chunk_index")).alias("id"), "filepath", "chunk_index", "content")


def chunk_lines(files: DataFrame, file: str, code: str, size: int = MAX_LINES) -> DataFrame:
    """Tiles of `size` lines of each file: id, filepath, chunk_index, content."""
    rows = files.select(F.col(file).cast("string").alias("filepath"), lines(F.col(code)).alias("rows"))
    tiles = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / size).cast("int")), lambda i: F.array_join(F.slice("rows", i * size + 1, F.lit(size)), "\n"))
    return _numbered(rows.where("rows IS NOT NULL"), tiles)


def _tile_starts(code: str, size: int) -> Iterator[int]:
    at, total = 0, code.count("\n") + 1
    for start, end in [*sorted(blocks(code)), (total, total)]:
        start = max(start, at)
        yield from range(at, start, size)
        yield from range(start, end, size)
        at = max(end, start)


def tile_starts(code: str, size: int = MAX_LINES) -> list[int]:
    """Start lines of the tiles of a python text: top-level definitions, and what stands between them, tiled apart."""
    return list(_tile_starts(code, size))


def _tiles(code: str, size: int) -> Iterator[str]:
    """The tiles of a python text, one after the other."""
    starts, at, line = _tile_starts(code, size), 0, 0
    next(starts)
    for stop in starts:
        end = at
        for _ in range(stop - line):
            end = code.find("\n", end) + 1 or len(code) + 1  # the parser also counts lines that end otherwise
        yield code[at : end - 1]
        at, line = end, stop
    yield code[at:]


def chunk_python(files: DataFrame, file: str, code: str, size: int = MAX_LINES) -> DataFrame:
    """Like chunk_lines, but no tile reaches over the border of a top-level function or class. Texts that do not parse
    are tiled by lines. No row grows with a file: its tiles come in rows of PART."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tiles = enumerate(t for t in _tiles(batch.column("code")[i].as_py() or "", size) if t and not t.isspace())
                while some := list(islice(tiles, PART)):
                    yield pa.RecordBatch.from_arrays([batch.column("filepath").slice(i, 1), pa.array([some[0][0]], pa.int32()), pa.array([[t for _, t in some]], pa.list_(pa.string()))], names=["filepath", "first", "tiles"])

    rows = files.select(F.col(file).cast("string").alias("filepath"), F.col(code).cast("string").alias("code")).mapInArrow(run, "filepath string, first int, tiles array<string>")
    kept = rows.select("filepath", "first", F.posexplode("tiles").alias("pos", "content")).withColumn("chunk_index", F.col("first") + F.col("pos"))
    return kept.select(chunk_id(F.col("filepath"), F.col("chunk_index")).alias("id"), "filepath", "chunk_index", "content")


def mock_vector(text: str, dim: int) -> list[float]:
    """A vector that depends on the text alone (null as empty), from a generator seeded with the text's hash."""
    draw = random.Random(int(hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest(), 16))
    return [draw.uniform(-0.1, 0.1) for _ in range(dim)]


def dimension(model: str) -> int:
    return 1536 if "3-small" in model else 384


def embed(chunks: DataFrame, content: str = "content", model: str = "mini", vectors=None) -> DataFrame:
    """Adds `embedding`. `vectors` is a function of a list of texts; without one the seeded stand-in is used."""
    dim = dimension(model)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(vectors(list(texts)) if vectors else [mock_vector(t, dim) for t in texts])

    return chunks.withColumn("embedding", run(F.col(content)))


def loader_of(model: str, key: str = "") -> Callable:
    """A function that loads a model where it is called, on an executor, and returns one from texts to vectors: of the
    hosted model for names with 3-small and a key, else of a local sentence model."""

    def hosted():
        from openai import OpenAI

        client = OpenAI(api_key=key)
        return lambda texts: [x.embedding for x in client.embeddings.create(input=texts, model=model).data]

    def local():
        from sentence_transformers import SentenceTransformer

        encoder = SentenceTransformer(model)
        return lambda texts: [v.tolist() for v in encoder.encode(texts)]

    return hosted if "3-small" in model and key else local


_loaded: dict[str, Callable | None] = {}


def _model(name: str, loader: Callable) -> Callable | None:
    """The model of this process, loaded once, however many tasks it runs; None if it cannot be loaded."""
    if name not in _loaded:
        try:
            _loaded[name] = loader()
        except Exception:
            _loaded[name] = None
    return _loaded[name]


def embed_with(chunks: DataFrame, loader: Callable, content: str = "content", model: str = "mini", batch: int = 64) -> DataFrame:
    """Adds `embedding` and `embedding_source`, model or stand-in. `loader` runs once in each Python worker process that
    gets rows (workers are kept from task to task) and returns a function from a list of texts to vectors, which is given
    at most `batch` at a time. Where it cannot be loaded or fails, the seeded stand-ins are used, as they are for nulls."""
    dim = dimension(model)

    @F.pandas_udf("embedding array<float>, embedding_source string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = _model(model, loader)
        for texts in parts:
            vectors, sources = [mock_vector(t, dim) if t is None or encode is None else None for t in texts], ["stand-in"] * len(texts)
            todo = [i for i, v in enumerate(vectors) if v is None]
            for at in range(0, len(todo), batch):
                mine = todo[at : at + batch]
                try:
                    found, source = list(encode([texts.iloc[i] for i in mine])), "model"
                except Exception:
                    found, source = [mock_vector(texts.iloc[i], dim) for i in mine], "stand-in"
                for i, v in zip(mine, found, strict=True):
                    vectors[i], sources[i] = v, source
            yield pd.DataFrame({"embedding": vectors, "embedding_source": sources})

    return chunks.withColumn("made", run(F.col(content).cast("string"))).select(*chunks.columns, "made.embedding", "made.embedding_source")


def upsert(table: DataFrame, new: DataFrame, replace_file: bool = False) -> DataFrame:
    """The chunk table after new rows: the new row of an id holds. With replace_file, older chunks of the new rows'
    files go too, so a file that has become shorter leaves none behind."""
    key = "filepath" if replace_file else "id"
    return table.join(new.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))
