"""Stored tables of graphs and chunks, in hash buckets with versions.

A row lies in the bucket of its key. A write makes new files for the buckets that it touches and a manifest that names,
for every bucket, the folder that holds it; buckets that a write does not touch stay as they are, so an upsert costs what
its buckets hold, not what the table does. Manifests are numbered, and one can only be created, never replaced: of two
writers that started from one version the later fails and leaves the table as the earlier made it. Readers see one
version whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.chunks import upsert
from lodestone.operators.graph import upsert_edges

EDGES = "src string, dst string, relation string"
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer made the next version first; read again and repeat."""


class Store:
    """A table under a folder that Spark can write to; `key` names the columns whose hash chooses the bucket."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: tuple[str, ...] = (), buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.schema, self.buckets = spark, folder.rstrip("/"), schema, buckets
        columns = spark.createDataFrame([], schema).columns
        self.key = key or (("filepath",) if "filepath" in columns else (columns[0],))

    # Hadoop's file system, as the folder may be in any store that Spark reads.

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._path("manifests")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def manifest(self, version: int | None = None) -> dict:
        """version, and the folder of each bucket that has rows; the newest, or that of a stated version."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "buckets": {}}
        path, _ = self._path(f"manifests/{known[-1] if version is None else version}")
        return json.loads("".join(r[0] for r in self.spark.read.text(str(path.toString())).collect()))  # one small file

    def _commit(self, base: int, buckets: dict[str, str]) -> None:
        path, fs = self._path(f"manifests/{base + 1}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {base + 1} of {self.folder} is there already") from e
            raise
        out.write(bytearray(json.dumps({"version": base + 1, "buckets": buckets}).encode()))
        out.close()

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, buckets: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/{place}" for place in buckets.values()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or a stated one; an empty table before the first write."""
        return self._rows(self.manifest(version)["buckets"])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose key columns are among `keys`; only the buckets that can hold them are read."""
        touched = self._touched(keys)
        mine = {b: place for b, place in self.manifest()["buckets"].items() if int(b) in touched}
        return self._rows(mine).join(keys.select(*self.key).distinct(), list(self.key), "left_semi")

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._bucket()).distinct().collect()}  # numbers of buckets

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """The rows as new files, a folder for each bucket; each bucket is written by one task."""
        name = f"data/{uuid.uuid4().hex}"
        # schema columns may be named like anything, so the bucket's column has a name of its own
        rows.withColumn("store_bucket", self._bucket()).repartition(F.col("store_bucket")).write.partitionBy("store_bucket").parquet(f"{self.folder}/{name}")
        path, fs = self._path(name)
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return {n.split("=")[1]: f"{name}/{n}" for n in found if n.startswith("store_bucket=")}

    def replace(self, rows: DataFrame) -> None:
        """Full synchronisation: the rows are the table from now on."""
        base = self.manifest()["version"]
        self._commit(base, self._write(rows.select(*self.spark.createDataFrame([], self.schema).columns)))

    def clear(self) -> None:
        self._commit(self.manifest()["version"], {})

    def merge(self, new: DataFrame, rule) -> int:
        """The table after rule(old rows of the touched buckets, new rows); returns how many buckets were rewritten."""
        base = self.manifest()
        touched = self._touched(new)
        old = {b: place for b, place in base["buckets"].items() if int(b) in touched}
        rest = {b: place for b, place in base["buckets"].items() if int(b) not in touched}
        if touched:
            self._commit(base["version"], rest | self._write(rule(self._rows(old), new)))
        return len(touched)

    def upsert_edges(self, new: DataFrame) -> int:
        return self.merge(new, upsert_edges)

    def upsert_chunks(self, new: DataFrame, replace_file: bool = False) -> int:
        """Ids follow from file paths, so a chunk's older version lies in its file's bucket."""
        return self.merge(new, lambda old, rows: upsert(old, rows, replace_file))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the newest `keep` versions' predecessors and the bucket folders that only they name; returns these."""
        versions = self.versions()
        kept, gone = versions[-keep:] if keep else [], versions[:-keep] if keep else versions
        live = {place for v in kept for place in self.manifest(v)["buckets"].values()}
        dead = sorted({place for v in gone for place in self.manifest(v)["buckets"].values()} - live)
        for name in [*dead, *[f"manifests/{v}" for v in gone]]:
            path, fs = self._path(name)
            fs.delete(path, True)
        return dead
