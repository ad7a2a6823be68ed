"""Files of a directory, a ZIP archive or a git repository as rows: Python data sources that read what Spark's own
readers leave out (names that start with _ or ., and empty files)."""

from __future__ import annotations

import io
import os
import subprocess
import tempfile
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions.paths import binary_name, ignores_dir, language
from lodestone.functions.text import count_lines, decode

FILES = "path string, abs_path string, size_bytes long, content binary, error string"


@dataclass
class Batch(InputPartition):
    names: list[str]


def walk(root: str) -> list[str]:
    """Relative paths of a tree's text files, sorted. Ignored directories are not entered, links not followed."""
    out = []
    for at, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not ignores_dir(d))
        out += [os.path.relpath(os.path.join(at, n), root).replace(os.sep, "/") for n in sorted(names) if not binary_name(n)]
    return out


def _batches(names: list[str], size: int) -> list[Batch]:
    return [Batch(names[i : i + size]) for i in range(0, len(names), size)] or [Batch([])]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.size = os.path.abspath(options["path"]), int(options.get("filesPerPartition", 256))

    def partitions(self):
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"Not a directory: {self.root}")
        return _batches(walk(self.root), self.size)

    def read(self, partition):
        for name in partition.names:
            where = os.path.join(self.root, name)
            try:
                with open(where, "rb") as f:
                    content = f.read()
                yield name, where, len(content), content, None
            except OSError as e:
                yield name, where, 0, None, str(e)


class TreeSource(DataSource):
    """Format repo_tree; option path, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


class ZipReader(DataSourceReader):
    """Members are read straight from the archive, so no name in it can reach a place on the disk."""

    def __init__(self, options: dict) -> None:
        self.file, self.size = os.path.abspath(options["path"]), int(options.get("filesPerPartition", 256))

    def members(self) -> dict[str, str]:
        with zipfile.ZipFile(self.file) as z:
            names = [n for n in z.namelist() if not n.endswith("/")]
            tops = {n.split("/", 1)[0] for n in z.namelist()}
        hoist = len(tops) == 1 and all("/" in n for n in names)
        return {(n.split("/", 1)[1] if hoist else n): n for n in names}

    def partitions(self):
        if not zipfile.is_zipfile(self.file):
            raise ValueError(f"Not a valid ZIP file: {self.file}")
        keep = sorted(n for n in self.members() if not any(map(ignores_dir, n.split("/")[:-1])) and not binary_name(n.rsplit("/", 1)[-1]))
        return _batches(keep, self.size)

    def read(self, partition):
        members = self.members()
        with zipfile.ZipFile(self.file) as z:
            for name in partition.names:
                content = z.read(members[name])
                yield name, f"{self.file}!{members[name]}", len(content), content, None


class ZipSource(TreeSource):
    """Format repo_zip; a single top directory is taken as the root."""

    @classmethod
    def name(cls) -> str:
        return "repo_zip"

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
    spark.dataSource.register(ZipSource)


def with_facts(raw: DataFrame) -> DataFrame:
    """Adds language, text, line_count and sha256 to raw files. A file that cannot be read has no text, no lines and an
    empty hash."""
    text = F.when(F.col("content").isNotNull(), decode(F.col("content")))
    rows = raw.withColumns({"language": language(F.col("path")), "code": text})
    return rows.withColumns({"line_count": F.coalesce(count_lines(F.col("code")), F.lit(0)), "sha256": F.coalesce(F.sha2("content", 256), F.lit(""))})


def from_local(spark: SparkSession, path: str) -> DataFrame:
    if not os.path.isdir(path):
        raise FileNotFoundError(f"Not a directory: {path}")
    register(spark)
    return with_facts(spark.read.format("repo_tree").option("path", path).load())


def from_zip(spark: SparkSession, path: str) -> DataFrame:
    if not zipfile.is_zipfile(path):
        raise ValueError(f"Not a valid ZIP file: {path}")
    register(spark)
    return with_facts(spark.read.format("repo_zip").option("path", path).load())


def mounted(where: str | None, local: bool) -> str | None:
    """The path of a shared folder that is mounted on all machines; None, which is the driver's own temporary folder, for
    local masters that have none."""
    scheme, _, path = (where or "").rpartition(":")
    if where and scheme in ("", "file"):
        return "/" + path.strip("/")
    if not local:
        raise RuntimeError("a clone needs spark.checkpoint.dir to be a path that all machines mount")
    return None


def clone_folder(spark: SparkSession) -> str | None:
    """Where a clone must lie for executors to read it."""
    return mounted(spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master.startswith("local"))


class GitClone:
    """A shallow clone in a folder of its own, under `under` or the temporary folder, that goes when the block ends."""

    def __init__(self, url: str, branch: str = "main", under: str | None = None) -> None:
        self.url, self.branch, self.under = url, branch, under

    def __enter__(self) -> str:
        if self.under is not None:
            os.makedirs(self.under, exist_ok=True)
        self.folder = tempfile.TemporaryDirectory(prefix="lodestone-git-", dir=self.under)
        os.chmod(self.folder.name, 0o755)  # executors may run as another user
        done = subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--branch", self.branch, self.url, self.folder.name], capture_output=True, text=True)
        if done.returncode:
            self.folder.cleanup()
            raise RuntimeError(f"Cloning {self.url} failed: {done.stderr.strip()}")
        return self.folder.name

    def __exit__(self, *_) -> None:
        self.folder.cleanup()


def zip_bytes(files: dict[str, bytes]) -> bytes:
    """An archive of the given members."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def by_language(files: DataFrame, name: str) -> DataFrame:
    return files.where(F.col("language") == name)


def source_files(files: DataFrame) -> DataFrame:
    return files.where("language IS NOT NULL")


def histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def manifest(files: DataFrame, source_type: str = "local", root: str = "") -> DataFrame:
    """One row: status, source_type, repo_root, total_files, total_source_files, total_lines, language_breakdown,
    ingested_at, files."""
    item = F.struct("path", "language", "size_bytes", "line_count", "sha256")
    totals = files.agg(
        F.count(F.lit(1)).alias("total_files"), F.count("language").alias("total_source_files"),
        F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"), F.array_sort(F.collect_list(item)).alias("files"),
    )
    counts = histogram(files).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "files")))).alias("language_breakdown"))
    return totals.join(F.broadcast(counts), F.lit(True)).select(
        F.lit("success").alias("status"), F.lit(source_type).alias("source_type"), F.lit(root).alias("repo_root"), "total_files", "total_source_files", "total_lines",
        "language_breakdown", F.current_timestamp().alias("ingested_at"), "files",
    )
