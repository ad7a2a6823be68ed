"""The engine's entry points: ingest a repository, review diffs, scan files, serve a stream of events."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.lineage import cut
from lodestone.functions.stage_log import StageLog
from lodestone.operators.chunks import embed_with, loader_of
from lodestone.operators.declarations import analyze_all
from lodestone.operators.quality import unified, unified_report
from lodestone.operators.review import review
from lodestone.sources import tree
from lodestone.streaming.diffs import Fetcher
from lodestone.streaming.webhook import read_events, review_stream


@dataclass(frozen=True)
class Settings:
    """Constants, from the environment where it has them."""

    webhook_secret: str = field(default_factory=lambda: os.environ.get("WEBHOOK_SECRET", ""))
    diff_token: str = field(default_factory=lambda: os.environ.get("GITHUB_TOKEN", ""))
    embedding_key: str = field(default_factory=lambda: os.environ.get("OPENAI_API_KEY", ""))
    embedding_model: str = field(default_factory=lambda: os.environ.get("EMBEDDING_MODEL", "all-MiniLM-L6-v2"))
    max_function_lines: int = 50
    max_nesting: int = 5
    max_complexity: int = 15
    max_chunk_lines: int = 50


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None) -> None:
        self.spark, self.settings = spark, settings or Settings()

    def health(self) -> dict:
        return {"status": "healthy", "modules": ["sources", "operators", "plans", "streaming"]}

    def ingest(self, uri: str, branch: str = "main") -> DataFrame:
        """The manifest of a folder, a ZIP file, or a git repository by URL."""
        if uri.startswith(("http://", "https://", "git@", "file://")):
            with tree.GitClone(uri, branch, tree.clone_folder(self.spark)) as folder:
                return cut(tree.manifest(tree.from_local(self.spark, folder), "github", uri))  # stored before the clone goes
        if uri.endswith(".zip"):
            return tree.manifest(tree.from_zip(self.spark, uri), "zip", uri)
        return tree.manifest(tree.from_local(self.spark, uri), "local", uri)

    def files(self, path: str) -> DataFrame:
        return tree.from_zip(self.spark, path) if path.endswith(".zip") else tree.from_local(self.spark, path)

    def symbols(self, files: DataFrame) -> DataFrame:
        return analyze_all(files)

    def scan(self, files: DataFrame) -> DataFrame:
        s = self.settings
        return unified(files, max_lines=s.max_function_lines, max_nesting=s.max_nesting, max_complexity=s.max_complexity)

    def report(self, files: DataFrame) -> DataFrame:
        """One row per file: counts, breakdowns, findings of both scanners and the health score over all."""
        s = self.settings
        return unified_report(files, max_lines=s.max_function_lines, max_nesting=s.max_nesting, max_complexity=s.max_complexity)

    def review(self, diffs: DataFrame, edges: DataFrame | None = None, log: StageLog | None = None) -> DataFrame:
        return review(diffs, "diff", edges, log)

    def log(self, run: str | None = None) -> StageLog:
        """A log to hand to `review`; its rows are there when the review has been written or counted."""
        return StageLog(self.spark, run)

    def review_json(self, diffs: DataFrame) -> DataFrame:
        """status, summary and findings of each diff as JSON."""
        rows = self.review(diffs)
        return rows.select(F.to_json(F.struct("status", F.col("pr_summary").alias("summary"), F.struct("security", "architecture", "performance", "testing").alias("findings"))).alias("json"))

    def fetcher(self) -> Fetcher:
        """Diffs by URL with the token of the settings."""
        return Fetcher(self.settings.diff_token)

    def embed(self, chunks: DataFrame, content: str = "content") -> DataFrame:
        """Adds embedding and embedding_source: by the model of the settings, or stand-ins where it is not to be had."""
        return embed_with(chunks, loader_of(self.settings.embedding_model, self.settings.embedding_key), content, self.settings.embedding_model)

    def review_stream(self, folder: str, diffs: DataFrame | Fetcher, out: str, checkpoint: str):
        return review_stream(read_events(self.spark, folder), diffs, self.settings.webhook_secret, out, checkpoint)
