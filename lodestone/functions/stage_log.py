"""A log of a plan's stages: counts that Spark gathers while the plan runs, kept as rows beside the results.

`observed` puts named aggregates on a table without another pass over it; they are complete when the action that reads
the table is. In batch an Observation holds them; in a stream every micro-batch reports them, and `StreamLog` takes these
reports. Both become rows of one table (run, stage, metric, value, batch), which `write` appends to a folder."""

from __future__ import annotations

import datetime
import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run string, stage string, metric string, value long, batch long, logged_at timestamp"


def tally(values: Column, known: list[str], name: str) -> dict[str, Column]:
    """A count for each known value of a column, as metrics."""
    return {f"{name}={v}": F.count_if(values == v) for v in known}


def observed(rows: DataFrame, stage: Observation | str, metrics: dict[str, Column]) -> DataFrame:
    """`rows` with aggregates gathered as they pass. A null sum counts as 0."""
    return rows.observe(stage, *[F.coalesce(m.cast("long"), F.lit(0).cast("long")).alias(n) for n, m in ({"rows": F.count(F.lit(1))} | metrics).items()])


class StageLog:
    """The log of one batch run. Stages may be observed in any order and one plan may hold several; each is filled by the
    first action that runs its table, however many tasks or attempts that takes."""

    def __init__(self, spark: SparkSession, run: str | None = None) -> None:
        self.spark, self.run = spark, run or uuid.uuid4().hex
        self.stages: dict[str, Observation] = {}

    def stage(self, name: str, rows: DataFrame, **metrics: Column) -> DataFrame:
        """`rows`, whose number and `metrics` are logged under this name."""
        if name in self.stages:
            raise ValueError(f"stage {name} is logged already")
        self.stages[name] = Observation(f"{name}-{self.run}")
        return observed(rows, self.stages[name], metrics)

    def values(self) -> dict[str, dict[str, int]]:
        """Metrics by stage, in the order in which stages were named. Waits for none: call it after the action."""
        return {name: dict(o.get) for name, o in self.stages.items()}

    def rows(self) -> DataFrame:
        now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        return _table(self.spark, [(self.run, s, m, v, None, now) for s, found in self.values().items() for m, v in found.items()])

    def write(self, folder: str) -> None:
        self.rows().coalesce(1).write.mode("append").parquet(folder)


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A few rows for each stage."""
    return spark.createDataFrame(rows, SCHEMA)


class StreamLog(StreamingQueryListener):
    """Takes what the micro-batches of streams report of stages observed by name, until it is removed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.found = spark, []
        self._lock = threading.Lock()
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        at = datetime.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).replace(tzinfo=None)
        with self._lock:
            self.found += [(str(p.runId), stage, m, v, p.batchId, at) for stage, row in p.observedMetrics.items() for m, v in row.asDict().items()]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self) -> DataFrame:
        with self._lock:
            return _table(self.spark, list(self.found))

    def remove(self) -> None:
        self.spark.streams.removeListener(self)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)
