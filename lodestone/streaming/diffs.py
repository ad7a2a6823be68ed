"""Diffs of pull requests by their URLs: a session for each partition, requests side by side, failures as rows."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPT = "application/vnd.github.v3.diff"  # fixed value
TIMEOUT_S = 10.0
SIMULATED = "+# simulated change\n+def simulated():\n+    return None\n"
FETCHED = "diff_url string, diff string, fetch_error string"


class UrlSession:
    """Requests by the standard library."""

    def get(self, url: str, headers: dict[str, str], timeout: float) -> tuple[int, str]:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as got:
                return got.status, got.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, ""

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Fetcher:
    """How diffs are fetched. `session` makes an object with get(url, headers, timeout), which gives status and text, and
    close(); it is called once for each partition. Without a token nothing is asked and a stated simulation stands in."""

    token: str = ""
    session: Callable = UrlSession
    timeout: float = TIMEOUT_S
    at_once: int = 8

    def _one(self, session, url: str) -> tuple[str, str, str | None]:
        try:
            status, text = session.get(url, {"Authorization": f"token {self.token}", "Accept": ACCEPT}, self.timeout)
        except Exception as e:  # whatever a session raises is a row, so that one URL does not end a batch
            return url, f"+# The diff could not be fetched: {type(e).__name__}: {e}\n".replace("\n", " ").strip() + "\n", f"{type(e).__name__}: {e}"
        return (url, text, None) if status == 200 else (url, f"+# The diff could not be fetched: HTTP {status}\n", f"HTTP {status}")

    def fetch(self, urls: DataFrame) -> DataFrame:
        """(diff_url, diff, fetch_error) of each distinct URL, asked once. A failure's diff is a comment that says why."""
        asked = urls.select("diff_url").where("diff_url IS NOT NULL AND diff_url <> ''").distinct()
        if not self.token:
            return asked.select("diff_url", F.lit(SIMULATED).alias("diff"), F.lit(None).cast("string").alias("fetch_error"))
        import pyarrow as pa

        def run(batches):
            session = None
            try:
                with ThreadPoolExecutor(self.at_once) as pool:
                    for batch in batches:
                        session = session or self.session()
                        rows = list(pool.map(lambda u: self._one(session, u), batch.column("diff_url").to_pylist()))
                        columns = list(zip(*rows)) or [(), (), ()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["diff_url", "diff", "fetch_error"])
            finally:
                if session is not None:
                    session.close()

        return asked.mapInArrow(run, FETCHED)

    def add(self, rows: DataFrame) -> DataFrame:
        """`rows` with diff and fetch_error; a row without a URL has neither."""
        return rows.join(self.fetch(rows), "diff_url", "left")
