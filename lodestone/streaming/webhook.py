"""Pull-request events as a stream of JSON files: signature check, filter, one review for each delivery, batch by batch.

A sender that gets no answer in time sends an event again. Deliveries are told apart by their id, or, where a sender
states none, by what they hold; the state of the ones seen lies in the query's checkpoint and goes after `late`."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.lineage import cut
from lodestone.functions.stage_log import StageLog, observed, tally
from lodestone.operators.review import review
from lodestone.streaming.diffs import SIMULATED, Fetcher

EVENT = "event_type string, signature string, body string, delivery string, received_at timestamp"
BODY = "action string, number int, pull_request struct<diff_url:string,url:string>, repository struct<full_name:string>"
ACTIONS = ("opened", "synchronize", "reopened")  # fixed values


def signed(body: str, signature: str | None, secret: str) -> bool:
    """Whether the signature header belongs to the body."""
    if not signature or not signature.startswith("sha256="):
        return False
    own = hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
    return hmac.compare_digest(own, signature[7:])


def verified(events: DataFrame, secret: str) -> DataFrame:
    """Adds `authentic`."""
    @F.pandas_udf("boolean")
    def check(body: pd.Series, signature: pd.Series) -> pd.Series:
        return pd.Series([signed(b or "", s, secret) for b, s in zip(body, signature)])

    return events.withColumn("authentic", check("body", "signature"))


def wanted(event_type: Column, action: Column, diff_url: Column) -> Column:
    """Whether an event asks for a review."""
    return F.coalesce((event_type == "pull_request") & action.isin(*ACTIONS) & (F.coalesce(diff_url, F.lit("")) != ""), F.lit(False))


def parsed(events: DataFrame) -> DataFrame:
    rows = events.withColumn("e", F.from_json("body", BODY))
    url = F.coalesce("e.pull_request.diff_url", F.lit(""))
    return rows.select("*", F.col("e.action").alias("action"), F.col("e.number").alias("number"), F.col("e.repository.full_name").alias("repository"), url.alias("diff_url")).drop("e").withColumn("wanted", wanted(F.col("event_type"), F.col("action"), F.col("diff_url")))


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(folder)


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each delivery once, however often and in however many batches or runs it comes within `late` of its first time. A
    forged copy has another signature and so never stands in for the true event. Events without a time of receipt have
    that of their batch."""
    held = F.sha2(F.concat_ws("\n", "event_type", "signature", "body"), 256)
    rows = events.withColumns({"delivery_key": F.concat_ws(":", F.coalesce("delivery", F.lit("")), held), "received_at": F.coalesce("received_at", F.current_timestamp())})
    return rows.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["delivery_key"]).drop("delivery_key")


def review_stream(events: DataFrame, diffs: DataFrame | Fetcher, secret: str, out: str, checkpoint: str, graph_edges: DataFrame | None = None, late: str = "1 day"):
    """Starts a query that reviews each wanted, authentic event once; its diff is fetched, or looked up by diff_url
    in a table, where a stated simulation stands in for one that is missing. Batches are written to folders by number, so a batch that runs again
    replaces itself; rejected and ignored events are kept beside the reviews, and a log of each batch's stages."""

    def run(batch: DataFrame, number: int) -> None:
        log = StageLog(batch.sparkSession, f"batch-{number}")
        kept = batch.persist()  # two tables are written from it; its state and counts are those of one run
        rows = verified(parsed(kept), secret)
        rows.where(~F.col("authentic") | ~F.col("wanted")).write.mode("overwrite").parquet(f"{out}/ignored/batch={number}")
        asked = rows.where("authentic AND wanted")
        if isinstance(diffs, Fetcher):
            asked = cut(diffs.add(asked))  # a URL is asked once a batch, whatever reads the table
        else:
            asked = asked.join(diffs.select("diff_url", "diff"), "diff_url", "left").withColumn("diff", F.coalesce("diff", F.lit(SIMULATED)))
        review(asked, "diff", graph_edges, log).write.mode("overwrite").parquet(f"{out}/reviews/batch={number}")
        log.rows().drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{out}/log/batch={number}")
        kept.unpersist()

    seen = observed(once(observed(events, "received", {}), late), "delivered", tally(F.col("event_type"), ["pull_request"], "event_type"))
    return seen.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window, batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "events", "total")
