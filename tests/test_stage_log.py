import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import stage_log
from lodestone.operators import review
from lodestone.plans.engine import Engine, Settings


def test_batch_log(spark, tmp_path):
    """Counts of stages come with the action that runs them, are kept, and equal those of the table."""
    diffs = spark.createDataFrame([(1, ""), (2, "+x = eval(y)"), (3, None), (4, "+def f(a):\n+time.sleep(1)")], "pr_id int, diff string").repartition(3)
    log = Engine(spark).log("run-1")
    rows = Engine(spark).review(diffs, log=log)
    rows.write.parquet(f"{tmp_path}/reviews")
    done = spark.read.parquet(f"{tmp_path}/reviews")
    found = log.values()
    assert "diff_text" not in done.columns and list(found) == ["diffs", "security", "architecture", "performance", "testing", "reviews"]
    assert found["diffs"] == {"rows": 4, "characters": 37} and found["architecture"]["verdict=POOR"] == 4
    for status in ("APPROVED", "CHANGES_REQUESTED", "BLOCKED"):
        assert found["reviews"][f"overall_status={status}"] == done.where(F.col("overall_status") == status).count()
    assert found["security"]["findings"] == done.agg(F.sum("security.finding_count")).first()[0] == 1
    log.write(f"{tmp_path}/log")
    log.write(f"{tmp_path}/log")
    kept = stage_log.read(spark, f"{tmp_path}/log")
    assert kept.where("run = 'run-1' AND stage = 'testing' AND metric = 'stubs' AND value = 1").count() == 2
    with pytest.raises(ValueError):
        log.stage("reviews", rows)


def test_log_of_nothing(spark):
    log = stage_log.StageLog(spark)
    review.review(spark.createDataFrame([], "diff string"), log=log).count()
    assert all(v == 0 for metrics in log.values().values() for v in metrics.values())


def events_of(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))


def test_replayed_stream_reviews_once(spark, tmp_path):
    """Redelivered events, in one batch, in a later one and after a restart, with an id and without one."""
    sign = lambda b: "sha256=" + hmac.new(b"s", b.encode(), hashlib.sha256).hexdigest()
    body = lambda n: json.dumps({"action": "opened", "number": n, "pull_request": {"diff_url": f"u{n}"}, "repository": {"full_name": "o/r"}})
    event = lambda n, d=None, s=None: {"event_type": "pull_request", "signature": s or sign(body(n)), "body": body(n), "delivery": d, "received_at": f"2026-01-01T00:0{n}:00Z"}
    diffs = spark.createDataFrame([("u1", "+x = eval(y)")], "diff_url string, diff string")
    engine, listener = Engine(spark, Settings(webhook_secret="s")), stage_log.StreamLog(spark)

    def run():
        q = engine.review_stream(str(tmp_path / "in"), diffs, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert q.awaitTermination(240)
        return sorted(r["number"] for r in spark.read.parquet(f"{tmp_path}/out/reviews").collect())

    events_of(tmp_path, "a", [event(1, "d1"), event(1, "d1"), event(2), event(1, "d1", "sha256=forged")])
    assert run() == [1, 2]
    events_of(tmp_path, "b", [event(1, "d1"), event(2), event(3, "d3"), event(1, "d9")])
    assert run() == [1, 1, 2, 3]  # d9 is a delivery of its own
    log = spark.read.schema("run string, stage string, metric string, value long").parquet(f"{tmp_path}/out/log")
    assert log.where("stage = 'reviews' AND metric = 'rows'").agg(F.sum("value")).first()[0] == 4
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = listener.rows().where("metric = 'rows'").groupBy("stage").agg(F.sum("value")).collect()
    listener.remove()
    assert {r[0]: r[1] for r in seen} == {"received": 8, "delivered": 5}
