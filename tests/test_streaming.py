"""Streams vs their batch twins (availableNow trigger on the driver's events table)."""

import os
import shutil

from pyspark.sql import functions as F

from sparkeval.operators.requests import request_hash
from sparkeval.streaming import jobs as J

EVENTS = "/root/testdata/sf0.001/events.parquet"


def _events_dir(tmp_dir):
    d = os.path.join(tmp_dir, "events_in")
    os.makedirs(d)
    shutil.copy(EVENTS, os.path.join(d, "part-0.parquet"))
    return d


def _telemetry(df):
    return df.select(F.col("user_id").alias("run_id"), "ts", (F.col("value") / 100).alias("rss_gb"),
                     F.when(F.col("event_type") == "error", 0.0).otherwise(30.0 + F.col("event_id") % 50).alias("temp_c"))


def test_telemetry_stream_equals_batch(spark, tmp_dir):
    src = _events_dir(tmp_dir)
    schema = spark.read.parquet(EVENTS).schema
    stream = _telemetry(spark.readStream.schema(schema).parquet(src))
    q = J.to_memory(J.telemetry_windows(stream), "tw_stream", mode="complete",
                    checkpoint=os.path.join(tmp_dir, "ck1"))
    q.awaitTermination()
    got = spark.sql("SELECT * FROM tw_stream")
    want = J.telemetry_windows(_telemetry(spark.read.parquet(EVENTS)))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_dedupe_stream_equals_batch(spark, tmp_dir):
    src = _events_dir(tmp_dir)
    schema = spark.read.parquet(EVENTS).schema
    s = spark.readStream.schema(schema).parquet(src).withColumn("request_hash", request_hash("event_type", "user_id"))
    q = J.to_memory(J.dedupe_stream(s, watermark="3650 days").select("request_hash"), "dd_stream",
                    checkpoint=os.path.join(tmp_dir, "ck2"))
    q.awaitTermination()
    got = spark.sql("SELECT * FROM dd_stream")
    b = spark.read.parquet(EVENTS).withColumn("request_hash", request_hash("event_type", "user_id"))
    want = J.dedupe_stream(b).select("request_hash")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_score_stream_foreach_batch_resumes(spark, tmp_dir):
    src = _events_dir(tmp_dir)
    schema = spark.read.parquet(EVENTS).schema
    gold = spark.read.parquet(EVENTS).select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("gold"))
    resp = (spark.readStream.schema(schema).parquet(src)
                 .select(F.col("event_id").alias("doc_id"),
                         F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("event_type")).alias("pred")))
    out = os.path.join(tmp_dir, "scores")
    ck = os.path.join(tmp_dir, "ck3")
    J.append_batches(J.score_against_gold(resp, gold), out, "scores", checkpoint=ck).awaitTermination()
    J.append_batches(J.score_against_gold(resp, gold), out, "scores2", checkpoint=ck).awaitTermination()  # restart: no new data
    res = spark.read.parquet(out)
    n = spark.read.parquet(EVENTS).count()
    assert res.count() == n
    assert abs(res.agg(F.avg("correct")).first()[0] - (1 - spark.read.parquet(EVENTS).filter("event_id % 3 = 0").count() / n)) < 1e-9


def test_two_streams_append_to_one_table(spark, tmp_dir):
    """A second stream, or a new checkpoint, never overwrites stored rows."""
    src = _events_dir(tmp_dir)
    schema = spark.read.parquet(EVENTS).schema
    n = spark.read.parquet(EVENTS).count()
    out = os.path.join(tmp_dir, "two")
    for ck in ("ckA", "ckB", "ckB"):
        J.append_batches(spark.readStream.schema(schema).parquet(src), out, "s_" + ck, checkpoint=os.path.join(tmp_dir, ck)).awaitTermination()
    assert spark.read.parquet(out).count() == 2 * n
