"""Structured Streaming jobs (STR01-STR03, SNK06) and their batch twins.

The reference polls telemetry every 0.2 s and keeps running maxima / means, saves
results after every model and skips finished work, and caches repeated requests.  The
same loops as streaming queries:

* ``telemetry_stream`` — event-time windows with a watermark (late rows beyond it are
  dropped by design), or session windows per inference;
* ``score_stream`` — responses stream joined to static gold, scored, appended per
  micro-batch with ``foreachBatch`` (idempotent on the batch id) and a checkpoint, so a
  restarted job resumes where it stopped;
* ``dedupe_stream`` — ``dropDuplicatesWithinWatermark`` on the request hash.

Every transformation is a plain DataFrame function, so the batch twin runs the same
code on a static DataFrame (used by the oracle checks and the tests).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import col
from ..session import ensure_checkpoint_dir


def to_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Driver timestamps are TIMESTAMP_NTZ; watermarks need TIMESTAMP (session time zone)."""
    return df.withColumn(ts, col(ts).cast("timestamp"))


def telemetry_windows(df: DataFrame, ts: str = "ts", run: str = "run_id", window: str = "1 hour",
                      watermark: str | None = "10 minutes") -> DataFrame:
    """STR01: per (run, event-time window): peak RSS, mean temperature, samples."""
    d = to_event_time(df, ts)
    if watermark and d.isStreaming:
        d = d.withWatermark(ts, watermark)
    return (d.groupBy(col(run).alias(run), F.window(ts, window).alias("w"))
             .agg(F.max("rss_gb").alias("rss_peak_gb"), F.avg("temp_c").alias("temp_avg_c"),
                  F.count(F.lit(1)).alias("samples"))
             .select(run, F.unix_timestamp(F.col("w.start")).alias("window_start"), "rss_peak_gb", "temp_avg_c", "samples"))


def telemetry_sessions(df: DataFrame, ts: str = "ts", run: str = "run_id", gap: str = "30 minutes",
                       watermark: str | None = "1 hour") -> DataFrame:
    """STR01 (per inference): samples closer than ``gap`` form one session."""
    d = to_event_time(df, ts)
    if watermark and d.isStreaming:
        d = d.withWatermark(ts, watermark)
    return (d.groupBy(col(run).alias(run), F.session_window(ts, gap).alias("s"))
             .agg(F.count(F.lit(1)).alias("samples"), F.max("rss_gb").alias("rss_peak_gb"))
             .select(run, F.unix_timestamp(F.col("s.start")).alias("session_start"),
                     F.unix_timestamp(F.col("s.end")).alias("session_end"), "samples", "rss_peak_gb"))


def dedupe_stream(df: DataFrame, key: str = "request_hash", ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """STR03: repeated requests inside the watermark are dropped (batch twin: distinct)."""
    d = to_event_time(df, ts)
    if d.isStreaming:
        return d.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])
    return d.dropDuplicates([key])


def score_against_gold(responses: DataFrame, gold: DataFrame, key: str = "doc_id",
                       pred: str = "pred", label: str = "gold") -> DataFrame:
    """STR02 transformation: stream-static join on the item key and per-sample score."""
    return (responses.join(gold, key, "inner")
                     .withColumn("correct", (F.trim(col(pred)) == F.trim(col(label))).cast("double")))


def _checkpoint(spark: SparkSession, name: str, location: str | None) -> str:
    if location:
        return location
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise ValueError("no checkpoint location: pass one or set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/streams/{name}"


def _stream_id(spark: SparkSession, location: str) -> str:
    """The id written in ``location``'s sibling file, made at the first start."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location.rstrip("/") + ".stream_id")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        made = uuid.uuid4().hex
        out = fs.create(path, False)
        out.writeUTF(made)
        out.close()
        return made
    source = fs.open(path)
    found = source.readUTF()
    source.close()
    return found


def append_batches(df: DataFrame, path: str, name: str, checkpoint: str | None = None,
                   trigger: dict | None = None, partition_by: list[str] | None = None) -> StreamingQuery:
    """SNK06 / STR02: append every micro-batch to a Parquet table, once per stream and batch
    id — a retried batch overwrites its own (``stream_id``, ``batch_id``) partition instead
    of appending twice.  ``stream_id`` is kept beside the checkpoint: a restart goes on with
    it, another stream or a new checkpoint gets its own and touches no stored rows."""
    spark = df.sparkSession
    location = _checkpoint(spark, name, checkpoint)
    stream_id = _stream_id(spark, location)

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumns({"stream_id": F.lit(stream_id), "batch_id": F.lit(batch_id)})
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("stream_id", "batch_id", *(partition_by or [])).parquet(path))
    w = df.writeStream.foreachBatch(write).option("checkpointLocation", location)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.queryName(name).start()


def to_memory(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None,
              trigger: dict | None = None) -> StreamingQuery:
    """Run a streaming aggregate into an in-memory table (tests / notebooks)."""
    w = (df.writeStream.format("memory").queryName(name).outputMode(mode)
           .option("checkpointLocation", _checkpoint(df.sparkSession, name, checkpoint)))
    return w.trigger(**(trigger or {"availableNow": True})).start()
