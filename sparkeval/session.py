"""Session, table loading and the few execution helpers every operator shares.

Design notes (scale):
* ``checked_broadcast`` is the only place that emits a ``broadcast`` hint for a
  side whose size depends on the data.  It materialises the side once, measures
  rows and bytes, and only hints below the limit; above it the planner keeps a
  shuffle join (with AQE skew handling on).
* ``materialize`` cuts lineage with a reliable ``checkpoint`` into the folder the
  cluster names in ``spark.checkpoint.dir``.  When the session has none (unit
  tests, a laptop) it falls back to ``persist`` — recomputable from lineage if
  an executor is lost.  It never uses ``localCheckpoint``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Default limit for a data-dependent broadcast side (bytes, estimated).
BROADCAST_MAX_BYTES = 256 * 1024 * 1024


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "sparkeval", checkpoint_dir: str | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session used by tests and bench.  On a cluster the submitter's session wins."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    b = (SparkSession.builder.appName(app)
         .master(master or f"local[{cpus}]")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, checkpoint_dir)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Return the session's checkpoint folder; set one only where it is unset and a
    fallback is given (tests / local bench)."""
    try:
        sc = spark.sparkContext
    except Exception:  # sessions without a local SparkContext (e.g. remote clients)
        return spark.conf.get("spark.checkpoint.dir", None)
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if fallback:
        sc.setCheckpointDir(fallback)
        return sc.getCheckpointDir()
    return None


def local_checkpoint_fallback() -> str:
    """A scratch folder for local runs only (tests, bench on one machine)."""
    return tempfile.mkdtemp(prefix="sparkeval-ckpt-", dir="/tmp")


def shared_path(spark: SparkSession, tag: str, ending: str = "") -> str:
    """A fresh path in the folder that driver and executors share, deleted by Hadoop when the
    driver ends.  Without a named folder only a local session has one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        named = ensure_checkpoint_dir(spark, local_checkpoint_fallback())
    path = f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}{ending}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: reliable checkpoint when a checkpoint folder exists, else persist.

    The plan is persisted while the checkpoint is written — otherwise Spark computes it
    twice (once for the eager count, once for the checkpoint files)."""
    spark = df.sparkSession
    if ensure_checkpoint_dir(spark):
        cached = df.persist(StorageLevel.MEMORY_AND_DISK)
        out = cached.checkpoint(eager=True)
        cached.unpersist()
        return out
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def reuse(df: DataFrame) -> DataFrame:
    """Keep a large intermediate that one operator reads several times (memory, spilling
    to local disk).  Lost blocks are recomputed from lineage after an executor loss, so
    nothing is written to shared storage for data that lives for one job."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Guarantee enough tasks for per-row heavy work: a scan with fewer partitions than
    the cluster's parallelism (e.g. one large Parquet row group) is round-robin
    repartitioned; a big input (thousands of splits) is left untouched — no shuffle."""
    spark = df.sparkSession
    try:
        want = min_partitions or spark.sparkContext.defaultParallelism
        conf = spark._jsc.hadoopConfiguration()
        split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
            spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
        size = 0
        for f in df.inputFiles()[:want]:             # a longer list has enough splits
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            size += max(split, p.getFileSystem(conf).getFileStatus(p).getLen())
    except Exception:  # sessions without a local JVM view: leave partitioning to the engine
        return df
    return df.repartition(want) if size < want * split else df


def estimate_size(df: DataFrame) -> tuple[int, int]:
    """(rows, approximate bytes) of a DataFrame, measured with one aggregate."""
    width = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t == "string":
            width.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 8)
        elif t.startswith(("array", "struct", "map")):     # nested values by their text
            width.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)) + 16)
        else:
            width.append(F.lit(8))
    row_bytes = width[0]
    for w in width[1:]:
        row_bytes = row_bytes + w
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes).alias("b")).first()
    return int(r["n"] or 0), int(r["b"] or 0)


def checked_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES,
                      already_materialized: bool = False) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only if its measured size is under ``max_bytes``.

    Returns (side, broadcast?).  The side is kept (persisted) while it is measured, so
    the measurement and the join read it once; a side that fits is broadcast from that
    copy, a larger one is written as a reliable checkpoint and the caller's join stays
    a shuffle join (sort-merge / shuffled-hash, AQE skew split)."""
    side = df if already_materialized else reuse(df)
    _, nbytes = estimate_size(side)
    if nbytes <= max_bytes:
        return F.broadcast(side), True
    if not already_materialized:
        big = materialize(side)
        side.unpersist()
        return big, False
    return side, False


# Tables whose rows carry the per-row heavy work (texts, fact rows).
LARGE_TABLES = {"documents", "pages", "conversations", "lineitem", "orders", "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a driver table; large tables get at least one task per core (``spread``)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in LARGE_TABLES else df


def equi_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null (null equals null, as in GROUP BY); the keys of the
    result are one column each.  ``how``: inner, left, full, left_semi or left_anti."""
    if not keys:                                     # one row on each side
        one = F.lit(1).alias("_one")
        return left.select("*", one).join(right.select("*", one), "_one", how).drop("_one")
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`"))
        cond = c if cond is None else cond & c
    j = left.join(other, cond, how)
    if how in ("left_semi", "left_anti"):
        return j
    if how == "full":
        j = j.withColumns({k: F.coalesce(F.col(f"`{k}`"), F.col(f"`_r_{k}`")) for k in keys})
    return j.drop(*[f"_r_{k}" for k in keys])


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views for the named driver tables (lazy; nothing is read here)."""
    for t in names:
        path = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(path) or "://" in path:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
