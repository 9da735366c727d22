"""Standard errors: analytic / bootstrap dispatch (AGG20) and the bootstrap (AGG21).

Items that a metric can't tell apart are one cell: equal values of a mean or perplexity, equal
(gold, predicted) of F1 and MCC.  A replicate needs the count of each cell only.  With
Poisson(1) weights per item (the large-n limit of resampling with replacement) the count of a
cell of n items is Poisson(n), drawn whole: a uniform from a hash of (seed, replicate, cell)
falls into one interval of the cell's cumulative distribution.  So the work is cells x
replicates, however many items there are; the intervals of a cell are about 18 standard
deviations wide, which holds every value that the uniforms can reach.  Uniforms and intervals
meet in an equi-join on slices of [0, 1).

The positional median of a resample is one item drawn at random: a uniform position per
replicate joins the numbered items.

BLEU and chrF are functions of sums of per-sentence counts.  Each task multiplies the weights
of its sentences with their count vectors, block by block, and sends one partial sum per
replicate and group.

Everything is a function of (seed, replicate, cell or item): independent of partitioning and
retries, and the same in any SQL engine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from ..session import equi_join, materialize
from .metrics import _keys, acc_all, mean_stderr
from .sampling import dense_index
from .textmetrics import BLEU_ORDER, CHRF_ORDER, bleu_counts, bleu_score, chrf_counts, chrf_score

# Replicate counts used by the reference (text metrics use fewer).
DEFAULT_ITERS = 100000
TEXT_METRIC_ITERS = 1000

SLICES = 256                 # slices of [0, 1) in which uniforms and intervals meet
BLOCK = 1000                 # replicates exploded by one row
PRIME = 2147483647           # 2^31 - 1: products of two residues fit in 64 bits

# Poisson(1) cumulative probabilities P(K <= k), from the formula e^-1 sum 1/j!, until no
# residue of PRIME reaches beyond.
POISSON1_CDF = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(14)]

# Coefficients of Stirling's series for log k!, k >= 10, and the exact values below.
LOG_FACTORIALS = [math.log(math.factorial(k)) for k in range(10)]


def uniform_from_hash(*parts) -> Column:
    """u in [0, 1) from the first 8 hex digits of md5('p1:p2:…'); ints are literals."""
    items = []
    for i, p in enumerate(parts):
        if i:
            items.append(F.lit(":"))
        items.append(F.lit(str(p)) if isinstance(p, int) else col(p).cast("string"))
    h = F.md5(F.concat(*items))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def log_factorial(k: Column) -> Column:
    """log k! of whole doubles."""
    x = F.greatest(k, F.lit(1.0))
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    out = F.when(k >= 10, series)
    for i, v in enumerate(LOG_FACTORIALS):
        out = out.when(k == i, F.lit(v))
    return out


def poisson_intervals(cells: DataFrame) -> DataFrame:
    """(cell_id, k, low, high, slice) for cells (cell_id, n): a uniform u with low <= u < high is
    the count k; an interval has a row for each slice of [0, 1) that it touches."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    width = F.ceil(9 * F.sqrt(n)) + 40
    each = cells.select("cell_id", "n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - width), F.col("n") + width)).alias("k"))
    p = each.withColumn("p", F.exp(k * F.log(n) - n - log_factorial(k)))
    upto = Window.partitionBy("cell_id").orderBy("k")
    cdf = p.withColumn("c", F.sum("p").over(upto.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("p").over(Window.partitionBy("cell_id")))
    cut = (cdf.withColumn("low", F.lag("c", 1, 0.0).over(upto)).withColumn("high", F.when(F.lead("c").over(upto).isNull(), F.lit(2.0)).otherwise(F.col("c")))
           .filter("high > low and low < 1"))
    first, last = F.floor(F.col("low") * SLICES), F.least(F.floor(F.col("high") * SLICES), F.lit(SLICES - 1))
    return cut.select("cell_id", "k", "low", "high", F.explode(F.sequence(first, last)).alias("slice"))


def replicates(rows: DataFrame, iters: int) -> DataFrame:
    """Every row once per replicate, dealt out in blocks."""
    spark = rows.sparkSession
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(iters - 1), F.lit(BLOCK))))
    blocks = blocks.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    last = F.least(F.col("_block") + BLOCK, F.lit(iters)) - 1
    return blocks.withColumn("replicate", F.explode(F.sequence("_block", last))).drop("_block")


def cell_draws(df: DataFrame, ks: list[str], cell: list[str], iters: int, seed: int) -> DataFrame:
    """(keys, cell columns, replicate, w): the count of each cell in each replicate, zeros left out."""
    counts = df.groupBy(*ks, *cell).agg(F.count(F.lit(1)).alias("n"))
    cells = materialize(dense_index(counts, ks, [F.col(c) for c in cell], "_cell").withColumn("cell_id", F.monotonically_increasing_id()))
    u = uniform_from_hash(seed, F.col("replicate"), F.col("_cell"))
    drawn = replicates(cells.drop("n"), iters).withColumn("u", u).withColumn("slice", F.floor(F.col("u") * SLICES)).drop("_cell")
    # The planner takes exploded rows for as few as their blocks: never to be broadcast.
    met = drawn.join(poisson_intervals(cells.select("cell_id", "n")).hint("shuffle_hash"), ["cell_id", "slice"]).filter("u >= low and u < high and k > 0")
    return met.select(*ks, *cell, "replicate", F.col("k").alias("w"))


def bootstrap_stderr(df: DataFrame, keys, kind, iters: int = DEFAULT_ITERS, seed: int = 1234, id_col: str = "doc_id",
                     value: str | None = None, gold: str | None = None, pred: str | None = None) -> DataFrame:
    """AGG21: bootstrap standard error of a metric per group, (keys, stderr, replicates).

    kind: ``mean`` / ``perplexity`` (of ``value``), ``median`` (the item at position n // 2 of a
    resample; ``id_col`` numbers the items), ``f1`` (binary F1 of gold/pred, positive = 1) or
    ``mcc`` (binary Matthews correlation); a tuple of kinds over the same cells shares the draws
    and gives one ``stderr_<kind>`` each.  Replicates without an item are left out; null
    values are no items; one replicate has no error (null)."""
    ks, kinds = _keys(keys), (kind,) if isinstance(kind, str) else tuple(kind)
    if set(kinds) <= {"mean", "perplexity"}:
        items = df.select(*ks, col(value).cast("double").alias("_v")).filter("_v is not null")
        draws = cell_draws(items, ks, ["_v"], iters, seed)
        rep = draws.groupBy(*ks, "replicate").agg((F.sum(F.col("w") * F.col("_v")) / F.sum("w")).alias("mean"))
        metrics = {"mean": F.col("mean"), "perplexity": F.exp(-F.col("mean"))}
    elif set(kinds) == {"median"}:
        items = dense_index(df.select(*ks, col(id_col).alias("_id"), col(value).cast("double").alias("_v")).filter("_v is not null"), ks, [F.col("_id"), F.col("_v")], "_at")
        sizes = items.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"))
        at = F.floor(uniform_from_hash(seed, F.col("replicate")) * F.col("_n")).cast("bigint")
        rep = equi_join(replicates(sizes, iters).withColumn("_at", at).hint("merge"), items, [*ks, "_at"])
        metrics = {"median": F.col("_v")}
    elif set(kinds) <= {"f1", "mcc"}:
        items = df.select(*ks, (col(gold) == 1).alias("_g"), (col(pred) == 1).alias("_p")).filter("_g is not null and _p is not null")
        draws = cell_draws(items, ks, ["_g", "_p"], iters, seed)
        s = lambda g, p: F.sum(F.when((F.col("_g") == g) & (F.col("_p") == p), F.col("w")).otherwise(0)).cast("double")
        rep = draws.groupBy(*ks, "replicate").agg(s(True, True).alias("tp"), s(False, True).alias("fp"), s(True, False).alias("fn"), s(False, False).alias("tn"))
        tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
        margins = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        metrics = {"f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), "mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, margins), F.lit(0.0))}
    else:
        raise ValueError(kind)
    names = ["stderr"] if isinstance(kind, str) else [f"stderr_{k}" for k in kinds]
    return rep.groupBy(*ks).agg(*[F.stddev_samp(metrics[k]).alias(n) for k, n in zip(kinds, names)], F.count(F.lit(1)).alias("replicates"))


# ------------------------------------------------------------------ text metrics

def residue(*parts) -> Column:
    """A residue of PRIME from the first 8 hex digits of md5('p1:p2:…')."""
    items = [x for i, p in enumerate(parts) for x in ([F.lit(":")] if i else []) + [F.lit(str(p)) if isinstance(p, int) else col(p).cast("string")]]
    return F.pmod(F.conv(F.substring(F.md5(F.concat(*items)), 1, 8), 16, 10).cast("bigint"), F.lit(PRIME))


def sentence_weights(item: np.ndarray, replicate: np.ndarray) -> np.ndarray:
    """Poisson(1) weights (sentence, replicate): x = item * replicate + item mod PRIME, u = x^5
    mod PRIME (a permutation of the residues), inverted."""
    x = (item[:, None] * replicate[None, :] + item[:, None]) % PRIME
    square = x * x % PRIME
    return np.searchsorted(np.array(POISSON1_CDF), (square * square % PRIME) * x % PRIME / PRIME, side="right").astype(np.float64)


def text_bootstrap(df: DataFrame, keys, metric: str, hyp: str, refs: str, id_col: str, iters: int = TEXT_METRIC_ITERS, seed: int = 1234) -> DataFrame:
    """AGG20: bootstrap standard error of corpus BLEU (``refs``: array of references) or chrF (one
    reference) per group, (keys, stderr, replicates)."""
    ks = _keys(keys)
    if metric not in ("bleu", "chrf"):
        raise ValueError(metric)
    rows, names = (bleu_counts if metric == "bleu" else chrf_counts)(df, [*ks, id_col], hyp, refs)
    # Keys travel as one number each; the few groups are told apart again by a join.
    groups = materialize(df.select(*ks).distinct().withColumn("_group", F.monotonically_increasing_id()))
    numbered = equi_join(rows, groups, ks) if ks else rows.withColumn("_group", F.lit(0).cast("bigint"))
    draws = df.sparkSession.range(iters).select(residue(seed, F.col("id")).alias("r")).orderBy("id").toArrow()    # one number a replicate
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(draws.column(0).combine_chunks()).astype(np.int64))
    ddl = "_group bigint, replicate bigint, sums array<double>"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                group, item = (np.asarray(part.column(i)).astype(np.int64) for i in range(2))
                counts = np.stack([np.asarray(part.column(i)).astype(np.float64) for i in range(2, part.num_columns)], axis=1)
                weights = sentence_weights(item, shared.value)
                for g in np.unique(group):
                    here = group == g
                    sums[g] = sums.get(g, 0.0) + weights[here].T @ counts[here]
        for g, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), g)), pa.array(np.arange(len(s))), pa.array(list(s), pa.list_(pa.float64()))], names=["_group", "replicate", "sums"])

    partial = numbered.select("_group", residue(seed, F.lit("s"), id_col).alias("_item"), *[F.col(c).cast("double") for c in names]).mapInArrow(multiply, ddl)
    total = partial.groupBy("_group", "replicate").agg(*[F.sum(F.get("sums", i)).alias(c) for i, c in enumerate(names)])
    score = (bleu_score if metric == "bleu" else chrf_score)(total).alias("m")
    out = total.select("_group", score).groupBy("_group").agg(F.stddev_samp("m").alias("stderr"), F.count(F.lit(1)).alias("replicates"))
    return out.join(groups, "_group").select(*ks, "stderr", "replicates") if ks else out.select("stderr", "replicates")


# AGG20: which error each metric gets.
STDERR_RULE = {"mean": "analytic", "acc": "analytic", "acc_all": "analytic_acc_all", "median": "bootstrap",
               "mcc": "bootstrap", "f1": "bootstrap", "perplexity": "bootstrap", "bleu": "bootstrap_text",
               "chrf": "bootstrap_text", "ter": "bootstrap_text"}


def metric_stderr(df: DataFrame, keys, metric: str, iters: int = DEFAULT_ITERS, **kw) -> DataFrame | None:
    """AGG20: analytic error for means and acc_all, bootstrap for median / MCC / binary
    F1 / perplexity and, with ``TEXT_METRIC_ITERS`` replicates at most, BLEU / chrF; None
    for metrics without an error (e.g. task-level macro F1)."""
    rule = STDERR_RULE.get(metric)
    if rule is None:
        return None
    if rule == "analytic":
        return mean_stderr(df, keys, kw["value"]).select(*_keys(keys), "stderr")
    if rule == "analytic_acc_all":
        return acc_all(df, keys, kw["paragraph"], kw["question"], kw["correct"]).select(
            *_keys(keys), F.col("acc_all_stderr").alias("stderr"))
    if rule == "bootstrap_text":
        return text_bootstrap(df, keys, metric, iters=min(iters, TEXT_METRIC_ITERS), **kw)
    return bootstrap_stderr(df, keys, metric, iters, **kw)
