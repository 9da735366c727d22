"""Corpus BLEU and chrF (AGG11, AGG12) from per-row n-gram overlaps.

A sentence's overlaps are computed inside its row (its hypothesis and references share it);
only the corpus sums are aggregated, partially map-side.  Token rule: whitespace tokens (BLEU),
characters with whitespace removed (chrF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grams import overlaps
from ..functions.text import col
from .metrics import _keys

BLEU_ORDER = 4
CHRF_ORDER = 6
CHRF_BETA = 2.0


def _counted(df: DataFrame, names: list[str], hyp: str, refs: Column, max_n: int, chars: bool, extra=()) -> tuple[DataFrame, list[str]]:
    """(rows with total{n}, correct{n}, ref_total{n} of each sentence and the ``extra`` columns, the
    names of those columns)."""
    rows = df.select(*names, overlaps(hyp, refs, max_n, chars).alias("_x"))
    counts = [F.get("_x.orders", n - 1)[k].alias(f"{k}{n}") for n in range(1, max_n + 1) for k in ("total", "correct", "ref_total")]
    out = rows.select(*names, *extra, *counts)
    return out, out.columns[len(names):]


def bleu_counts(df: DataFrame, names: list[str], hyp: str, refs: str) -> tuple[DataFrame, list[str]]:
    """Per sentence the counts that corpus BLEU sums; c and r are the lengths of the hypothesis
    and of the closest reference (ties -> shorter)."""
    hl = F.col("_x.len")
    closest = F.array_min(F.transform("_x.ref_lens", lambda x: F.struct(F.abs(x - hl).alias("d"), x.alias("l"))))["l"]
    return _counted(df, names, hyp, col(refs), BLEU_ORDER, False, (hl.alias("c"), closest.alias("r")))


def chrf_counts(df: DataFrame, names: list[str], hyp: str, ref: str) -> tuple[DataFrame, list[str]]:
    """Per sentence the counts that corpus chrF sums."""
    return _counted(df, names, hyp, F.array(col(ref)), CHRF_ORDER, True)


def _corpus_totals(rows: DataFrame, ks: list[str], names: list[str]) -> DataFrame:
    return rows.groupBy(*ks).agg(*[F.sum(c).cast("double").alias(c) if c in ("c", "r") else F.sum(c).alias(c) for c in names])


def bleu_score(j: DataFrame) -> Column:
    """BLEU (x100) of corpus sums: brevity penalty and exponential smoothing of zero-match orders."""
    zero_rank = F.lit(0)
    logs = []
    for n in range(1, BLEU_ORDER + 1):
        t = F.coalesce(F.col(f"total{n}"), F.lit(0)).cast("double")
        c = F.coalesce(F.col(f"correct{n}"), F.lit(0)).cast("double")
        zero_rank = zero_rank + F.when((c == 0) & (t > 0), 1).otherwise(0)
        p = F.when(t == 0, F.lit(0.0)).when(c > 0, 100.0 * c / t).otherwise(100.0 / (F.pow(F.lit(2.0), zero_rank) * t))
        logs.append(p)
    any_zero = logs[0] <= 0
    for p in logs[1:]:
        any_zero = any_zero | (p <= 0)
    mean_log = sum(F.log(F.when(p > 0, p).otherwise(F.lit(1.0))) for p in logs) / BLEU_ORDER
    bp = F.when(F.col("c") >= F.col("r"), F.lit(1.0)).when(F.col("c") > 0, F.exp(1 - F.col("r") / F.col("c"))).otherwise(F.lit(0.0))
    return F.when(any_zero, F.lit(0.0)).otherwise(bp * F.exp(mean_log))


def corpus_bleu(df: DataFrame, sid: str, hyp: str, refs: str, keys=()) -> DataFrame:
    """AGG11: corpus BLEU (×100) with clipped counts, brevity penalty from the closest
    reference length (ties -> shorter) and exponential smoothing of zero-match orders."""
    ks = _keys(keys)
    j = _corpus_totals(*_with(bleu_counts(df, ks, hyp, refs), ks))
    return j.select(*ks, bleu_score(j).alias("bleu"), F.col("c").alias("sys_len"), F.col("r").alias("ref_len"))


def _with(counted: tuple[DataFrame, list[str]], ks: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    return counted[0], ks, counted[1]


def chrf_score(j: DataFrame, beta: float = CHRF_BETA) -> Column:
    """chrF (x100) of corpus sums: per order precision / recall, averaged over the effective
    orders, combined with F-beta."""
    eps = 1e-16
    sp, sr, eff = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n in range(1, CHRF_ORDER + 1):
        t, c, rt = (F.coalesce(F.col(f"{k}{n}"), F.lit(0)) for k in ("total", "correct", "ref_total"))
        here = (t > 0) | (rt > 0)                    # an order that no text reaches is left out
        sp = sp + F.when(t > 0, F.try_divide(c, t)).when(here, eps).otherwise(0.0)
        sr = sr + F.when(rt > 0, F.try_divide(c, rt)).when(here, eps).otherwise(0.0)
        eff = eff + ((t > 0) & (rt > 0)).cast("int")
    b2 = beta * beta
    ap, ar = F.try_divide(sp, eff), F.try_divide(sr, eff)
    return F.when(eff == 0, F.lit(0.0)).when(ap + ar > 0, 100.0 * (1 + b2) * ap * ar / (b2 * ap + ar)).otherwise(F.lit(0.0))


def corpus_chrf(df: DataFrame, sid: str, hyp: str, ref: str, keys=(), beta: float = CHRF_BETA) -> DataFrame:
    """AGG12: corpus chrF (×100): character n-grams of orders 1..6 with whitespace
    removed; per order precision / recall from corpus totals, averaged over the
    effective orders, combined with F-beta."""
    ks = _keys(keys)
    j = _corpus_totals(*_with(chrf_counts(df, ks, hyp, ref), ks))
    return j.select(*ks, chrf_score(j, beta).alias("chrf"))
