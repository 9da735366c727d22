"""The bootstrap on cells against plain resampling with replacement."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeval.operators import bootstrap as BS
from sparkeval.operators import textmetrics as TM


def resampled(items, metric, iters, seed=5):
    rng = random.Random(seed)
    return statistics.stdev(metric(rng.choices(items, k=len(items))) for _ in range(iters))


def f1(pairs):
    tp, fp, fn = (sum((g == 1) == a and (p == 1) == b for g, p in pairs) for a, b in ((True, True), (False, True), (True, False)))
    return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0


def mcc(pairs):
    tp, fp, fn, tn = (sum((g == 1) == a and (p == 1) == b for g, p in pairs) for a, b in ((True, True), (False, True), (True, False), (False, False)))
    den = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return (tp * tn - fp * fn) / den if den else 0.0


def test_poisson_counts_have_the_right_distribution(spark):
    """Cells of 1 item and of many: mean and variance n, no count cut off, every replicate drawn."""
    n = {0: 1, 1: 7, 2: 300, 3: 20_000}
    df = spark.createDataFrame([(float(v), c) for v, c in n.items()], "v double, c int").select("v", F.explode(F.sequence(F.lit(1), "c")))
    got = BS.cell_draws(df.withColumn("t", F.lit("x")), ["t"], ["v"], 40_000, 3).groupBy("v").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"), F.max("w").alias("m"))
    for r in got.collect():
        lam = n[int(r.v)]
        mean, second = r.s / 40_000, r.q / 40_000
        assert abs(mean - lam) < 5 * math.sqrt(lam / 40_000)
        assert abs(second - mean * mean - lam) < 0.05 * lam + 0.02
        assert r.m > lam + 3 * math.sqrt(lam)


def test_errors_equal_plain_resampling(spark):
    rng = random.Random(8)
    rows = []
    for task, n, right in (("a", 400, 0.8), ("b", 150, 0.6), (None, 60, 0.9)):
        for i in range(n):
            gold = int(rng.random() < 0.4)
            rows.append((task, i, gold, gold if rng.random() < right else 1 - gold, float(-rng.randrange(1, 6))))
    df = spark.createDataFrame(rows + [("a", 9999, None, 1, None)], "task string, doc_id long, gold int, pred int, v double")
    pairs = {r.task: r for r in BS.bootstrap_stderr(df, "task", ("f1", "mcc"), 4000, gold="gold", pred="pred").collect()}
    values = {r.task: r for r in BS.bootstrap_stderr(df, "task", ("mean", "perplexity"), 4000, value="v").collect()}
    median = {r.task: r for r in BS.bootstrap_stderr(df, "task", "median", 4000, value="v").collect()}
    assert set(pairs) == set(values) == set(median) == {"a", "b", None}
    for task in pairs:
        some = [(g, p) for t, _, g, p, _ in rows if t == task]
        vs = [v for t, _, _, _, v in rows if t == task]
        for got, items, metric in ((pairs[task].stderr_f1, some, f1), (pairs[task].stderr_mcc, some, mcc), (values[task].stderr_mean, vs, statistics.mean),
                                   (values[task].stderr_perplexity, vs, lambda x: math.exp(-sum(x) / len(x))), (median[task].stderr, vs, lambda x: x[len(x) // 2])):
            want = resampled(items, metric, 1500)
            assert abs(got - want) < 0.12 * want, (task, got, want)
        assert median[task].replicates == 4000


def test_no_items_and_unknown_kinds(spark):
    none = spark.createDataFrame([], "task string, doc_id long, v double, gold int, pred int")
    assert BS.bootstrap_stderr(none, "task", "mean", 50, value="v").count() == 0
    assert BS.bootstrap_stderr(none, "task", "median", 50, value="v").count() == 0
    with pytest.raises(ValueError):
        BS.bootstrap_stderr(none, "task", ("mean", "f1"), 50, value="v")
    with pytest.raises(ValueError):
        BS.text_bootstrap(none, "task", "ter", "v", "v", "doc_id")


def test_sentence_weights_are_poisson_of_one():
    rng = np.random.default_rng(4)
    w = BS.sentence_weights(rng.integers(0, BS.PRIME, 300), rng.integers(0, BS.PRIME, 2000))
    share = np.bincount(w.astype(int).ravel(), minlength=6)[:6] / w.size
    assert np.allclose(share, [math.exp(-1) / math.factorial(k) for k in range(6)], atol=0.003)
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.1 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2
    assert np.array_equal(BS.sentence_weights(np.array([BS.PRIME - 1]), np.array([BS.PRIME - 1])), BS.sentence_weights(np.array([BS.PRIME - 1]), np.array([BS.PRIME - 1])))


@pytest.mark.parametrize("metric", ["bleu", "chrf"])
def test_text_errors_equal_plain_resampling(spark, metric):
    rng = random.Random(6)
    words = ["the", "a", "house", "tree", "runs", "sees", "of", "red"]
    rows = []
    for i in range(60):
        ref = [rng.choice(words) for _ in range(rng.randrange(4, 14))]
        hyp = [w if rng.random() < 0.8 else rng.choice(words) for w in ref]
        rows.append(("k" if i % 2 else None, i, " ".join(hyp), " ".join(ref)))
    df = spark.createDataFrame(rows, "task string, doc_id long, hyp string, ref string")
    refs = df.withColumn("refs", F.array("ref"))
    got = {r.task: r for r in (BS.text_bootstrap(refs, "task", "bleu", "hyp", "refs", "doc_id") if metric == "bleu" else BS.text_bootstrap(df, "task", "chrf", "hyp", "ref", "doc_id")).collect()}
    counted, names = TM.bleu_counts(refs, ["task"], "hyp", "refs") if metric == "bleu" else TM.chrf_counts(df, ["task"], "hyp", "ref")
    sentences = counted.collect()
    rnd = np.random.default_rng(3)
    for task in ("k", None):
        table = np.array([[r[n] for n in names] for r in sentences if r.task == task], dtype=float)
        sums = [table[rnd.integers(0, len(table), len(table))].sum(axis=0).tolist() for _ in range(1500)]
        frame = spark.createDataFrame(sums, ", ".join(f"{n} double" for n in names))
        want = frame.select((TM.bleu_score(frame) if metric == "bleu" else TM.chrf_score(frame)).alias("m")).agg(F.stddev_samp("m")).first()[0]
        assert got[task].replicates == 1000 and abs(got[task].stderr - want) < 0.15 * want


def test_dispatch_of_all_kinds(spark):
    """aggregate_scores names every kind; text metrics and the median carry their bootstrap errors."""
    from sparkeval.operators import metrics as M
    rng = random.Random(12)
    rows = [("t", i, m, float(i % 4), 1.0, i % 2, int(rng.random() < 0.5), i % 7, i % 3, "the red house is on the hill" if i % 3 else "a tree", ["the red house stood on a hill"])
            for i in range(40) for m in ("bleu", "chrf", "median", "f1_macro", "acc_all")]
    scores = spark.createDataFrame(rows, "task string, doc_id long, metric string, value double, weight double, gold int, pred int, paragraph int, question int, hyp string, refs array<string>")
    kinds = spark.createDataFrame([(m, m) for m in ("bleu", "chrf", "median", "f1_macro", "acc_all")] + [("unused", "unknown kind")], "metric string, kind string")
    got = {r.metric: r for r in M.aggregate_scores(scores, kinds, ("task",), iters=200).collect()}
    one = scores.filter("metric = 'bleu'")
    assert got["bleu"].value == pytest.approx(TM.corpus_bleu(one, "doc_id", "hyp", "refs").first()["bleu"]) and got["bleu"].stderr > 0
    assert got["chrf"].value == pytest.approx(TM.corpus_chrf(one.withColumn("r", F.get("refs", 0)), "doc_id", "hyp", "r").first()["chrf"]) and got["chrf"].stderr > 0
    assert got["median"].value == 0.0 and 0.9 < got["median"].stderr < 1.4 and got["median"].n == 40
    assert got["f1_macro"].stderr is None and 0 < got["f1_macro"].value < 1 and got["acc_all"].stderr is not None
    with pytest.raises(ValueError, match="needs the columns"):
        M.aggregate_scores(scores.drop("hyp"), kinds, ("task",))


def test_exploded_replicates_are_never_broadcast(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0)], "t string, v double")
    draws = BS.cell_draws(df, ["t"], ["v"], 3000, 3)
    assert "ShuffledHashJoin" in draws._jdf.queryExecution().executedPlan().toString()
