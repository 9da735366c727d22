"""Metric properties against small brute-force computations."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sparkeval.operators import bootstrap as BS
from sparkeval.operators import metrics as M


def _cls(spark, n=400, seed=7):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice("abc"), rnd.randint(0, 2), rnd.randint(0, 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g string, gold int, pred int")


def test_f1_and_mcc_bruteforce(spark):
    rows, df = _cls(spark)
    out = {r["g"]: r for r in M.f1_macro(df, "g", "gold", "pred").join(M.matthews_corr(df, "g", "gold", "pred"), "g").collect()}
    for g in "abc":
        gp = [(r[2], r[3]) for r in rows if r[1] == g]
        labels = sorted({x for x, _ in gp})
        f1s = []
        for lab in labels:
            tp = sum(1 for x, y in gp if x == lab and y == lab)
            f1s.append(2 * tp / (sum(1 for x, _ in gp if x == lab) + sum(1 for _, y in gp if y == lab)))
        assert math.isclose(out[g]["f1_macro"], sum(f1s) / len(f1s), rel_tol=1e-9)
        ks = sorted({x for x, _ in gp} | {y for _, y in gp})
        s, c = len(gp), sum(1 for x, y in gp if x == y)
        t = {k: sum(1 for x, _ in gp if x == k) for k in ks}
        p = {k: sum(1 for _, y in gp if y == k) for k in ks}
        den = math.sqrt((s * s - sum(v * v for v in p.values())) * (s * s - sum(v * v for v in t.values())))
        assert math.isclose(out[g]["mcc"], (c * s - sum(p[k] * t[k] for k in ks)) / den, rel_tol=1e-9)


def test_positional_median_and_percentile(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.random()) for k in "xy" for i in range(rnd.randint(300, 700))]
    df = spark.createDataFrame(rows, "k string, ord long, v double")
    med = {r["k"]: r["median"] for r in M.positional_median(df, "k", "v", "ord").collect()}
    pct = {r["k"]: r["percentile"] for r in M.exact_percentile(df, "k", "v", 0.95).collect()}
    for k in "xy":
        vals = [v for kk, _, v in sorted(rows, key=lambda r: r[1]) if kk == k]
        assert med[k] == vals[len(vals) // 2]
        assert math.isclose(pct[k], float(np.percentile(vals, 95)), rel_tol=1e-12)


def test_bootstrap_close_to_analytic(spark):
    rnd = random.Random(11)
    rows = [(i, "t", float(rnd.random() < 0.3)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, task string, v double")
    boot = BS.bootstrap_stderr(df, "task", "mean", iters=300, value="v").first()["stderr"]
    ana = M.mean_stderr(df, "task", "v").first()["stderr"]
    assert abs(boot - ana) / ana < 0.2


def test_sliced_metrics_grouping_sets(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.0), (3, "b", 1.0)], "id long, exam string, acc double")
    out = {(r["slice"], r["slice_value"]): r["mean"] for r in M.sliced_metrics(df, "acc", ["exam"]).collect()}
    assert out == {("overall", "all"): 2 / 3, ("exam", "a"): 0.5, ("exam", "b"): 1.0}


def test_pareto_frontier(spark):
    from sparkeval.operators.runs import pareto_frontier
    rnd = random.Random(5)
    pts = [(i, rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(0, 30)) for i in range(300)]
    df = spark.createDataFrame(pts, "id long, avg_tps long, quality long, ppl long")

    def dominated(p):
        return any(q[1] >= p[1] and q[2] >= p[2] and q[3] <= p[3] and (q[1] > p[1] or q[2] > p[2] or q[3] < p[3])
                   for q in pts)
    want = sorted(p[0] for p in pts if not dominated(p))
    assert sorted(r["id"] for r in pareto_frontier(df).collect()) == want


def test_exam_years_nulls_and_divisors(spark):
    rows = [("m", f"accuracy_enem_{y}", v) for y, v in ((2021, 0.9), (2022, 0.6), (2023, 0.6), (2024, 0.6))]
    merged = spark.createDataFrame(rows + [("n", "accuracy_enem_2022", 0.6), ("n", "accuracy_bbq_disambig", 0.5)], "model string, metric string, value double")
    got = {r["model"]: r["value"] for r in M.exam_macro(merged).collect()}
    assert abs(got["m"] - 0.675) < 1e-12 and abs(got["n"] - 0.2) < 1e-12
    assert {r["model"]: r["value"] for r in M.bias_score(merged).collect()} == {"m": 0.0, "n": 0.5}
    nulls = spark.createDataFrame([("a", None), (None, 1.0), (None, 3.0)], "k string, v double")
    mean = {r["k"]: (r["mean"], r["stderr"]) for r in M.mean_stderr(nulls, "k", "v").collect()}
    assert mean["a"] == (None, None) and mean[None][0] == 2.0
    pct = {r["k"]: r["percentile"] for r in M.exact_percentile(nulls, "k", "v", 0.5).collect()}
    assert pct == {None: 2.0}
    sl = {(r["slice"], r["slice_value"]): r["n"] for r in M.sliced_metrics(nulls, "v", ["k"]).collect()}
    assert sl == {("overall", "all"): 3, ("k", "a"): 1, ("k", None): 2}
