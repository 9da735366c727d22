"""The skyline against pairwise comparison: one to four metrics, ties, equal rows, nulls, groups."""

import random

import pytest
from pyspark.sql import functions as F

from sparkeval.operators.sampling import distributed_cummax
from sparkeval.operators.skyline import skyline


def brute(rows, up, down):
    def dominates(a, b):
        if a[0] != b[0] or None in a[2:] or None in b[2:]:
            return False
        better = [x - y for x, y in zip(a[2:2 + up], b[2:2 + up])] + [y - x for x, y in zip(a[2 + up:], b[2 + up:])]
        return min(better) >= 0 and max(better) > 0
    return sorted(r[1] for r in rows if not any(dominates(q, r) for q in rows))


@pytest.mark.parametrize("up,down,span", [(1, 0, 9), (1, 1, 12), (2, 1, 6), (2, 1, 400), (2, 2, 8)])
def test_skyline_equals_pairwise_comparison(spark, up, down, span):
    rng = random.Random(up * 10 + down + span)
    rows = [(rng.choice(["a", "b", None]), i, *[rng.randrange(span) if rng.random() > 0.03 else None for _ in range(up + down)]) for i in range(220)]
    rows += [(g, 1000 + i, *rest) for i, (g, _, *rest) in enumerate(rows[:20])]             # equal rows
    if span > 300:                                          # all on the frontier of a group
        rows += [("c", 2000 + i, i, 60 - i, 5) for i in range(60)]
    names = [f"m{i}" for i in range(up + down)]
    df = spark.createDataFrame(rows, "g string, id long, " + ", ".join(f"{n} long" for n in names))
    got = skyline(df, names[:up], names[up:], "g")
    assert got.columns == df.columns
    assert sorted(r.id for r in got.collect()) == brute(rows, up, down)


def test_no_rows_and_no_pairs(spark):
    df = spark.createDataFrame([], "id long, a double, b double, c double")
    assert skyline(df, ["a", "b"], ["c"]).count() == 0
    some = spark.range(50).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 3).alias("c"))
    plan = skyline(some, ["a", "b"], ["c"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_running_maximum_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [("x" if i % 10 else "y", i, rng.randrange(1000) if rng.random() > 0.3 else None) for i in range(500)]
    got = {r.i: r.m for r in distributed_cummax(spark.createDataFrame(rows, "k string, i int, v int"), "k", [F.col("i")], F.col("v"), "m", 7).collect()}
    for k in "xy":
        best = None
        for _, i, v in [r for r in rows if r[0] == k]:
            best = v if best is None else best if v is None else max(best, v)
            assert got[i] == best
