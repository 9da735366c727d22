"""Sampling / few-shot / windowing properties."""

from pyspark.sql import functions as F

from sparkeval.operators import requests as RQ
from sparkeval.operators import sampling as SM


def test_dense_index_contiguous(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.col("id"))
    d = SM.dense_index(df, "g", [F.col("id").desc()], "pos", num_partitions=7)
    per = d.groupBy("g").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"),
                             F.countDistinct("pos").alias("nd")).collect()
    for r in per:
        assert r["lo"] == 0 and r["hi"] == r["n"] - 1 and r["nd"] == r["n"]
    top = d.filter("pos = 0").select("g", "id").collect()
    assert {r["g"]: r["id"] for r in top} == {0: 4998, 1: 4999, 2: 4997}


def test_fewshot_random_distinct_not_self(spark):
    pool = spark.range(0, 200).select(F.lit("t").alias("task"), F.col("id").alias("doc_id"))
    shots = SM.fewshot_random(pool, pool, 5, exclude_self=True)
    agg = shots.groupBy("eval_id").agg(F.count("*").alias("n"), F.countDistinct("cand_id").alias("nd"),
                                       F.sum((F.col("cand_id") == F.col("eval_id")).cast("int")).alias("self"))
    assert agg.filter("n <> 5 OR nd <> 5 OR self > 0").count() == 0
    again = SM.fewshot_random(pool, pool, 5, exclude_self=True)
    assert shots.exceptAll(again).count() == 0          # deterministic


def test_rolling_windows_cover_each_token_once(spark):
    df = spark.createDataFrame([(n,) for n in [1, 5, 64, 65, 100, 500]], "n long")
    w = df.select("n", F.explode(RQ.rolling_windows(F.col("n"), 64, 16)).alias("x")).select("n", "x.*").collect()
    for n in [1, 5, 64, 65, 100, 500]:
        cover = []
        for r in [r for r in w if r["n"] == n]:
            cover += list(range(r["pred_start"], r["pred_start"] + r["pred_len"]))
            assert r["ctx_len"] <= 64
        assert sorted(cover) == list(range(n))


def test_sample_per_dataset_k_and_keep_all(spark):
    df = spark.range(0, 300).select((F.col("id") % 3).cast("string").alias("ds"), F.col("id"))
    out = SM.sample_per_dataset(df, "ds", "id", 4, overrides={"0": 0, "1": 2})
    counts = {r["ds"]: r["count"] for r in out.groupBy("ds").count().collect()}
    assert counts == {"0": 100, "1": 2, "2": 4}


def test_distributed_cumsum(spark):
    df = spark.range(0, 3000).select((F.col("id") % 2).alias("g"), F.col("id"))
    c = SM.distributed_cumsum(df, "g", [F.col("id")], F.lit(1), "c", num_partitions=5)
    assert c.filter("c <> floor(id / 2) + 1").count() == 0


def test_fewshot_fixed_never_takes_the_row_itself(spark):
    rows = spark.range(0, 40).select(F.lit("t").alias("task"), F.col("id").alias("doc_id"), (F.col("id") % 2).alias("c"))
    for opts in ({}, {"balance": "c", "n_classes": 2}):
        shots = SM.fewshot_fixed(rows, rows, 4, **opts)
        assert shots.filter("cand_id = eval_id").count() == 0
        assert {r["count"] for r in shots.groupBy("eval_id").count().collect()} == {4}


def test_fewshot_random_draws_are_independent(spark):
    """Rows that share their first shot don't share the second as well."""
    pool = spark.range(0, 300).select(F.lit("t").alias("task"), F.col("id").alias("doc_id"))
    by = {}
    for r in SM.fewshot_random(pool, pool, 2).collect():
        by.setdefault(r["eval_id"], {})[r["shot"]] = r["cand_id"]
    pairs = {(v[0], v[1]) for v in by.values()}
    assert len(pairs) > 290 and len({b - a for a, b in pairs}) > 100
    small = pool.filter("doc_id < 3")
    assert {r["count"] for r in SM.fewshot_random(small, small, 3).groupBy("eval_id").count().collect()} == {3}


def test_null_group_keys_stay(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "g string, v int")
    assert sorted(r["pos"] for r in SM.dense_index(df, "g", [F.col("v")], "pos").collect()) == [0, 0, 1]
    assert sorted(r["c"] for r in SM.distributed_cumsum(df, "g", [F.col("v")], F.col("v"), "c").collect()) == [1, 2, 4]


def test_request_hash_and_cache(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert len({r[0] for r in df.select(RQ.request_hash("x", "y", "z")).collect()}) == 2
    cache = spark.createDataFrame([("k", "r2"), ("k", "r1")], "request_hash string, response string")
    got = RQ.cache_hits(spark.createDataFrame([("k",)], "request_hash string"), cache).collect()
    assert [r["response"] for r in got] == ["r1"]
    uniq = spark.createDataFrame([("k", "r")], "request_hash string, response string")
    back = RQ.scatter_responses(spark.createDataFrame([("k", 1), ("k", 2), ("l", 3)], "request_hash string, i int"), uniq).collect()
    assert sorted((r["i"], r["response"]) for r in back) == [(1, "r"), (2, "r"), (3, None)]


def test_fewshot_context_both_plans_agree(spark):
    rows = spark.range(0, 30).select(F.lit("t").alias("task"), F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
                                     F.concat(F.lit(" g"), F.col("id").cast("string")).alias("target"))
    shots = SM.fewshot_fixed(rows, rows, 3)
    evals = rows.select("task", F.col("doc_id").alias("eval_id"), "text")
    small = SM.fewshot_context(shots, rows, evals).collect()
    large = SM.fewshot_context(shots, rows, evals, max_bytes=0).collect()
    assert sorted(small) == sorted(large) and len(small) == 30
    assert all(r["prompt"].count("###") == 3 and r["prompt"].endswith(f"Exemplo 4:\ntext {r['eval_id']}") for r in small)
