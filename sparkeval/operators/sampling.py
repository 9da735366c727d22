"""Seeded sampling, shuffles and few-shot example selection (SMP01-SMP10, JN08, FLT11).

Determinism contract: the order of rows is ``md5('<seed>:<id>')`` — identical in Spark
and in SQL engines — so the same subset comes out everywhere (Python's Mersenne
``random`` cannot be reproduced in SQL, and is not the contract).

Scale notes: top-k per group uses ``row_number() <= k`` which Spark plans with a
partial ``WindowGroupLimit`` before the shuffle (only k rows per group and map task
move); per-group positions for random access use ``dense_index`` (range partitioning +
per-partition counts), so no group is ever sorted by a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import col
from ..session import checked_broadcast, equi_join, materialize


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def hash_order(seed, *parts) -> Column:
    """md5 of 'seed:part1:part2…' — the shared deterministic shuffle key."""
    items = [F.lit(str(seed))]
    for p in parts:
        items += [F.lit(":"), col(p).cast("string")]
    return F.md5(F.concat(*items))


def hash_int(seed, *parts) -> Column:
    """First 32 bits of ``hash_order`` as a non-negative integer."""
    return F.conv(F.substring(hash_order(seed, *parts), 1, 8), 16, 10).cast("bigint")


def top_k_per_group(df: DataFrame, keys, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Rows with rank 1..k inside each group (WindowGroupLimit pre-filters map-side)."""
    w = W.partitionBy(*_keys(keys)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def sample_per_dataset(df: DataFrame, dataset: str, id_col: str, k: int, seed: int = 42,
                       overrides: dict[str, int] | None = None) -> DataFrame:
    """SMP01: seeded shuffle then first k rows per dataset; k <= 0 keeps every row;
    per-dataset overrides of k."""
    overrides = overrides or {}
    ks = [k] + list(overrides.values())
    if all(x <= 0 for x in ks):
        return df.withColumn("rank", F.lit(None).cast("int"))
    kcol = F.lit(k)
    for name, v in overrides.items():
        kcol = F.when(col(dataset) == name, F.lit(v)).otherwise(kcol)
    cap = max(x for x in ks if x > 0)
    keep_all = df.filter(kcol <= 0).withColumn("rank", F.lit(None).cast("int"))
    ranked = top_k_per_group(df.filter(kcol > 0), dataset, [hash_order(seed, id_col), col(id_col)], cap)
    return ranked.filter(F.col("rank") <= kcol).unionByName(keep_all)


def shuffle_limit(df: DataFrame, keys, id_col: str, limit: int, seed: int = 42) -> DataFrame:
    """SMP02: deterministic shuffle + limit per (task, prompt mode)."""
    return top_k_per_group(df, keys, [hash_order(seed, id_col), col(id_col)], limit)


def dense_index(df: DataFrame, keys, order: list[Column], out: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """0-based position of every row inside its group in ``order`` (a distributed
    zip-with-index): rows are range-partitioned on (keys, order), sorted inside each
    partition, numbered locally with ``monotonically_increasing_id``; a small table of
    per-(partition, group) counts turns local numbers into group positions.  A hot group
    is spread over many range partitions."""
    ks = _keys(keys)
    tmp = [F.col(k) for k in ks] + order
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    s = (df.repartitionByRange(n, *tmp).sortWithinPartitions(*tmp)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    s = materialize(s)
    runs = s.groupBy("_pid", *ks).agg(F.count(F.lit(1)).alias("_c"), F.min("_local").alias("_start"))
    w = W.partitionBy(*ks).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).select("_pid", *ks, "_start", "_before")
    side, _ = checked_broadcast(runs)
    return (equi_join(s, side, ["_pid"] + ks)
             .withColumn(out, F.col("_before") + F.col("_local") - F.col("_start"))
             .drop("_pid", "_local", "_start", "_before"))


def fewshot_random(evals: DataFrame, pool: DataFrame, k: int, seed: int = 1234, task: str = "task",
                   id_col: str = "doc_id", exclude_self: bool = False) -> DataFrame:
    """SMP03 (and SMP06 with ``exclude_self``): k distinct pool rows per evaluation row.

    The pool is numbered once per task (``dense_index``); each evaluation row draws k (or
    k+1) positions of its own, each from its own hash, repeats drawn again (and positions in
    order should the hashes not reach k) — k distinct rows, independent of other rows'
    draws, exactly k output rows per evaluation row (no candidate pairs are generated).  With ``exclude_self``
    the evaluation row itself is dropped and the first k others are kept.
    Output: (task, eval_id, shot, cand_id) with shot = 0..k-1."""
    p = dense_index(pool.select(task, col(id_col).alias("cand_id")), task,
                    [hash_order(seed, "cand_id"), F.col("cand_id")], "pos")
    sizes, _ = checked_broadcast(p.groupBy(task).agg(F.count(F.lit(1)).alias("_n")))  # one row per task
    draw = k + 1 if exclude_self else k
    e = (evals.select(task, col(id_col).alias("eval_id"))
              .join(sizes, task)
              .withColumn("_draws", F.transform(F.sequence(F.lit(0), F.lit(4 * draw + 7)), lambda j: F.pmod(hash_int(seed, F.col("eval_id"), j), F.col("_n"))))
              .withColumn("_all", F.array_distinct(F.concat("_draws", F.sequence(F.lit(0).cast("bigint"), F.least(F.col("_n"), F.lit(2 * draw)) - 1))))
              .select(task, "eval_id", F.posexplode(F.slice("_all", 1, draw)).alias("_j", "pos")))
    j = e.join(p, [task, "pos"])
    if exclude_self:
        j = j.filter(F.col("cand_id") != F.col("eval_id"))
    w = W.partitionBy(task, "eval_id").orderBy("_j")
    return (j.withColumn("shot", F.row_number().over(w) - 1).filter(F.col("shot") < k)
             .select(task, "eval_id", "shot", "cand_id"))


def fewshot_fixed(evals: DataFrame, pool: DataFrame, k: int, seed: int = 1234, task: str = "task",
                  id_col: str = "doc_id", balance: str | None = None, n_classes: int | None = None) -> DataFrame:
    """SMP04 / SMP05: the first k pool rows (by id) — or the first k // C rows of every
    class when ``balance`` names the class column — in a per-evaluation-row hashed order.
    One row more is drawn and the evaluated row itself dropped, so an item is never its own
    shot.  The reference raises when k is not a multiple of the class count; so does this."""
    if balance is not None:
        if not n_classes or k % n_classes:
            raise ValueError("balanced few-shot needs k to be a multiple of the number of classes")
        per = k // n_classes
        first = top_k_per_group(pool, [task, balance], [col(id_col)], per + 1).withColumn("_class", col(balance))
    else:
        per = k
        first = top_k_per_group(pool, task, [col(id_col)], k + 1).withColumn("_class", F.lit(0))
    first = first.select(task, col(id_col).alias("cand_id"), "_class")
    side, _ = checked_broadcast(first)          # k + 1 rows per task and class
    e = evals.select(task, col(id_col).alias("eval_id"))
    mine = W.partitionBy(task, "eval_id", "_class").orderBy("cand_id")
    j = (e.join(side, task).filter(F.col("cand_id") != F.col("eval_id"))
          .withColumn("_nth", F.row_number().over(mine)).filter(F.col("_nth") <= per))
    w = W.partitionBy(task, "eval_id").orderBy(hash_order(seed, "eval_id", "cand_id"), "cand_id")
    return j.withColumn("shot", F.row_number().over(w) - 1).select(task, "eval_id", "shot", "cand_id")


# Example header per language in the plain few-shot prompt.
EXAMPLE_HEADER = {"en": "Example", "pt": "Exemplo"}


def fewshot_context(shots: DataFrame, docs: DataFrame, evals: DataFrame, task: str = "task",
                    description: str = "", language: str = "pt", text_col: str = "text",
                    target_col: str = "target", max_bytes: int = 8 << 20) -> DataFrame:
    """SMP07: description, then "<Example> i:\\n" + text + target + "\\n###\\n" per shot, then
    "<Example> k+1:\\n" and the evaluated text.  ``docs`` maps cand_id -> (text, target),
    ``evals`` gives (task, eval_id, text).  The shots of one row are bounded by k."""
    head = EXAMPLE_HEADER[language]
    used = shots.select(task, "cand_id").distinct()
    texts = used.join(docs.select(F.col("doc_id").alias("cand_id"), col(text_col).alias("_t"), col(target_col).alias("_g")), "cand_id")
    texts, small = checked_broadcast(texts, max_bytes)
    if small:
        # Few shots serve all rows (fixed modes): only ids are grouped per row, and the texts
        # are looked up in one map per task, whose measured size is under ``max_bytes``.
        by_task = texts.groupBy(task).agg(F.map_from_entries(F.collect_list(F.struct(F.col("cand_id").cast("string"), F.struct("_t", "_g")))).alias("_m"))
        ids = shots.groupBy(task, "eval_id").agg(F.array_sort(F.collect_list(F.struct("shot", "cand_id"))).alias("_ids"))
        per = ids.join(F.broadcast(by_task), task).select(task, "eval_id", F.transform("_ids", lambda x: F.struct(
            x["shot"].alias("shot"), F.col("_m")[x["cand_id"].cast("string")]["_t"].alias("_t"), F.col("_m")[x["cand_id"].cast("string")]["_g"].alias("_g"))).alias("_shots"))
    else:
        s = shots.join(texts, [task, "cand_id"])
        per = (s.groupBy(task, "eval_id")
                .agg(F.array_sort(F.collect_list(F.struct("shot", "_t", "_g"))).alias("_shots")))
    block = F.array_join(F.transform("_shots", lambda x: F.concat(
        F.lit(head + " "), (x["shot"] + 1).cast("string"), F.lit(":\n"), x["_t"], x["_g"], F.lit("\n###\n"))), "")
    desc = description + "\n\n" if description else ""
    e = evals.select(task, "eval_id", col(text_col).alias("_q"))
    j = e.join(per, [task, "eval_id"], "left")
    nshots = F.coalesce(F.size("_shots"), F.lit(0))
    prompt = F.when(nshots == 0, F.concat(F.lit(desc), F.col("_q"))).otherwise(F.concat(
        F.lit(desc), block, F.lit(head + " "), (nshots + 1).cast("string"), F.lit(":\n"), F.col("_q")))
    return j.select(task, "eval_id", prompt.alias("prompt"))


def fewshot_candidates(pool: DataFrame, excluded: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """JN08 / FLT11: the few-shot pool minus an exclusion list of ids (anti join).  The
    per-row rules "not the row itself" and "not the same exam" are applied by the
    selectors (``fewshot_random(exclude_self=True)``, ``fewshot_similar(group_col=...)``)
    so that no (row, candidate) pairs are generated here."""
    if excluded is None:
        return pool
    return pool.join(excluded.select(col(id_col)), id_col, "left_anti")


def shuffle_choices(choices, seed, item_id) -> Column:
    """SMP09: a seeded, reproducible permutation of an array of alternatives."""
    return F.transform(
        F.array_sort(F.transform(choices, lambda x, i: F.struct(
            F.md5(F.concat(F.lit(f"{seed}:"), col(item_id).cast("string"), F.lit(":"), i.cast("string"))).alias("h"),
            x.alias("v")))), lambda s: s["v"])


def perplexity_corpus(pages: DataFrame, text: str, order: str, n_pages: int, sep: str = "\n\n") -> DataFrame:
    """SMP10: the first ``n_pages`` non-empty pages (by ``order``) joined with blank lines
    (the limit is the feature: a fixed-size perplexity corpus)."""
    first = (pages.filter(F.length(F.trim(col(text))) > 0)
                  .orderBy(col(order)).limit(n_pages))
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(col(order).alias("o"),
                                                                                     col(text).alias("t")))),
                                              lambda s: s["t"]), sep).alias("corpus"),
                     F.count(F.lit(1)).alias("n_pages"))


def _running(df: DataFrame, keys, order: list[Column], value: Column, out: str, num_partitions: int | None, fold, put) -> DataFrame:
    """Inclusive running ``fold`` of ``value`` inside each group in ``order`` without sorting a
    whole group in one task: range partitions carry a slice of a hot group each; local running
    folds are ``put`` together with the fold of the earlier partitions of the same group."""
    ks = _keys(keys)
    tmp = [F.col(k) for k in ks] + order
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    s = (df.withColumn("_v", value).repartitionByRange(n, *tmp)
           .withColumn("_pid", F.spark_partition_id()))
    s = materialize(s)
    wl = W.partitionBy("_pid", *ks).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("_local", fold("_v").over(wl))
    tot = s.groupBy("_pid", *ks).agg(fold("_v").alias("_t"))
    wp = W.partitionBy(*ks).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    tot = tot.withColumn("_before", fold("_t").over(wp)).select("_pid", *ks, "_before")
    side, _ = checked_broadcast(tot)
    return (equi_join(s, side, ["_pid"] + ks).withColumn(out, put(F.col("_before"), F.col("_local")))
             .drop("_pid", "_v", "_local", "_before"))


def distributed_cumsum(df: DataFrame, keys, order: list[Column], value: Column, out: str,
                       num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` inside each group in ``order``."""
    return _running(df, keys, order, value, out, num_partitions, F.sum, lambda before, local: F.coalesce(before, F.lit(0)) + local)


def distributed_cummax(df: DataFrame, keys, order: list[Column], value: Column, out: str,
                       num_partitions: int | None = None) -> DataFrame:
    """Inclusive running maximum of ``value`` inside each group in ``order``; null until a value
    that isn't null has come."""
    return _running(df, keys, order, value, out, num_partitions, F.max, F.greatest)
