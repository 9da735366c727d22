"""Request tables: cache split, de-duplication, batching, rolling windows
(JN01, JN04, JN05, WIN04-WIN07).

Ordering-dependent steps (gaps and islands, fixed-size batches) use positions from
``dense_index`` and a join on (group, position - 1) instead of a ``lag`` window, so
a hot task is never ordered by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..session import checked_broadcast, equi_join
from .sampling import _keys, dense_index, distributed_cumsum


def request_hash(*parts) -> Column:
    """JN04 key: sha-256 of the JSON array of the request type and arguments (a null keeps
    its place)."""
    return F.sha2(F.to_json(F.array(*[col(p).cast("string") for p in parts]), {"ignoreNullFields": "false"}), 256)


def cache_hits(requests: DataFrame, cache: DataFrame, key: str = "request_hash") -> DataFrame:
    """JN04: requests answered by the cache with the cached response; a key cached more than
    once answers with its least response, so requests are never multiplied."""
    others = [c for c in cache.columns if c != key]
    one = cache.groupBy(key).agg(F.min(F.struct(*others)).alias("_c")).select(key, *[F.col(f"_c.{c}").alias(c) for c in others])
    return requests.join(one, key, "inner")


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "request_hash") -> DataFrame:
    """JN04: requests still to run (anti join)."""
    return requests.join(cache.select(key), key, "left_anti")


def dedupe_requests(requests: DataFrame, key: str = "request_hash") -> tuple[DataFrame, DataFrame]:
    """JN05: identical requests are sent once — (unique requests with their multiplicity,
    scatter map original row -> unique key)."""
    uniq = requests.groupBy(key).agg(F.count(F.lit(1)).alias("n_copies"),
                                     *[F.first(c).alias(c) for c in requests.columns if c != key])
    return uniq, requests.select(key, *[c for c in requests.columns if c != key])


def scatter_responses(requests: DataFrame, unique_responses: DataFrame, key: str = "request_hash") -> DataFrame:
    """JN05: responses of the unique requests back on every original row."""
    return requests.join(unique_responses, key, "left")


def length_batches(requests: DataFrame, keys, length: Column, text: str, size: int,
                   longest_first: bool = True, ties: list[Column] = ()) -> DataFrame:
    """WIN05: position in (length, text, ties) order — descending for log-likelihood
    requests, ascending for generation — and the fixed-size batch number.  ``ties`` makes
    the order unique."""
    order = [length, col(text), *ties]
    order = [c.desc() for c in order] if longest_first else [c.asc() for c in order]
    d = dense_index(requests, keys, order, "pos")
    return d.withColumn("batch", F.floor(F.col("pos") / size))


def batch_requests(requests: DataFrame, keys, order: list[Column], until: str, size: int) -> DataFrame:
    """WIN04: walk requests in ``order``; a new chunk starts when the stop list changes or
    the chunk is full.  Gaps-and-islands with positions (no lag window)."""
    ks = _keys(keys)
    d = dense_index(requests, ks, order, "pos")
    prev = d.select(*ks, (F.col("pos") + 1).alias("pos"), col(until).alias("_prev"))
    d = equi_join(d, prev, ks + ["pos"], "left")
    new_island = (F.col("_prev").isNull() | (col(until) != F.col("_prev"))).cast("long")
    d = distributed_cumsum(d, ks, [F.col("pos")], new_island, "island")
    start = d.groupBy(*ks, "island").agg(F.min("pos").alias("_start"))
    side, _ = checked_broadcast(start)               # one row per island: a hot island is not shuffled
    d = equi_join(d, side, ks + ["island"])
    return (d.withColumn("chunk_in_island", F.floor((F.col("pos") - F.col("_start")) / size))
             .drop("_prev", "_start"))


def rolling_windows(n_tokens: Column, max_len: int, context_len: int) -> Column:
    """WIN06: windows over a token list of length n — array<struct<w, ctx_start, ctx_len,
    pred_start, pred_len, disjoint_ctx_len>> (positions; ctx_start -1 = prefix token).

    First window predicts min(L, n) tokens; later windows predict up to L - C + 1 new
    tokens with the preceding L tokens as input, so every token is predicted once.  The
    disjoint variant trims the overlap; a one-token prediction gets an empty context
    (Python's ``a[:-0]``)."""
    if not 1 <= context_len <= max_len:
        raise ValueError("need 1 <= context_len <= max_len")
    n = n_tokens
    L, P = max_len, max_len - context_len + 1
    first = F.least(F.lit(L), n)
    n_more = F.when(n > L, F.ceil((n - L) / F.lit(P))).otherwise(F.lit(0))

    def win(w):
        done = L + (w - 1) * P
        wpl = F.least(n - done, F.lit(P))
        end = done + wpl
        later = F.struct(w.alias("w"), (end - L - 1).alias("ctx_start"), F.lit(L).alias("ctx_len"),
                         (end - wpl).alias("pred_start"), wpl.alias("pred_len"),
                         F.when(wpl == 1, F.lit(0)).otherwise(F.lit(L) - (wpl - 1)).alias("disjoint_ctx_len"))
        return later

    head = F.struct(F.lit(0).cast("long").alias("w"), F.lit(-1).cast("long").alias("ctx_start"),
                    first.cast("long").alias("ctx_len"), F.lit(0).cast("long").alias("pred_start"),
                    first.cast("long").alias("pred_len"),
                    F.when(first == 1, F.lit(0)).otherwise(first - (first - 1)).cast("long").alias("disjoint_ctx_len"))
    rest = F.transform(F.sequence(F.lit(1).cast("long"), n_more.cast("long")),
                       lambda w: win(w).cast(head_type()))
    return (F.when(n <= 0, F.array().cast(f"array<{head_type()}>"))
             .when(n_more == 0, F.array(head))
             .otherwise(F.concat(F.array(head), rest)))


def head_type() -> str:
    return ("struct<w:bigint,ctx_start:bigint,ctx_len:bigint,pred_start:bigint,pred_len:bigint,"
            "disjoint_ctx_len:bigint>")


def sum_window_loglik(windows: DataFrame, doc: str = "doc_id", value: str = "loglik") -> DataFrame:
    """WIN07: document log-likelihood = sum over its windows."""
    return windows.groupBy(doc).agg(F.sum(col(value)).alias("loglik"), F.count(F.lit(1)).alias("n_windows"))
