"""Rows that no other row dominates (JN11), by sweeps and divide and conquer.

Every question is of one kind: which *asking* rows of a group have an *answering* row that is at
least as good in all of some dimensions?

* One dimension: the group's best answering row.
* Two: sorted by the first, best first, the running maximum of the second over the answering
  rows (``distributed_cummax``: a group may span many partitions).
* More: the first dimension's ranks are the leaves of a binary tree.  An answering row of a
  greater rank parts from the asking row at one level, where it is in the right half of a node and
  the asking row in the left one; so each row goes once to its node of every level, and the
  halves of a node are asked about the dimensions that are left.

No two rows are ever paired: n rows make n log n rows for a third dimension, all levels at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import equi_join, materialize
from .sampling import dense_index, distributed_cummax


def _ranked(rows: DataFrame, dim: str) -> tuple[DataFrame, int]:
    """(rows with the dense rank of ``dim`` as _rank, levels of the tree over the ranks)."""
    ranks = materialize(dense_index(rows.select(dim).distinct(), [], [F.col(dim)], "_rank"))
    top = ranks.agg(F.max("_rank")).first()[0]
    return equi_join(rows, ranks, [dim]), int(top or 0).bit_length()


def _nodes(rows: DataFrame, levels: int) -> DataFrame:
    """Each row once per level, with its node and the half that it lies in."""
    each = rows.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return (each.withColumn("_node", F.expr("shiftright(_rank, _level + 1)")).withColumn("_half", F.expr("cast(shiftright(_rank, _level) & 1 as int)")))


def _clean(rows: DataFrame, n: int) -> DataFrame:
    """Tree columns under names of this depth, so that a deeper tree has its own."""
    return rows.withColumnsRenamed({"_level": f"_level{n}", "_node": f"_node{n}"}).drop("_rank", "_half")


def covered(rows: DataFrame, dims: list[str], groups: list[str]) -> DataFrame:
    """Distinct ids of the asking rows (``asks``) of (id, asks, answers, dims, groups) for which an
    answering row of their group is at least as good in all ``dims`` (greater is better)."""
    asks, answers = rows.filter("asks"), rows.filter("answers")
    if not dims:
        return equi_join(asks, answers.select(*groups).distinct(), groups, "left_semi").select("id").distinct()
    if len(dims) == 1:
        best = answers.groupBy(*groups).agg(F.max(dims[0]).alias("_best"))
        return equi_join(asks, best, groups).filter(F.col("_best") >= F.col(dims[0])).select("id").distinct()
    if len(dims) == 2:
        both = asks.withColumn("_answer", F.lit(0)).unionByName(answers.withColumn("_answer", F.lit(1)))
        value = F.when(F.col("_answer") == 1, F.col(dims[1]))
        swept = distributed_cummax(both, groups, [F.col(dims[0]).desc(), F.col("_answer").desc()], value, "_best")
        return swept.filter((F.col("_answer") == 0) & (F.col("_best") >= F.col(dims[1]))).select("id").distinct()
    ranked, levels = _ranked(rows, dims[0])
    n = len(groups)
    same = ranked.withColumn("_level", F.lit(-1)).withColumn("_node", F.col("_rank")).withColumn("_half", F.lit(None).cast("int"))
    nodes = same.unionByName(_nodes(ranked, levels)) if levels else same
    left, right = F.coalesce(F.col("_half") == 0, F.lit(True)), F.coalesce(F.col("_half") == 1, F.lit(True))
    halves = _clean(nodes.withColumn("asks", F.col("asks") & left).withColumn("answers", F.col("answers") & right), n)
    return covered(halves, dims[1:], [*groups, f"_level{n}", f"_node{n}"])


def dominated(vectors: DataFrame, dims: list[str], groups: list[str]) -> DataFrame:
    """Distinct ids of (id, dims, groups), all vectors of a group different, that another vector of
    the group dominates: equal in the dimensions before one, greater there, no less after it."""
    found = None
    for j, dim in enumerate(dims):
        equal, rest = [*groups, *dims[:j]], dims[j + 1:]
        if not rest:
            best = vectors.groupBy(*equal).agg(F.max(dim).alias("_best"))
            now = equi_join(vectors, best, equal).filter(F.col("_best") > F.col(dim)).select("id")
        else:
            ranked, levels = _ranked(vectors, dim)
            if not levels:                                 # one value: none is greater
                continue
            nodes = _nodes(ranked, levels)
            halves = _clean(nodes.withColumn("asks", F.col("_half") == 0).withColumn("answers", F.col("_half") == 1), len(equal))
            now = covered(halves, rest, [*equal, f"_level{len(equal)}", f"_node{len(equal)}"])
        found = now if found is None else found.unionByName(now)
    return found.distinct()


def skyline(rows: DataFrame, up, down, keys=()) -> DataFrame:
    """The rows that no other row of their ``keys`` group dominates: no less on every ``up``
    metric, no greater on every ``down`` metric, better on one.  Rows with a null metric
    neither dominate nor are dominated; equal rows stay together; null keys are a group."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    metrics = [F.col(f"`{m}`") for m in up] + [-F.col(f"`{m}`") for m in down]
    dims = [f"_d{i}" for i in range(len(metrics))]
    marked = rows.withColumns(dict(zip(dims, metrics)))
    whole = F.lit(True)
    for d in dims:
        whole = whole & F.col(d).isNotNull()
    vectors = materialize(marked.filter(whole).select(*ks, *dims).distinct().withColumn("id", F.monotonically_increasing_id()))
    best = vectors.join(dominated(vectors, dims, ks), "id", "left_anti").drop("id")
    kept = equi_join(marked.filter(whole), best, [*ks, *dims], "left_semi")
    return kept.unionByName(marked.filter(~whole)).drop(*dims)
