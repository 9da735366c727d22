"""Tasks as declarations (EXTN): prompt template, extractor, scorers and aggregators by name.

A new task is a ``TaskSpec``; an extractor or scorer that no name stands for yet is a Column
builder registered under one.  ``run_task`` makes one plan for all tasks: prompts from the template
rows, one CASE over the extractors that the tasks use, one row per item and metric, and one
aggregation of all metrics (``aggregate_scores``).

Defined cases: an item without a response counts with a null prediction, which scores 0; items
of a task without a spec are left out; a metric has one aggregator kind in all tasks (else an
error); names that aren't registered are an error before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions.templates import build_prompts, template_rows
from ..session import equi_join
from .metrics import AGG_KINDS, aggregate_scores
from .scoring import score_contains, score_token_f1

# name -> Column builder (response) -> prediction, a string
EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "text": lambda c: E.py_strip(c),
    "letter": lambda c: E.extract_letter(c),
    "last_line": lambda c: E.extract_last_line(c),
    "number": lambda c: E.extract_number(c).cast("string"),
}

# name -> Column builder (prediction, gold, response) -> value of one item
SCORERS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "equal": lambda p, g, r: (F.lower(E.py_strip(p)) == F.lower(E.py_strip(g))).cast("double"),
    "contains": lambda p, g, r: score_contains(r, g).cast("double"),
    "token_f1": lambda p, g, r: score_token_f1(p, F.array(g)).cast("double"),
    "one": lambda p, g, r: F.lit(1.0),
}


@dataclass(frozen=True)
class TaskSpec:
    """``metrics``: name -> (scorer, aggregator kind); for the kinds f1 and mcc, ``positive`` is the
    answer that counts as 1 in gold and prediction."""
    name: str
    prompt: str
    target: str
    extract: str
    metrics: dict[str, tuple[str, str]]
    classes: dict[str, str] = field(default_factory=dict)
    positive: str | None = None
    lower_is_better: tuple[str, ...] = ()


def _checked(specs: list[TaskSpec]) -> dict[str, str]:
    """The aggregator kind of each metric."""
    kinds: dict[str, str] = {}
    for s in specs:
        if s.extract not in EXTRACTORS:
            raise ValueError(f"{s.name}: no extractor {s.extract}")
        for metric, (scorer, kind) in s.metrics.items():
            if scorer not in SCORERS or kind not in AGG_KINDS:
                raise ValueError(f"{s.name}: no scorer {scorer} or no aggregator {kind}")
            if kinds.setdefault(metric, kind) != kind:
                raise ValueError(f"{metric} has two aggregators")
    return kinds


def _by_task(specs: list[TaskSpec], of: Callable[[TaskSpec], Column]) -> Column:
    out = None
    for s in specs:
        here = F.col("task") == s.name
        out = F.when(here, of(s)) if out is None else out.when(here, of(s))
    return out


def score_items(items: DataFrame, responses: DataFrame, specs: list[TaskSpec]) -> DataFrame:
    """One row per item and metric: task, doc_id, prompt, prediction, metric, value, weight, gold,
    pred (the last two 0 / 1).  ``items`` (task, doc_id, fields, gold), ``responses`` (task, doc_id,
    response)."""
    _checked(specs)
    templates = template_rows(items.sparkSession, {s.name: (s.prompt, s.target) for s in specs}, {s.name: s.classes for s in specs})
    asked = equi_join(build_prompts(items, templates), responses, ["task", "doc_id"], "left")
    p, g, r = F.col("prediction"), F.col("answer"), F.col("response")
    read = asked.withColumnRenamed("gold", "answer").withColumn("prediction", _by_task(specs, lambda s: EXTRACTORS[s.extract](r)))

    def metrics(s: TaskSpec) -> Column:
        same = lambda c: F.coalesce((F.lower(E.py_strip(c)) == (s.positive or "").lower()).cast("int"), F.lit(0))
        return F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(SCORERS[scorer](p, g, r), F.lit(0.0)).alias("value"), same(g).alias("gold"), same(p).alias("pred"))
                         for m, (scorer, _) in s.metrics.items()])

    each = read.withColumn("_m", F.explode(_by_task(specs, metrics)))
    return each.select("task", "doc_id", "prompt", "prediction", "_m.metric", "_m.value", F.lit(1.0).alias("weight"), "_m.gold", "_m.pred")


def run_task(items: DataFrame, responses: DataFrame, specs: list[TaskSpec], iters: int = 0) -> DataFrame:
    """(task, metric, value, stderr, n, higher_is_better) of all tasks; ``iters`` > 0 adds bootstrap
    errors where the aggregator has them."""
    kinds = _checked(specs)
    side = items.sparkSession.createDataFrame(list(kinds.items()), "metric string, kind string")
    out = aggregate_scores(score_items(items, responses, specs), side, ("task",), iters=iters)
    lower = [(s.name, m) for s in specs for m in s.lower_is_better]
    better = F.lit(True)
    for t, m in lower:
        better = better & ~((F.col("task") == t) & (F.col("metric") == m))
    return out.withColumn("higher_is_better", better)
