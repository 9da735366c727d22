"""Tasks as declarations, end to end."""

import pytest
from pyspark.sql import functions as F

from sparkeval.operators import tasks as T

YES = T.TaskSpec("yes_no", "Pergunta: {q|question}\nResposta:", " {label|classes}", "text", {"acc": ("equal", "mean"), "f1": ("one", "f1")}, {"1": "sim", "0": "não"}, positive="sim")
OPEN = T.TaskSpec("open", "Q: {q}\nA:", " {a}", "last_line", {"acc": ("equal", "mean"), "overlap": ("token_f1", "mean"), "found": ("contains", "sum")}, lower_is_better=("found",))


def test_two_tasks_in_one_run(spark):
    items = spark.createDataFrame([("yes_no", 1, {"q": "a", "label": "1"}, "sim"), ("yes_no", 2, {"q": "b?", "label": "0"}, "não"), ("yes_no", 3, {"q": "c", "label": "1"}, "sim"),
                                   ("open", 1, {"q": "x", "a": "red house"}, "red house"), ("other", 1, {}, "z")], "task string, doc_id long, fields map<string,string>, gold string")
    responses = spark.createDataFrame([("yes_no", 1, " Sim \n"), ("yes_no", 2, "sim"), ("open", 1, "I think\nred tree"), ("open", 9, "stray")], "task string, doc_id long, response string")
    scores = {(r.task, r.doc_id, r.metric): r for r in T.score_items(items, responses, [YES, OPEN]).collect()}
    assert len(scores) == 9 and scores["yes_no", 1, "acc"].prompt == "Pergunta: a?\nResposta:"
    assert scores["yes_no", 3, "acc"].prediction is None and scores["yes_no", 3, "acc"].value == 0.0
    got = {(r.task, r.metric): r for r in T.run_task(items, responses, [YES, OPEN]).collect()}
    assert got["yes_no", "acc"].value == pytest.approx(1 / 3) and got["yes_no", "acc"].n == 3
    assert got["yes_no", "f1"].value == pytest.approx(0.5)          # one right, one false yes, one missed
    assert got["open", "acc"].value == 0.0 and got["open", "overlap"].value == pytest.approx(0.5)
    assert got["open", "found"].higher_is_better is False and got["open", "acc"].higher_is_better is True
    assert ("other", "acc") not in got


def test_names_are_checked_first(spark):
    none = spark.createDataFrame([], "task string, doc_id long, fields map<string,string>, gold string")
    for bad in (T.TaskSpec("t", "", "", "nothing", {}), T.TaskSpec("t", "", "", "text", {"m": ("nothing", "mean")}), T.TaskSpec("t", "", "", "text", {"m": ("equal", "nothing")})):
        with pytest.raises(ValueError):
            T.run_task(none, none.select("task", "doc_id", F.lit("").alias("response")), [bad])
    with pytest.raises(ValueError, match="two aggregators"):
        T.run_task(none, none, [T.TaskSpec("a", "", "", "text", {"m": ("equal", "mean")}), T.TaskSpec("b", "", "", "text", {"m": ("equal", "sum")})])


def test_a_new_scorer_is_a_column_builder(spark, monkeypatch):
    monkeypatch.setitem(T.SCORERS, "length", lambda p, g, r: F.length(p).cast("double"))
    spec = T.TaskSpec("t", "{x}", "{x}", "text", {"len": ("length", "mean")})
    items = spark.createDataFrame([("t", i, {"x": "v"}, "g") for i in range(3)], "task string, doc_id long, fields map<string,string>, gold string")
    responses = spark.createDataFrame([("t", i, "a" * i) for i in range(3)], "task string, doc_id long, response string")
    assert T.run_task(items, responses, [spec]).first()["value"] == pytest.approx(1.0)
