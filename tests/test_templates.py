"""Templates as rows: places, rules, nulls and odd braces."""

import json

from pyspark.sql import functions as F

from sparkeval.functions import templates as TP


def test_fill_and_rules(spark):
    classes = {"0": "no", "1": "yes"}
    cases = [
        ("{a} and {b}.", {"a": "1 {b}", "b": "$2 \\"}, "1 {b} and $2 \\."),                 # values are not read again
        ("no places", {}, "no places"), ("", {"a": "x"}, ""), ("{a}", {"a": ""}, ""), ("{a}{a}", {"a": "é😀"}, "é😀é😀"),
        ("{missing} x", {"a": "1"}, None), ("{a} x", {"a": None}, None), ("{} {1} { a } {a", {"a": "q"}, "{} {1} { a } {a"),
        ("{a|classes}", {"a": "1"}, "yes"), ("{a|classes}", {"a": "2"}, None), ("{a|question}", {"a": "why"}, "why?"), ("{a|question}", {"a": "why?"}, "why?"),
        ("{a|first}", {"a": json.dumps(["x\n", "y"])}, "x\n"), ("{a|first}", {"a": "[]"}, None), ("{a|unknown}", {"a": "v"}, None), (None, {"a": "v"}, None),
    ]
    df = spark.createDataFrame([(i, t, f, classes) for i, (t, f, _) in enumerate(cases)], "i int, t string, f map<string,string>, c map<string,string>")
    got = {r.i: r.out for r in df.select("i", TP.fill("t", "f", "c").alias("out")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_prompts_of_the_families(spark):
    rows = [("news_topic", {"title": "T", "text": "X", "label": "2"}, "Título: T\nTexto: X\nCategoria:", " Negócios"),
            ("open_question", {"query": "quem", "answer": "yes"}, "Pergunta: quem?\nResposta:", " sim"),
            ("open_question", {"query": "quem?", "answer": "Ana"}, "Pergunta: quem?\nResposta:", " Ana"),
            ("offensive_comment", {"text": "oi", "label": "false"}, 'Mensagem: "oi".\nResposta:', " inofensiva"),
            ("pronoun_choice", {"before": "p", "first": " a", "second": " b", "letter": "B"}, "p\nA. a\nB. b\nResposta:", " B."),
            ("reading", {"context": "c", "question": "q", "answers": '["r", "s"]'}, "Contexto: c\nPergunta: q\nResposta:", " r"),
            ("command", {"text": "toque", "label": "music"}, "Comando: toque\nCategoria:", " música"),
            ("unknown_task", {"text": "x"}, None, None)]
    items = spark.createDataFrame([(i, t, f) for i, (t, f, _, _) in enumerate(rows)], "i int, task string, fields map<string,string>")
    out = TP.build_prompts(items, TP.template_rows(spark))
    assert {r.i: (r.prompt, r.target) for r in out.collect()} == {i: (p, t) for i, (_, _, p, t) in enumerate(rows) if p is not None}
    own = TP.template_rows(spark, {"mine": ("Q {x}", "{y|classes}")}, {"mine": {"1": "one"}})
    item = spark.range(1).select(F.lit("mine").alias("task"), F.create_map(F.lit("x"), F.lit("?"), F.lit("y"), F.lit("1")).alias("fields"))
    assert TP.build_prompts(item, own).first()["target"] == "one"
