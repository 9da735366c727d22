"""Extraction / cleaning / scoring traps."""

from pyspark.sql import functions as F

from sparkeval.functions import clean as C
from sparkeval.functions import extract as X
from sparkeval.operators import scoring as S


def _one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).first()["x"]


def test_letter_cascade(spark):
    assert _one(spark, X.extract_letter("r"), r="bla bla Resposta: c") == "C"
    assert _one(spark, X.extract_letter("r"), r="acho que a opção 2") == "B"
    # trap kept: upper-casing turns the Portuguese word "e" into an answer letter
    assert _one(spark, X.extract_letter("r"), r="isto e aquilo") == "E"
    assert _one(spark, X.extract_letter("r"), r="FINAL_ANSWER: D\nmais texto A") == "D"


def test_number_and_index(spark):
    assert _one(spark, X.extract_number("r"), r="total 1,5 e depois 12") == "12"
    assert _one(spark, X.extract_number("r"), r="FINAL_ANSWER: 3,25") == "3.25"
    assert _one(spark, X.extract_index("r"), r="answer 2 or maybe 1") == "1"


def test_sanitize_order(spark):
    raw = "junk <|im_start|>assistant<think>hidden</think> Answer: B ### tail"
    assert _one(spark, C.sanitize_output("r", ["###"]), r=raw) == "B"
    assert _one(spark, C.sanitize_output("r", []), r="ok <think>never closed") == "ok"


def test_loop_flag_off_by_one(spark):
    # three equal windows at the very end: the last start is not tested by the reference
    toks = "a b c d e f g h x y x y x y"
    assert _one(spark, C.flag_loops("t", 2), t=toks) is False
    assert _one(spark, C.flag_loops("t", 2), t=toks + " z") is True


def test_token_f1_variants(spark):
    f = lambda v, p, r: _one(spark, S.token_f1("p", "r", v), p=p, r=r)
    assert f("set", "", "") == 1.0
    assert f("multiset", "o gato gato", "gato") == 2 * (1 / 2) * 1 / (1 / 2 + 1)
    assert f("mixed", "", "x") == 0.0
    assert _one(spark, S.normalize_text("t"), t="O Gato, e a casa!") == "gato e casa"


def test_word_count_keeps_empty_ends(spark):
    assert _one(spark, S.word_count("t"), t=" a b ") == 4


def test_choice_ab_and_score_rules(spark):
    from sparkeval.functions import extract as X
    df = spark.createDataFrame([("Resposta a) ou B",), ("Letra A. ou B",), (" nada ",), ("2,5",), (" 3.5 ",)], "p string")
    got = [r[0] for r in df.select(X.extract_choice_ab("p")).collect()]
    assert got == ["B.", "A.", "nada", "2,5", "3.5"]
    score = [tuple(r[0]) for r in df.select(X.extract_score("p", F.lit(2))).collect()]
    assert score[3] == (1.0, 5.0, 1.0) and score[4] == (3.5, 2.0, 0.0)


def test_bag_overlap(spark):
    from sparkeval.functions.text import bag
    df = spark.createDataFrame([(["b", "a", "b", ""],), ([],)], "t array<string>")
    got = [sorted(r[0]) for r in df.select(bag("t")).collect()]
    assert got == [["\u00011", "a\u00011", "b\u00011", "b\u00012"], []]


def test_all_qa_scores_at_once_equal_the_single_ones(spark):
    import random

    from pyspark.sql import functions as F

    from sparkeval.operators import scoring as S
    rng = random.Random(3)
    words = ["o", "gato", "Gato", "preto,", "a", "casa", "", "...", "é", "uma"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 7)))
    rows = [(text(), [text() for _ in range(rng.randrange(0, 3))] + [None] * (i % 5 == 0)) for i in range(150)] + [(None, ["x"]), ("x", None), ("", [""])]
    df = spark.createDataFrame(rows, "p string, r array<string>")
    for x in df.select(S.score_qa("p", "r").alias("s"), S.score_exact_match("p", "r").alias("em"), *[S.score_token_f1("p", "r", v).alias(v) for v in ("set", "multiset", "mixed")]).collect():
        got = x.s if x.s is not None else [None] * 4
        assert tuple(got) == (x.em, x["set"], x.multiset, x.mixed)
