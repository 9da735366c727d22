"""Open-domain multilingual QA evaluation (SCR07, SCR13, JN02, WIN01, WIN02, AGG14).

The best no-answer threshold is a running sum in no-answer-probability order; it is
computed with ``distributed_cumsum`` (range partitions, no single-task window), then
the first maximum is found with plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ASCII_PUNCTUATION, col, let
from ..session import checked_broadcast, equi_join
from .sampling import _keys, distributed_cumsum

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): article patterns per language and the
# languages segmented per character.
MIXED_SEGMENTATION_LANGS = ["zh_cn", "zh_hk", "zh_tw", "ja", "th", "km"]
ARTICLE_REGEX_BY_LANG = {
    "en": r"\b(a|an|the)\b",
    "es": r"\b(un|una|unos|unas|el|la|los|las)\b",
    "vi": r"\b(của|là|cái|chiếc|những)\b",
    "de": r"\b(ein|eine|einen|einem|eines|einer|der|die|das|den|dem|des)\b",
    "ar": "\\sال^|ال",
    "nl": r"\b(de|het|een|des|der|den)\b",
    "sv": r"\b(en|ett)\b",
    "da": r"\b(en|et)\b",
    "no": r"\b(en|et|ei)\b",
    "fr": r"\b(le|la|l'|les|du|de|d'|des|un|une|des)",
    "pt": r"\b(o|a|os|as|um|uma|uns|umas)\b",
    "it": r"\b(il|lo|la|l'|i|gli|le|del|dello|della|dell'|dei|degli|degl'|delle|un'|uno|una|un)",
    "fi": r"\b(se|yks|yksi)\b",
    "hu": r"\b(a|az|egy)\b",
}
# ---------------------------------------------------------------------------

_W = r"[\p{L}\p{N}_]"


def java_word_boundaries(rx: str) -> str:
    """Python's Unicode ``\\b`` at the edges of an alternation group, as look-arounds."""
    return "(?U)" + rx.replace(r"\b(", f"(?<!{_W})(").replace(r")\b", f")(?!{_W})")


def normalize_by_lang(text, lang) -> Column:
    """SCR07: lower -> drop ASCII punctuation -> language articles -> tokens (whitespace,
    or every non-space character for mixed-segmentation languages) joined by a space."""
    s = F.translate(F.lower(col(text)), ASCII_PUNCTUATION, "")
    lg = col(lang)
    out = None
    for code, rx in ARTICLE_REGEX_BY_LANG.items():
        rep = F.regexp_replace(s, java_word_boundaries(rx), " ")
        out = F.when(lg == code, rep) if out is None else out.when(lg == code, rep)
    s = out.otherwise(s)

    def tokens(x):
        chars = F.filter(F.split(x, ""), lambda c: F.trim(c) != "")
        ws = F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")
        return F.when(lg.isin(MIXED_SEGMENTATION_LANGS), chars).otherwise(ws)
    return let(s, lambda x: F.array_join(tokens(x), " "))


def no_answer_prob(loglik_na) -> Column:
    """SCR13: probability of the ' N/A' continuation from its log-likelihood."""
    return F.exp(col(loglik_na))


def best_threshold(df: DataFrame, keys, prob: str = "na_prob", order: str = "id", has_answer: str = "has_answer",
                   score: str = "score", predicted: str = "predicted_text") -> DataFrame:
    """WIN01: start at threshold 0 with every unanswerable item right; walk items by
    no-answer probability (stable: ties by ``order``) adding the score of answerable
    items and -1 for unanswerable items that got an answer; the first strict maximum
    wins.  Output: (keys, best_score (×100 / n), best_threshold)."""
    ks = _keys(keys)
    diff = (F.when(col(has_answer), col(score).cast("double"))
             .when(col(predicted), F.lit(-1.0)).otherwise(F.lit(0.0)))
    run = distributed_cumsum(df, ks, [col(prob), col(order)], diff, "_run")
    # running totals rounded to 1e-9 so that summation order cannot decide ties
    run = run.withColumn("_run", F.round("_run", 9))
    base = df.groupBy(*ks).agg(F.count_if(~col(has_answer)).cast("double").alias("_base"),
                               F.count(F.lit(1)).alias("_n"))
    mx = run.groupBy(*ks).agg(F.max("_run").alias("_max"))
    side, _ = checked_broadcast(mx)                  # one row per group: no shuffle on a hot group key
    first = (equi_join(run, side, ks).filter(F.col("_run") == F.col("_max"))
                .groupBy(*ks).agg(F.min(F.struct(col(prob).alias("p"), col(order).alias("o")))["p"].alias("_at")))
    j = equi_join(equi_join(base, mx, ks, "left"), first, ks, "left")
    better = F.col("_max") > 0
    best = F.when(better, F.col("_base") + F.col("_max")).otherwise(F.col("_base"))
    return j.select(*ks, (100.0 * best / F.col("_n")).alias("best_score"),
                    F.when(better, F.col("_at")).otherwise(F.lit(0.0)).alias("best_threshold"))


def apply_no_answer_threshold(value, prob, has_answer, threshold) -> Column:
    """WIN02: items whose no-answer probability exceeds the threshold are scored as a
    no-answer prediction (1 if unanswerable, else 0); others keep their value."""
    return F.when(col(prob) > col(threshold), (~col(has_answer)).cast("double")).otherwise(col(value).cast("double"))


def mkqa_metrics(df: DataFrame, keys, em: str = "em", f1: str = "score", prob: str = "na_prob", order: str = "id",
                 has_answer: str = "has_answer", predicted: str = "predicted_text") -> DataFrame:
    """WIN02 + AGG14: default summary (exact_match, f1, answerable / unanswerable splits,
    ×100) and the best-threshold metrics chosen to maximise F1."""
    ks = _keys(keys)
    th = best_threshold(df, ks, prob, order, has_answer, f1, predicted)
    side, _ = checked_broadcast(th)        # one row per (model, task, language)
    j = df.join(side, ks)
    a = col(has_answer)
    em_t = apply_no_answer_threshold(em, prob, has_answer, "best_threshold")
    f1_t = apply_no_answer_threshold(f1, prob, has_answer, "best_threshold")
    e, f = col(em).cast("double"), col(f1).cast("double")
    return j.groupBy(*ks).agg(
        (100 * F.avg(e)).alias("exact_match"), (100 * F.avg(f)).alias("f1"),
        (100 * F.avg(F.when(a, e))).alias("answerable_exact_match"),
        (100 * F.avg(F.when(a, f))).alias("answerable_f1"),
        (100 * F.avg(F.when(~a, e))).alias("unanswerable_exact_match"),
        (100 * F.avg(em_t)).alias("best_em"), F.first("best_score").alias("best_f1"),
        (100 * F.avg(F.when(a, em_t))).alias("best_answerable_em"),
        (100 * F.avg(F.when(a, f1_t))).alias("best_answerable_f1"),
        (100 * F.avg(F.when(~a, em_t))).alias("best_unanswerable_em"),
        F.first("best_threshold").alias("best_f1_threshold"))


def gold_answers(annotations: DataFrame, id_col: str = "example_id", lang: str = "lang",
                 answers: str = "answers") -> DataFrame:
    """SRC20 / FLT09: one row per (id, language) with the de-duplicated, sorted answer set
    (texts and aliases) and the answer types, dropping items whose first type is
    long_answer or unanswerable.  ``answers``: array<struct<type, text, aliases>>."""
    a = col(answers)
    texts = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(
        a, lambda x: F.concat(F.array(x["text"]), F.coalesce(x["aliases"], F.array().cast("array<string>"))))),
        lambda t: t.isNotNull())))
    types = F.transform(a, lambda x: x["type"])
    out = annotations.select(col(id_col).alias(id_col), col(lang).alias(lang), texts.alias("gold"), types.alias("types"))
    return out.filter(~F.element_at("types", 1).isin("long_answer", "unanswerable"))


def join_predictions(gold: DataFrame, preds: DataFrame, id_col: str = "example_id") -> DataFrame:
    """JN02: predictions joined to gold answers, restricted to predicted ids."""
    return preds.join(gold, id_col, "inner")
