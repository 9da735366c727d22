"""Per-sample scoring (SCR01-SCR14) and the response/gold joins (JN01-JN03).

Scorers are Column builders where the score is a function of one row, and DataFrame
operators where a sample spans several rows (one row per choice / per request).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import ARITH_DATASET, parse_last_number, py_strip
from ..functions.grams import bag_overlaps
from ..functions.text import ASCII_PUNCTUATION, PT_ARTICLES, WS_RUN, bag, col, let

# ----------------------------------------------------------------- row scorers

def score_runner_sample(dataset, label, pred, context_condition=None, arith_dataset: str = ARITH_DATASET) -> Column:
    """SCR05: struct(correct, valid, is_ambig, is_disambig) of the edge-benchmark runner.
    ``label`` is the gold letter / index / answer text by dataset family; a missing label
    counts as wrong.  ``context_condition`` (bias sets) is 'ambig' or 'disambig'."""
    ds, lab, p = col(dataset), col(label), col(pred)
    e_num, p_num = parse_last_number(lab), parse_last_number(p)
    close = (e_num.isNotNull() & p_num.isNotNull()
             & (F.abs(e_num - p_num) <= F.lit(1e-9) * F.greatest(F.abs(e_num), F.abs(p_num))))
    correct = (F.when(ds.startswith("enem"), F.coalesce(p == F.upper(py_strip(lab)), F.lit(False)).cast("double"))
                .when(ds.startswith("bbq"), F.coalesce(p == py_strip(lab), F.lit(False)).cast("double"))
                .when(ds == arith_dataset, F.coalesce(close, F.lit(False)).cast("double")))
    valid = (F.when(ds.startswith("enem"), p.isin("A", "B", "C", "D", "E").cast("double"))
              .when(ds.startswith("bbq"), p.isin("0", "1", "2").cast("double"))
              .when(ds == arith_dataset, p_num.isNotNull().cast("double"))
              .otherwise((py_strip(p) != "").cast("double")))
    cond = F.lit(None).cast("string") if context_condition is None else col(context_condition)
    flag = lambda name: F.when(ds.startswith("bbq"), F.coalesce(cond == name, F.lit(False)).cast("double"))
    return F.struct(correct.alias("correct"), valid.alias("valid"), flag("ambig").alias("is_ambig"), flag("disambig").alias("is_disambig"))


def score_contains(raw, gold) -> Column:
    """SCR14: expected letter anywhere in the upper-cased last 100 characters."""
    return F.upper(F.right(col(raw), F.lit(100))).contains(col(gold))


def score_binary_ll(ll_pos, ll_neg) -> Column:
    """SCR02: strict log-likelihood comparison."""
    return col(ll_pos) > col(ll_neg)


def score_label_match(pred, gold, case_sensitive: bool = False) -> Column:
    """SCR04: trimmed (and lower-cased unless case-sensitive) label equality."""
    p, g = py_strip(pred), py_strip(gold)
    if not case_sensitive:
        p, g = F.lower(p), F.lower(g)
    return p == g


_ART_RX = r"(?U)(?<![\p{L}\p{N}_])(?:" + "|".join(PT_ARTICLES) + r")(?![\p{L}\p{N}_])"


def normalize_text(c) -> Column:
    """SCR06: lower -> drop ASCII punctuation -> articles -> squeeze whitespace -> strip."""
    s = F.translate(F.lower(col(c)), ASCII_PUNCTUATION, "")
    s = F.regexp_replace(s, _ART_RX, " ")
    return F.array_join(F.filter(F.split(s, WS_RUN), lambda t: t != ""), " ")


def norm_tokens(c) -> Column:
    return F.filter(F.split(normalize_text(c), " "), lambda t: t != "")


def score_exact_match(pred, refs) -> Column:
    """SCR08: normalised prediction equals any normalised reference."""
    return let(normalize_text(pred), lambda p: F.exists(col(refs), lambda r: normalize_text(r) == p))


def _f1(common, n_pred, n_ref) -> Column:
    prec = common / n_pred
    rec = common / n_ref
    return F.when(common == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))


def _multiset_common(a: Column, b: Column) -> Column:
    """Size of the bag intersection: tokens labelled with their occurrence number are sets,
    whose intersection is hash-based (linear)."""
    return F.size(F.array_intersect(bag(a), bag(b)))


def token_f1(pred, ref, variant: str = "set") -> Column:
    """SCR09: token F1 of one prediction against one reference.

    * ``set``      — distinct tokens; empty reference scores 1 iff the prediction is empty.
    * ``multiset`` — bag overlap; no common token scores 0.
    * ``mixed``    — bag overlap; when either side is empty, 1 iff both token lists are equal.
    """
    return let(norm_tokens(pred), lambda a: let(norm_tokens(ref), lambda b: _token_f1(a, b, variant)))


def _set_f1(common: Column, na: Column, nb: Column) -> Column:
    prec = F.when(na > 0, common / na).otherwise(F.lit(0.0))
    rec = common / nb
    return (F.when(nb == 0, F.when(na == 0, 1.0).otherwise(0.0))
             .when(prec + rec == 0, 0.0).otherwise(2 * prec * rec / (prec + rec)))


def _token_f1(a: Column, b: Column, variant: str) -> Column:
    if variant == "set":
        da, db = F.array_distinct(a), F.array_distinct(b)
        return _set_f1(F.size(F.array_intersect(da, db)).cast("double"), F.size(da).cast("double"), F.size(db).cast("double"))
    return let(_multiset_common(a, b).cast("double"), lambda common: _bag_f1(a, b, common, variant))


def _bag_f1(a: Column, b: Column, common: Column, variant: str) -> Column:
    na, nb = F.size(a).cast("double"), F.size(b).cast("double")
    if variant == "multiset":
        return _f1(common, na, nb)
    if variant == "mixed":
        return F.when((na == 0) | (nb == 0), (a == b).cast("double")).otherwise(_f1(common, na, nb))
    raise ValueError(variant)


def score_token_f1(pred, refs, variant: str = "set") -> Column:
    """Max token F1 over a reference array (prediction tokens computed once)."""
    return let(norm_tokens(pred), lambda a: F.array_max(F.transform(
        col(refs), lambda r: let(norm_tokens(r), lambda b: _token_f1(a, b, variant)))))


def score_qa(pred, refs) -> Column:
    """SCR08 + SCR09 at once: struct<em, f1_set, f1_multiset, f1_mixed>, the best over the
    references.  Every text is normalised and its bag of words built once."""
    def plain(c) -> Column:
        s = F.regexp_replace(F.translate(F.lower(c), ASCII_PUNCTUATION, ""), _ART_RX, " ")
        return F.trim(F.regexp_replace(s, WS_RUN, " "))

    def against(x: Column) -> Column:
        f = {k: x[k].cast("double") for k in ("n_pred", "n_ref", "once_pred", "once_ref", "once", "bag")}
        both = _f1(f["bag"], f["n_pred"], f["n_ref"])
        return F.struct(x["same"].alias("em"), _set_f1(f["once"], f["once_pred"], f["once_ref"]).alias("f1_set"), both.alias("f1_multiset"),
                        F.when((f["n_pred"] == 0) | (f["n_ref"] == 0), x["same"].cast("double")).otherwise(both).alias("f1_mixed"))

    each = F.transform(bag_overlaps(plain(col(pred)), F.transform(col(refs), plain)), against)
    best = lambda xs, name: F.array_max(F.transform(xs, lambda x: x[name])).alias(name)
    return let(each, lambda xs: F.struct(F.exists(xs, lambda x: x["em"]).alias("em"), *[best(xs, f"f1_{v}") for v in ("set", "multiset", "mixed")]))


def score_sts(gold, pred) -> Column:
    """SCR11: squared error of a similarity score."""
    return F.pow(col(gold) - col(pred), 2)


def word_count(text) -> Column:
    """SCR12: ``len(re.split(r"\\s+", text))`` — empty leading/trailing pieces count."""
    return F.size(F.split(col(text), WS_RUN, -1))


def byte_count(text) -> Column:
    return F.octet_length(col(text))


# ----------------------------------------------------------------- multi-row scorers

def score_multiple_choice(choices: DataFrame, item: str = "item_id", idx: str = "choice_idx",
                          ll: str = "loglik", length: str = "choice_len", gold: str = "gold") -> DataFrame:
    """SCR01: one row per choice in, one row per item out: ``acc`` (argmax log-likelihood)
    and ``acc_norm`` (argmax log-likelihood per character; an empty choice has none and
    comes last); ties go to the first choice.
    Aggregates with ``max_by`` — no per-item lists are collected."""
    c = col(idx)
    return (choices.groupBy(item)
            .agg(F.max_by(c, F.struct(col(ll), -c)).alias("pred"),
                 F.max_by(c, F.struct(F.coalesce(F.try_divide(col(ll), col(length)), F.lit(float("-inf"))), -c)).alias("pred_norm"),
                 F.first(col(gold)).alias("gold"))
            .select(item, "pred", "pred_norm", "gold",
                    (F.col("pred") == F.col("gold")).cast("double").alias("acc"),
                    (F.col("pred_norm") == F.col("gold")).cast("double").alias("acc_norm")))


def assemble_responses(items: DataFrame, responses: DataFrame,
                       keys=("task", "prompt_mode", "doc_id"), order: str = "request_idx",
                       value: str = "resp") -> DataFrame:
    """JN01: responses joined to their items; a document's answers re-ordered by request
    index into one array (bounded by the requests of one document)."""
    keys = list(keys)
    grouped = (responses.groupBy(*keys)
               .agg(F.array_sort(F.collect_list(F.struct(col(order).alias("i"), col(value).alias("v"))))
                    .alias("_r")))
    return (items.join(grouped, keys, "inner")
                 .withColumn("responses", F.transform("_r", lambda s: s["v"])).drop("_r"))


def score_extractive_qa(gold: DataFrame, preds: DataFrame, id_col: str = "id",
                        refs: str = "refs", pred: str = "pred") -> DataFrame:
    """JN03 / SCR10: gold LEFT JOIN predictions; a missing prediction scores 0 and stays
    in the denominator.  Returns per-id exact match and multiset F1 (×100 like the
    official script)."""
    j = gold.join(preds.select(id_col, pred), id_col, "left")
    has = F.col(pred).isNotNull()
    return j.select(id_col,
                    F.when(has, score_exact_match(pred, refs).cast("double") * 100).otherwise(0.0).alias("em"),
                    F.when(has, score_token_f1(pred, refs, "multiset") * 100).otherwise(0.0).alias("f1"))
