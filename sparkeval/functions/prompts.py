"""Row filters and prompt projections (FLT01-FLT10, PRJ01-PRJ08) as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import py_strip
from .text import col, let

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference).
SQUEEZE_RULES = [(r"\s*\n+\s*", " "), (r"(\s)\1+", " "), (r"^\s+", "")]
MARKUP_RX = r"http|lt\s*;|gt\s*;"
BR_RX = r"<br />|<BR />|<Br />"
EXAM_BASE_FILTER = {"IC": "No", "MR": "No", "CE": "No"}
RUNNER_EXAM_PROMPT = ("Responda à questão do ENEM.\n"
                      "Formato obrigatório de saída: FINAL_ANSWER: <A|B|C|D|E>\n"
                      "Retorne SOMENTE essa linha final, sem explicações.\n\n")
RUNNER_BIAS_PROMPT = ("Read the context and answer the question.\n"
                      "Required output format: FINAL_ANSWER: <0|1|2>\n"
                      "Return only that final line.\n\n")
RUNNER_GSM_PROMPT = ("Resolva o problema e devolva apenas o número final.\n"
                     "Formato obrigatório: FINAL_ANSWER: <numero>\n\n")
# ---------------------------------------------------------------------------


def squeeze_text(c) -> Column:
    """PRJ01: newline runs (with surrounding spaces) -> one space; a repeated whitespace
    character -> one space; leading whitespace removed — in that order."""
    out = col(c)
    for rx, rep in SQUEEZE_RULES:
        out = F.regexp_replace(out, "(?U)" + rx, rep)
    return out


def clean_sentiment_rows(df: DataFrame, text: str = "text", label: str = "sentiment") -> DataFrame:
    """FLT01: drop null text and the undefined class '-', label -> int + 1, every
    whitespace character (and repeats of it) -> one space."""
    return (df.filter(col(text).isNotNull() & (col(label).cast("string") != "-"))
              .withColumn(label, col(label).cast("int") + 1)
              .withColumn(text, F.regexp_replace(col(text), r"(?U)(\s)\1*", " ")))


def filter_markup(text, max_len: int = 298) -> Column:
    """FLT02: no link / html-entity artefacts and shorter than ``max_len``."""
    return ~col(text).rlike(MARKUP_RX) & (F.length(col(text)) < max_len)


def fit_train(text, max_len: int) -> tuple[Column, Column]:
    """FLT03 (train): keep rows shorter than ``max_len`` (measured before <br /> removal)
    and remove the breaks: (keep predicate, cleaned text)."""
    return F.length(col(text)) < max_len, F.regexp_replace(col(text), BR_RX, " ")


def fit_test(text, trunc: int) -> Column:
    """FLT03 (test): truncate to ``trunc`` characters, then remove <br /> breaks."""
    return F.regexp_replace(F.substring(col(text), 1, trunc), BR_RX, " ")


def exam_attr_filter(tag: str | None) -> dict[str, str]:
    """FLT04: the attribute dictionary selected by a tag (TC, EK, DS, *_only)."""
    f = dict(EXAM_BASE_FILTER)
    if tag is None:
        return f
    if tag not in ("TC", "EK", "DS", "TC_only", "EK_only", "DS_only"):
        raise ValueError("tag must be TC, EK, DS, TC_only, EK_only or DS_only")
    if tag in ("TC", "EK", "DS"):
        f[tag] = "Yes"
    else:
        base = tag.split("_")[0]
        for t in ("TC", "EK", "DS"):
            f[t] = "Yes" if t == base else "No"
    return f


def filter_by_attrs(attrs: dict, negated_flags: list[str] = ()) -> Column:
    """FLT04 / FLT05: conjunction of attribute equalities (a missing attribute fails)
    and of negated boolean flags."""
    preds = [F.coalesce(col(k) == v, F.lit(False)) for k, v in attrs.items()]
    preds += [~F.coalesce(col(f), F.lit(False)) for f in negated_flags]
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def exam_year(id_col) -> Column:
    """Year from an id like 'exam_2022_17' (second '_' field)."""
    return F.split(col(id_col), "_")[1]


def filter_exam_items(id_col: str, answer: str, has_images: str, years: list[int] | None = None) -> Column:
    """FLT06: answer present, no associated images, year kept."""
    p = col(answer).isNotNull() & ~F.coalesce(col(has_images), F.lit(False))
    if years:
        p = p & exam_year(id_col).cast("int").isin(years)
    return p


def filter_valid_choices(labels) -> Column:
    """FLT07: every choice label is non-empty and alphabetic (``str.isalpha``)."""
    return F.forall(col(labels), lambda x: x.rlike(r"^\p{L}+$"))


def min_alternatives(m, k: int = 2) -> Column:
    """FLT08: at least k alternatives in a target-score map."""
    return F.size(col(m)) >= k


def first_type_not_in(types, excluded=("long_answer", "unanswerable")) -> Column:
    """FLT09: the first answer type is not excluded."""
    return ~F.element_at(col(types), 1).isin(list(excluded))


def keep_by_index(df: DataFrame, index_col: str, keep: DataFrame) -> DataFrame:
    """FLT10: allow-list by position index (semi join with the index table)."""
    return df.join(keep.select(index_col), index_col, "left_semi")


def letter_choices(choices, sep: str = ") ") -> Column:
    """PRJ02/PRJ03: 'A) first', 'B) second', … for an array of alternatives."""
    return F.transform(col(choices), lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit(sep), x))


def relabel_choice(choice) -> Column:
    """PRJ03: an alternative written 'a) text' becomes 'A. text'."""
    c = col(choice)
    return F.when(c.rlike(r"^[a-zA-Z]\)"), F.concat(F.upper(F.substring(c, 1, 1)), F.lit("."),
                                                    F.substring(c, 3, 1 << 30))).otherwise(c)


def gold_index(letter, letters: str = "ABCDE") -> Column:
    """PRJ03: letter -> 0-based index (null when not a letter of the range)."""
    return F.when(F.instr(F.lit(letters), col(letter)) > 0, F.instr(F.lit(letters), col(letter)) - 1)


def runner_exam_prompt(context, question, alternatives) -> Column:
    """PRJ02: the edge runner's exam prompt (context block only when non-empty)."""
    ctx = py_strip(F.coalesce(col(context), F.lit("")))
    ctx_block = F.when(ctx != "", F.concat(F.lit("Contexto:\n"), ctx, F.lit("\n\n"))).otherwise(F.lit(""))
    alts = F.array_join(letter_choices(alternatives), "\n")
    return F.concat(F.lit(RUNNER_EXAM_PROMPT), ctx_block, F.lit("Questão:\n"), F.coalesce(col(question), F.lit("")),
                    F.lit("\n\nAlternativas:\n"), alts, F.lit("\n\nResposta final (uma letra):"))


def runner_bias_prompt(context, question, ans0, ans1, ans2) -> Column:
    """PRJ02: the edge runner's bias-set prompt."""
    c = lambda x: F.coalesce(col(x), F.lit(""))
    return F.concat(F.lit(RUNNER_BIAS_PROMPT), F.lit("Context: "), c(context), F.lit("\nQuestion: "), c(question),
                    F.lit("\n0: "), c(ans0), F.lit("\n1: "), c(ans1), F.lit("\n2: "), c(ans2), F.lit("\n\nAnswer:"))


def runner_gsm_prompt(question) -> Column:
    """PRJ02: the edge runner's arithmetic prompt."""
    return F.concat(F.lit(RUNNER_GSM_PROMPT), F.lit("Problema:\n"), F.coalesce(col(question), F.lit("")),
                    F.lit("\n\nResposta final:"))


def decode_onehot(flags: list[str], names: list[str] | None = None, mode: str = "first") -> Column:
    """PRJ05: index (or name) of the first — or last — true flag, in list order."""
    names = names or flags
    order = list(range(len(flags)))
    if mode == "last":
        order = order[::-1]
    out = None
    for i in order:
        v = F.lit(names[i]) if names is not flags else F.lit(i)
        out = F.when(col(flags[i]), v) if out is None else out.when(col(flags[i]), v)
    return out


def split_at_divergence(a, b) -> Column:
    """PRJ06: character position where two sentences' whitespace tokens diverge:
    Σ(len(tok)+1) over the common token prefix, minus one, floored at 0."""
    def on(ta, tb):
        n = F.least(F.size(ta), F.size(tb))
        pairs = F.slice(F.zip_with(ta, tb, lambda x, y: F.struct(x.alias("0"), y.alias("1"))), 1, n)
        acc = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), F.lit(True).alias("go")),
                          lambda s, p: F.when(s["go"] & (p["0"] == p["1"]),
                                              F.struct((s["pos"] + F.length(p["0"]) + 1).alias("pos"), F.lit(True).alias("go")))
                          .otherwise(F.struct(s["pos"].alias("pos"), F.lit(False).alias("go"))))
        return F.greatest(F.lit(0), acc["pos"] - 1)
    ws = lambda x: F.filter(F.split(col(x), r"(?U)\s+"), lambda t: t != "")
    return let(ws(a), lambda ta: let(ws(b), lambda tb: on(ta, tb)))


def parity_choices(qid, correct, incorrect, pos) -> Column:
    """PRJ07: even question id -> the correct continuation is option A, odd -> B."""
    c = F.substring(col(correct), col(pos) + 1, 1 << 30)
    w = F.substring(col(incorrect), col(pos) + 1, 1 << 30)
    head = F.substring(col(correct), 1, col(pos))
    even = col(qid) % 2 == 0
    return F.concat(head, F.lit("\nA."), F.when(even, c).otherwise(w), F.lit("\nB."),
                    F.when(even, w).otherwise(c), F.lit("\nResposta:"))


def exam_area(question_no, areas: list[str]) -> Column:
    """PRJ08: area from the question number, ``ceil(q / 45) - 1`` indexing the areas."""
    return F.element_at(F.array(*[F.lit(a) for a in areas]), F.ceil(col(question_no) / 45).cast("int"))


# ----------------------------------------------------------------- PRJ02 (task registry)
# Labels of the registry's prompts.
EXAM_LETTERS = "ABCDE"
ANSWER_HANDLE = {"en": "Answer:", "pt": "Resposta:"}
ENTAILMENT_TARGETS = [" Não", " Sim"]
FOUR_LETTER_UNIVERSITY = "UNICAMP"


def _lettered(options: Column) -> Column:
    """'A. x\\n' … for at most five options, concatenated."""
    return F.array_join(F.transform(F.slice(options, 1, len(EXAM_LETTERS)), lambda x, i: F.concat(
        F.substring(F.lit(EXAM_LETTERS), i + 1, F.lit(1)), F.lit(". "), x, F.lit("\n"))), "")


def headed_exam_prompt(context, question, options) -> Column:
    """PRJ02: exam item with a heading, lettered alternatives and the answer cue."""
    return F.concat(F.lit("Cabeçalho: "), col(context), F.lit("\nEnunciado: "), col(question), F.lit("\nAlternativas:\n"),
                    _lettered(col(options)), F.lit("Resposta:"))


def statement_exam_prompt(question, alternatives) -> Column:
    """PRJ02 / PRJ03: exam item whose alternatives carry their own 'a)' labels, rewritten to
    'A.' by position."""
    relabelled = F.transform(F.slice(col(alternatives), 1, len(EXAM_LETTERS)), lambda x, i: F.concat(F.replace(
        x, F.concat(F.lower(F.substring(F.lit(EXAM_LETTERS), i + 1, F.lit(1))), F.lit(")")),
        F.concat(F.substring(F.lit(EXAM_LETTERS), i + 1, F.lit(1)), F.lit("."))), F.lit("\n")))
    return F.concat(F.lit("Enunciado: "), col(question), F.lit("\nAlternativas:\n"), F.array_join(relabelled, ""), F.lit("Resposta:"))


def university_gold_index(item_id, answer) -> Column:
    """PRJ03: 0-based index of the answer letter among the four letters of one university or
    the five of the others (null when the letter is not among them)."""
    n = F.when(F.split_part(col(item_id), F.lit("_"), F.lit(1)) == FOUR_LETTER_UNIVERSITY, 4).otherwise(5)
    at = F.instr(F.lit(EXAM_LETTERS), F.upper(col(answer)))
    return F.when((F.length(col(answer)) == 1) & (at > 0) & (at <= n), at - 1)


def lettered_question_prompt(question, labels, texts, language: str = "pt") -> Column:
    """PRJ02: question, its alternatives under their own labels, and the answer cue."""
    lines = F.transform(F.arrays_zip(col(labels).alias("l"), col(texts).alias("t")), lambda z: F.concat(z["l"], F.lit(". "), z["t"]))
    return F.concat(col(question), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n" + ANSWER_HANDLE[language]))


def entailment_prompt(premise, hypothesis) -> Column:
    """PRJ02: yes/no question whether the premise entails the hypothesis."""
    return F.concat(F.lit('Pergunta: Dado que "'), col(premise), F.lit('", é verdade que "'), col(hypothesis), F.lit('"?\nResposta:'))


def entailment_target(judgment) -> Column:
    return F.get(F.array(*[F.lit(x) for x in ENTAILMENT_TARGETS]), col(judgment).cast("int"))
