"""Answer extraction from model output (EXT01-EXT12) as Column expressions.

Regexes are written so the same pattern text runs in Java (Spark) and RE2 (the DuckDB
oracle) with the reference's Python semantics: ``\\w`` is spelled ``[\\p{L}\\p{N}_]``
(Python's Unicode word class), and "last match of ``\\b(X)\\b``" is a greedy prefix
``^.*`` followed by explicit boundaries, which finds the right-most match without
look-around.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): cue words and answer patterns.
CUE_WORDS = r"(?:resposta(?:\s+final)?|alternativa|op[cç][aã]o|opcao|answer)"
OPTION_WORDS = r"(?:alternativa|op[cç][aã]o|opcao|option)"
FINAL_WORDS = r"(?:final_answer|resposta\s+final|final\s+answer)"
NUMBER = r"[-+]?\d+(?:[.,]\d+)?"
TAIL_CHARS = 400
# Name of the arithmetic (word-problem) dataset in the runner tables; configurable.
ARITH_DATASET = "arith_gsm8k"
# ---------------------------------------------------------------------------

W = r"[\p{L}\p{N}_]"          # Python's \w
NW = r"[^\p{L}\p{N}_]"        # Python's \W
B_LEFT = rf"(?:^|{NW})"
B_RIGHT = rf"(?:{NW}|$)"

# Right-most match patterns (group 1), shared with the oracle SQL.
RX_FINAL = rf"(?i){FINAL_WORDS}\s*[:\-]\s*([^\n\r]+)"
RX_LAST_CUE_LETTER = rf"(?is)^.*{CUE_WORDS}\s*[:\-]?\s*\(?\s*([A-E]){B_RIGHT}"
RX_LAST_OPTION_NUMBER = rf"(?is)^.*{OPTION_WORDS}\s*[:\-]?\s*([1-5]){B_RIGHT}"
RX_LAST_LETTER = rf"(?s)^.*{B_LEFT}([A-E]){B_RIGHT}"
RX_LAST_INDEX = rf"(?s)^.*{B_LEFT}([0-2]){B_RIGHT}"
RX_STRIP = r"^\s+|\s+$"
RX_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _java(rx: str) -> str:
    """Java needs (?u) for Unicode case folding and (?U) for Unicode \\s / \\d."""
    return "(?uU)" + rx


def py_strip(c) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(col(c), _java(RX_STRIP), "")


def last_group(c, rx: str) -> Column:
    """Group 1 of the right-most match of a greedy-prefix pattern, '' when none."""
    return F.regexp_extract(col(c), _java(rx), 1)


def last_match(c, rx: str, group: int = 1) -> Column:
    """Group of the last non-overlapping match (``re.findall(...)[-1]``), null when none."""
    return F.try_element_at(F.regexp_extract_all(col(c), F.lit(_java(rx)), group), F.lit(-1))


def answer_tail(raw) -> Column:
    """EXT01-04 input: last 400 characters of the stripped output."""
    return let(py_strip(raw), lambda cand: F.when(F.length(cand) > TAIL_CHARS,
                                                  F.substring(cand, -TAIL_CHARS, TAIL_CHARS)).otherwise(cand))


def answer_source(raw) -> Column:
    """Text after the last FINAL_ANSWER-style cue inside the tail, else the tail."""
    def pick(tail):
        return let(py_strip(F.coalesce(last_match(tail, RX_FINAL), F.lit(""))),
                   lambda fin: F.when(fin != "", fin).otherwise(tail))
    return let(answer_tail(raw), pick)


def extract_letter(raw) -> Column:
    """EXT01: A-E after a cue word; else option number 1-5 as a letter; else the last
    stand-alone A-E of the upper-cased text; '' when nothing matches."""
    def pick(src):
        return let(F.upper(last_group(src, RX_LAST_CUE_LETTER)), lambda cue: let(
            last_group(src, RX_LAST_OPTION_NUMBER), lambda num: (
                F.when(cue != "", cue)
                 .when(num != "", F.substring(F.lit("ABCDE"), num.cast("int"), F.lit(1)))
                 .otherwise(last_group(F.upper(src), RX_LAST_LETTER)))))
    return let(answer_source(raw), pick)


def extract_index(raw) -> Column:
    """EXT02: last stand-alone 0, 1 or 2."""
    return last_group(answer_source(raw), RX_LAST_INDEX)


def extract_number(raw) -> Column:
    """EXT03: last number, decimal comma read as a point ('' when none)."""
    return F.coalesce(F.replace(last_match(answer_source(raw), f"({NUMBER})"), F.lit(","), F.lit(".")),
                      F.lit(""))


def extract_last_line(raw) -> Column:
    """EXT04: last line of the tail, stripped."""
    return py_strip(F.element_at(F.split(answer_tail(raw), RX_LINE_BREAK), -1))


def extract_model_answer(dataset, raw) -> Column:
    """Dispatch by dataset family (enem* / bbq* / gsm8k / other); '' for empty output."""
    ds = col(dataset)

    def pick(r):
        return (F.when(py_strip(r) == "", F.lit(""))
                 .when(ds.startswith("enem"), extract_letter(r))
                 .when(ds.startswith("bbq"), extract_index(r))
                 .when(ds == ARITH_DATASET, extract_number(r))
                 .otherwise(extract_last_line(r)))
    return let(raw, pick)


def parse_last_number(c) -> Column:
    """Last number of a text as double (gold side of SCR05), null when none."""
    return F.replace(last_match(c, f"({NUMBER})"), F.lit(","), F.lit(".")).try_cast("double")


# ----- task-registry extractors (whole generation) ---------------------------------

def extract_choice_ab(pred) -> Column:
    """EXT06: the last ``A.`` / ``B.``, else the last capital A or B, as 'X.'; the stripped
    prediction itself when neither occurs."""
    return let(py_strip(pred), lambda p: F.coalesce(
        F.concat(F.coalesce(last_match(p, r"([AB])\."), last_match(p, "([AB])")), F.lit(".")), p))


def extract_choice(pred, choices=None, letters: str = "ABCDE") -> Column:
    """EXT05: ``X.`` then ``X)`` (any case) then any capital ``X``; else the index
    of an alternative whose text equals the prediction; '' when unknown."""
    lo = letters.lower()
    return let(pred, lambda p: _choice(p, choices, letters, lo))


def _choice(p, choices, letters, lo):
    m1 = last_match(p, f"([{letters}])\\.")
    m2 = F.upper(last_match(p, f"([{letters}{lo}])\\)"))
    m3 = last_match(p, f"([{letters}])")
    out = F.coalesce(m1, m2, m3)
    if choices is not None:
        idx = F.array_position(col(choices), p)
        by_text = F.when(idx > 0, F.substring(F.lit(letters), idx.cast("int"), 1))
        out = F.coalesce(out, by_text)
    return F.coalesce(out, F.lit(""))


def extract_paren_letter(pred) -> Column:
    """EXT07: first ``[A-Z])`` of the stripped prediction ('' when none)."""
    return F.regexp_extract(py_strip(pred), r"([A-Z]\))", 1)


def extract_class(pred, classes) -> Column:
    """EXT08: left-most class name found in the lower-cased prediction; at equal
    positions the earlier class in the list wins (regex alternation order)."""
    return let(F.lower(py_strip(pred)), lambda p: _class_of(p, classes))


def _class_of(p, classes):
    hits = F.filter(
        F.transform(col(classes), lambda c, i: F.struct(
            F.call_function("instr", p, F.lower(py_strip(c))).alias("pos"), i.alias("i"),
            F.lower(py_strip(c)).alias("cls"))),
        lambda s: (s["pos"] > 0) & (s["cls"] != ""))
    return F.coalesce(F.array_min(hits)["cls"], F.lit(""))


def match_letter_lenient(gold, pred) -> Column:
    """EXT09: equal; equal after lower/strip; or first ``[a-d].`` equals gold."""
    g, p = col(gold), col(pred)
    return let(F.lower(py_strip(g)), lambda gl: let(F.lower(py_strip(p)), lambda pl: let(
        F.regexp_extract(pl, r"([a-d])\.", 1),
        lambda first: (p == g) | (pl == gl) | ((first != "") & (first == gl)))))


def extract_yes_no(pred) -> Column:
    """EXT10: 'yes' when the text starts (after spaces) with sim, 'no' with nao/não."""
    p = col(pred)
    return (F.when(p.rlike(r"(?iuU)^\s*sim"), "yes")
             .when(p.rlike(r"(?iuU)^\s*(nao|não)"), "no"))


def extract_digit_class(pred) -> Column:
    """EXT11: first 1 or 2 in the stripped lower-cased text, 'unknown' otherwise."""
    return let(F.regexp_extract(F.lower(py_strip(pred)), "(1|2)", 1),
               lambda r: F.when(r == "", "unknown").otherwise(r))


def extract_score(pred, gold) -> Column:
    """EXT12: struct(pred, gold, unknown): the prediction as a float; one that does not parse
    is forced to 1 against a gold of 5 and counted in ``unknown``."""
    def pick(v):
        return F.struct(F.coalesce(v, F.lit(1.0)).alias("pred"), F.when(v.isNull(), F.lit(5.0)).otherwise(col(gold).cast("double")).alias("gold"),
                        v.isNull().cast("double").alias("unknown"))
    return let(py_strip(pred).try_cast("double"), pick)
