"""Operator 5 - quality rules, line first.

Every line of a text is judged on its own: symbol punctuation, navigation separators and
boilerplate phrases.  Failing lines are removed; a document that loses too much of its text,
or fails the whole-text rules (too short, too repetitive), is rejected.

Words are runs of characters outside space and U+0009..U+000D.  Defined cases: a null or
empty text has no words and is rejected (too short); lines without words are never judged
and stay; repeated rows get equal rows; long texts take linear time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, map_texts

SYMBOLS = "#*$%&|<>"
# Phrases of page furniture; a line of few words with one of them is boilerplate.
BOILERPLATE_PATTERN = (
    r"all rights reserved|cookie policy|accept (?:all )?cookies|privacy policy|terms of (?:use|service)|"
    r"subscribe to|sign up for|click here|enable javascript|lorem ipsum|licensed under|powered by|"
    r"share on (?:facebook|twitter)|skip to (?:main )?content")
BOILERPLATE = re.compile(BOILERPLATE_PATTERN, re.I | re.A)
SEPARATORS = ("|", "»", "›", "•", "·", ">", "/")       # as words of their own


@dataclass(frozen=True)
class LineRules:
    """Thresholds.  All are ratios or counts within one line or one text."""

    min_words: int = 50                # whole text
    max_repeat_percent: int = 50       # words in repeated 3-word windows, whole text
    max_symbols_per_word: float = 0.5  # symbol characters of a line by its words
    min_separators: int = 3            # navigation: lone separators in a line ...
    max_words_per_cell: float = 4.0    # ... with at most so many words between them
    boilerplate_words: int = 30        # a longer line with a phrase is prose about it
    max_lost: float = 0.3              # share of the words that removed lines may hold


def line_fails(line: str, words: list[str], rules: LineRules) -> str | None:
    """The rule that removes a line with words, or None."""
    n = len(words)
    bars = sum(map(words.count, SEPARATORS))
    if bars >= rules.min_separators and n - bars <= rules.max_words_per_cell * (bars + 1):
        return "navigation"
    if sum(map(line.count, SYMBOLS)) > rules.max_symbols_per_word * n:
        return "punctuation"
    if n <= rules.boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeated_words(words: list[str]) -> int:
    """Words covered by 3-word windows that occur twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    base = np.int64(len(ids))
    if len(ids) > 2_000_000:           # three ids no longer fit 63 bits: number the pairs first
        _, pair = np.unique(w[:-1] * base + w[1:], return_inverse=True)
        key = pair[:-1].astype(np.int64) * base + w[2:]
    else:
        key = (w[:-2] * base + w[1:-1]) * base + w[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k:n - 2 + k] |= hit
    return int(covered.sum())


def judge(text: str | None, rules: LineRules) -> dict:
    text = text or ""
    words = WORD_RE.findall(text)
    n, seen, dup, kept_lines, lost, why = len(words), set(), 0, [], 0, {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in text.split("\n"):
        line_words = WORD_RE.findall(line)
        failed = None
        if line_words:
            dup += line in seen
            seen.add(line)
            failed = line_fails(line, line_words, rules)
        if failed:
            why[failed] += 1
            lost += len(line_words)
        else:
            kept_lines.append(line)
    repeat = repeated_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": failed,
        "kept": not failed and lost <= rules.max_lost * n, "n_lost_words": lost,
        "n_punctuation": why["punctuation"], "n_navigation": why["navigation"], "n_boilerplate": why["boilerplate"],
        "clean_text": "\n".join(kept_lines),
    }


FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
          "kept boolean, n_lost_words bigint, n_punctuation bigint, n_navigation bigint, n_boilerplate bigint")


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text",
                  with_text: bool = False) -> DataFrame:
    """Id, measures, counts of removed lines by rule and the verdict ``kept`` per row;
    ``with_text`` adds clean_text (the text without its failing lines).  Map-only."""
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["clean_text"] * with_text

    def make():
        def step(rows):
            found = [judge(t, rules) for t in rows["text"]]
            return {"id": rows["id"]} | {n: [x[n] for x in found] for n in names}

        return step

    out = map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
                    f"id {dict(docs.dtypes)[id_col]}, {FIELDS}" + ", clean_text string" * with_text, make)
    return out.withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Pipeline form: rejected rows go, the rest lose their failing lines.  Every column is
    kept (whatever its name); ``chars_col``, where present, follows the new text."""

    @F.pandas_udf("kept boolean, clean_text string")
    def verdict(texts: pd.Series) -> pd.DataFrame:
        found = [judge(t, rules) for t in texts]
        return pd.DataFrame({"kept": [x["kept"] for x in found], "clean_text": [x["clean_text"] for x in found]})

    name = "__quality_verdict"
    while name in docs.columns:
        name += "_"
    once = verdict.asNondeterministic()                    # else the filter is pushed below and judges a second time
    seen = docs.withColumn(name, once(F.col(f"`{text_col}`").cast("string"))).filter(F.col(f"{name}.kept"))
    new = {text_col: F.col(f"{name}.clean_text")}
    if chars_col in docs.columns:
        new[chars_col] = F.length(F.col(f"{name}.clean_text")).cast(dict(docs.dtypes)[chars_col])
    return seen.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
