"""Column builders for text: normalisers, tokenisers, n-grams.

Everything here returns a ``Column`` made of built-in expressions, so it stays inside
whole-stage code generation (no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ASCII letters and Python's ``string.punctuation`` in its natural order.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Portuguese articles removed by the answer normaliser.
PT_ARTICLES = ["o", "a", "os", "as", "um", "uma", "uns", "umas"]
# ---------------------------------------------------------------------------

# Unicode-aware whitespace (Java's plain \s is ASCII only).
WS = r"(?U)\s"
WS_RUN = r"(?U)\s+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, fn) -> Column:
    """Bind ``value`` once and build ``fn(value)`` on the binding.

    Composed Column expressions repeat their inputs textually; inside CASE branches and
    lambdas Spark's subexpression elimination cannot share them, so a heavy input (a
    regex over a whole document) would run once per reference.  A one-element
    ``transform`` evaluates it exactly once per row."""
    return F.element_at(F.transform(F.array(col(value)), fn), 1)


def janitor_normalize(c) -> Column:
    """DEC01: ASCII upper -> lower, ASCII punctuation deleted; every other character
    (accented capitals included) is kept as is."""
    return F.translate(col(c), ASCII_UPPER + ASCII_PUNCTUATION, ASCII_LOWER)


def whitespace_pieces(c) -> Column:
    """Split on single whitespace characters: empty pieces mark runs.  Piece ``j``
    starts at character ``len(join(pieces[:j], ' ')) + 1`` of the text (0 for j=0)."""
    return F.split(F.regexp_replace(col(c), WS, " "), " ")


def words(c) -> Column:
    """Whitespace tokens (``str.split()`` / ``\\S+``)."""
    return F.filter(F.split(col(c), WS_RUN), lambda x: x != "")


def word_ngrams(tokens, n: int) -> Column:
    """DEC02: array of space-joined n-grams of a token array (empty if too short)."""
    def build(toks):
        k = F.size(toks) - n + 1
        return F.when(k >= 1, F.transform(F.sequence(F.lit(1), k),
                                          lambda i: F.array_join(F.slice(toks, i, n), " "))
                      ).otherwise(F.array().cast("array<string>"))
    return let(tokens, build)


def spaced(c) -> Column:
    """Whitespace runs as one space, none at the ends: the words of a text joined by spaces."""
    return F.trim(F.regexp_replace(col(c), WS_RUN, " "))


def pieces(c) -> Column:
    """Words of a text parted by one space each."""
    return F.when(col(c) == "", F.array().cast("array<string>")).otherwise(F.split(col(c), " ", -1))


def bag(tokens) -> Column:
    """Tokens of an array labelled with their occurrence number ('t', then U+0001 and 1, 2,
    ...): the set form of a bag.  Sorting brings equal tokens together; each run is then
    numbered, so the work is n log n and set functions give bag results."""
    def number(s):
        n = F.size(s)
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i).otherwise(F.lit(-1))), lambda i: i >= 0)

        def runs(st):
            return F.flatten(F.transform(st, lambda i, k: F.transform(
                F.sequence(F.lit(1), F.coalesce(F.get(st, k + 1), n) - i), lambda j: F.concat(F.get(s, i), F.lit("\u0001"), j.cast("string")))))
        return let(starts, runs)
    return let(F.array_sort(tokens), number)


def squeeze_ws(c) -> Column:
    return F.regexp_replace(col(c), WS_RUN, " ")
