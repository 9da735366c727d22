"""Operator 4 - line dedup by overlapping three-line windows (DataFrame functions only).

A window is three consecutive lines that have a word (blank lines between them do not
count).  Windows are hashed (two 64-bit hashes); the first occurrence of a window in the
corpus, by document id and then line, stays; every line that a later occurrence covers is
removed, with the blank lines inside it.  Windows are judged on the input, so the result
does not depend on order or partitioning.

Skew: a window that a third of the documents share is counted with map-side partial
aggregation and joined back with a plain equi-join, whose hot key adaptive execution splits;
no list per window is ever built, only the covered lines of one document.

Defined cases: null or empty text, or fewer than three lines with a word: nothing is
removed, a null text stays null; rows with equal id and text are one document given twice
and both stay alike; a null id orders last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

HAS_WORD = r"[^\x20\x09-\x0D]"


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def numbered_lines(text: Column) -> Column:
    """Lines with a word as structs of their place and two 64-bit hashes."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(
        i.alias("i"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), x.rlike(HAS_WORD).alias("w")))
    return F.filter(lines, lambda x: x["w"])


def line_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, doc (hashes of the text), start, end (line places) and window (hashes)."""
    text = F.col(text_col).cast("string")

    def three(lines: Column) -> Column:
        at = lambda k: F.element_at(lines, k)
        def window(k: Column) -> Column:
            x, y, z = at(k), at(k + 1), at(k + 2)
            return F.struct(x["i"].alias("start"), z["i"].alias("end"), F.struct(
                F.xxhash64(x["a"], y["a"], z["a"], x["b"]).alias("a"), F.xxhash64(F.lit(1), x["b"], y["b"], z["b"], z["a"]).alias("b")).alias("window"))
        return F.when(F.size(lines) >= 3, F.transform(F.sequence(F.lit(1), F.size(lines) - 2), window))

    rows = docs.select(F.col(id_col).alias("id"), text_key(text).alias("doc"), F.explode(let(numbered_lines(text), three)).alias("w"))
    return rows.select("id", "doc", "w.start", "w.end", "w.window")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, doc, covered: places of the lines that later occurrences of windows cover, for
    documents that have any."""
    windows = line_windows(docs, id_col, text_col)
    place = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("doc").alias("doc"), F.col("start").alias("start"))
    firsts = (windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last"))
              .filter(~F.col("first").eqNullSafe(F.col("last"))).select("window", "first"))
    later = windows.join(firsts, "window").filter(~place.eqNullSafe(F.col("first")))
    spans = F.collect_set(F.struct("start", "end"))                      # bounded by the document's own lines
    return later.groupBy("id", "doc").agg(
        F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"])))).alias("covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` (text without the covered lines) and, as one struct column
    ``line_dedup``, n_lines (lines with a word) and n_removed (of them)."""
    text = F.col(text_col).cast("string")
    named = {f"__ld_{i}": c for i, c in enumerate(docs.columns)}
    safe = docs.toDF(*named).withColumns({"__ld_id": F.col(next(k for k, c in named.items() if c == id_col)),
                                          "__ld_text": F.col(next(k for k, c in named.items() if c == text_col)).cast("string")})
    safe = safe.withColumn("__ld_doc", text_key(F.col("__ld_text")))
    cover = repeated_lines(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")))
    cover = cover.select(F.col("id").alias("__ld_cid"), F.col("doc").alias("__ld_cdoc"), "covered")
    both = safe.join(cover, F.col("__ld_id").eqNullSafe(F.col("__ld_cid")) & (F.col("__ld_doc") == F.col("__ld_cdoc")), "left")

    def apply(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
        return F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")

    words = lambda t: F.size(F.filter(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: x.rlike(HAS_WORD))).cast("bigint")
    new = F.when(F.col("covered").isNull(), F.col("__ld_text")).otherwise(let(F.split(F.col("__ld_text"), "\n"), apply))
    both = both.withColumn("__ld_new", new).withColumn("__ld_n", words(F.col("__ld_text")))
    removed = F.when(F.col("covered").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("__ld_n") - words(F.col("__ld_new")))
    stats = F.struct(F.col("__ld_n").alias("n_lines"), removed.alias("n_removed")).alias("line_dedup")
    return both.select(*[(F.col("__ld_new") if c == text_col else F.col(k)).alias(c) for k, c in named.items()], stats)
