"""Training-data decontamination (DEC01-DEC09, AGG27, JN07, SET03) as Spark jobs.

Plan shape for a large corpus (see README "Scale notes"):

1. ``register_contaminants`` turns benchmark text into distinct normalised n-grams
   keyed by a 64-bit hash of the token window.  It is small (benchmark-sized).
2. ``find_matches`` explodes every word position of every document into
   ``(doc_id, pos, hash)`` — one pipelined, shuffle-free stage — and probes the
   contaminant set with a *broadcast* left-semi join whose size was checked
   (``checked_broadcast``); the n-gram text is only built for hash hits, where it is
   compared exactly (join condition), so hash collisions cannot create matches.
   Above the size limit a shuffle join moves (doc_id, pos, hash) only, and the texts of
   the hits are built and compared after they meet their document again.
3. Matches are grouped per document (map-side partial aggregation; only matching
   documents shuffle) keeping the count and the first ``cutoff + 1`` positions — all
   the cut rule can ever read.
4. ``documents LEFT JOIN matches`` (broadcast when the match table is small, else
   shuffled on ``doc_id``) and the chunks are computed per row with higher-order
   functions; character offsets are computed only for documents with matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grams import window_hashes
from ..functions.text import WS, col, janitor_normalize, let, pieces, spaced, word_ngrams, words
from ..session import BROADCAST_MAX_BYTES, checked_broadcast, materialize, spread

# The reference's defaults (n-gram size, window removed on each side,
# matches after which a document is dropped, minimum kept slice length).
NGRAM_N = 13
WINDOW_TO_REMOVE = 200
TOO_DIRTY_CUTOFF = 10
MINIMUM_SLICE_LENGTH = 200


def normalized_tokens(text) -> Column:
    """Registration / corpus side: normalise the whole string, then split."""
    return words(janitor_normalize(text))


def normalized_text(text) -> Column:
    """The normalised tokens joined by spaces."""
    return spaced(janitor_normalize(text))


def raw_text_normalized(text) -> Column:
    """Cleaning side: split the raw text, then normalise each token, joined by spaces.  A
    punctuation-only token becomes an empty word, so any window containing it can never match."""
    return janitor_normalize(spaced(text))


def _windows_at(n: int, distinct: bool = False) -> Column:
    """pos and h, one row per window of the column ``plain``."""
    return F.inline(window_hashes("plain", n, distinct))


def _window_text(n: int) -> Column:
    return F.array_join(F.slice("ntoks", F.col("pos") + 1, n), " ")


def benchmark_ngrams(bench: DataFrame, n: int = NGRAM_N, id_col: str = "item_id",
                     text_col: str = "text") -> DataFrame:
    """DEC02 on the contaminant side: (item_id, pos, h, ngram), one row per window."""
    t = bench.select(F.col(id_col).alias("item_id"), normalized_text(text_col).alias("plain")).withColumn("ntoks", pieces("plain"))
    return t.select("item_id", "ntoks", _windows_at(n)).select("item_id", "pos", "h", _window_text(n).alias("ngram"))


def register_contaminants(bench: DataFrame, n: int = NGRAM_N, id_col: str = "item_id",
                          text_col: str = "text", exclude: DataFrame | None = None) -> DataFrame:
    """DEC06 / SET03: distinct contaminant n-grams (h, ngram); optionally minus a table of
    frequent n-grams (column ``ngram``), e.g. the output of ``frequent_ngrams``."""
    dirt = benchmark_ngrams(bench, n, id_col, text_col).select("h", "ngram").distinct()
    if exclude is not None:
        dirt = dirt.join(exclude.select("ngram"), "ngram", "left_anti")
    return dirt


def corpus_ngrams(docs: DataFrame, n: int = NGRAM_N, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """DEC04: n-gram postings (doc_id, ngram), de-duplicated inside each document
    (in-row ``array_distinct``, no shuffle).  Consumers shuffle it on the n-gram."""
    t = docs.select(F.col(id_col).alias("doc_id"), normalized_tokens(text_col).alias("ntoks"))
    return t.select("doc_id", F.explode(F.array_distinct(word_ngrams("ntoks", n))).alias("ngram"))


def frequent_ngrams(docs: DataFrame, n: int = NGRAM_N, min_docs: int = 10,
                    id_col: str = "doc_id", text_col: str = "text",
                    max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """AGG27 / DEC05: n-grams found in more than ``min_docs`` distinct documents.

    Phase 1 shuffles only 8-byte hashes (per-document distinct, partial counts
    map-side) and keeps hashes seen in > min_docs documents — a superset of the answer.
    Phase 2 re-counts exactly by n-gram text for those hashes only."""
    t = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))).select(
        "doc_id", normalized_text("_text").alias("plain")).withColumn("ntoks", pieces("plain"))
    cand = (t.select(_windows_at(n, distinct=True))
             .groupBy("h").agg(F.count(F.lit(1)).alias("c"))
             .filter(F.col("c") > min_docs).select("h"))
    cand_side, small = checked_broadcast(cand, max_broadcast_bytes)
    if small:
        pos = t.select("doc_id", "ntoks", _windows_at(n, distinct=True))
        hits = pos.join(cand_side, "h", "left_semi").select("doc_id", _window_text(n).alias("ngram"))
    else:
        pos = t.select("doc_id", _windows_at(n, distinct=True))
        hits = _ngram_texts(t, pos.join(cand_side, "h", "left_semi"), n).select("doc_id", "ngram")
    return (hits.groupBy("ngram").agg(F.countDistinct("doc_id").alias("n_docs"))
               .filter(F.col("n_docs") > min_docs))


def _ngram_texts(tokens: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """(doc_id, pos, h, ngram) of hits (doc_id, pos, h): the hit places of a document come to
    its token array once, so no token array is shuffled per place."""
    places = hits.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "h")).alias("_p"))      # of one document
    j = tokens.join(places, "doc_id").select("doc_id", "ntoks", F.explode("_p").alias("_x"))
    return j.select("doc_id", "_x.pos", "_x.h", F.array_join(F.slice("ntoks", F.col("_x.pos") + 1, n), " ").alias("ngram"))


def find_matches(docs: DataFrame, dirt: DataFrame, n: int = NGRAM_N, id_col: str = "doc_id",
                 text_col: str = "text", max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """DEC07 / JN07: every window (doc_id, pos) of the raw text whose normalised form is a
    registered contaminant.  ``pos`` is the 0-based index of the window's first word."""
    tokens = (spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")))
              .select("doc_id", raw_text_normalized("_text").alias("plain")).withColumn("ntoks", pieces("plain")))
    side, small = checked_broadcast(dirt.select("h", "ngram"), max_broadcast_bytes)
    if not small:
        # Shuffle (doc_id, pos, h) only; the text of the few hits is built and compared after.
        pos = tokens.select("doc_id", _windows_at(n))
        hits = pos.join(side.select("h").distinct(), "h", "left_semi")
        return _ngram_texts(tokens, hits, n).join(side, ["h", "ngram"], "left_semi").select("doc_id", "pos", "h", "ngram")
    d = tokens.select("doc_id", "ntoks", _windows_at(n)).alias("d")
    side = side.alias("c")
    # The text check is wrapped so the optimizer keeps it as a residual condition: it
    # runs only for rows whose 8-byte hash found a partner, not as a second join key
    # (which would build the n-gram text for every position of every document).
    text_eq = F.coalesce(F.array_join(F.slice(F.col("d.ntoks"), F.col("d.pos") + 1, n), " ") == F.col("c.ngram"),
                         F.lit(False))
    cond = (F.col("d.h") == F.col("c.h")) & text_eq
    hits = d.join(side, cond, "left_semi")
    return hits.select("doc_id", "pos", "h",
                       F.array_join(F.slice("ntoks", F.col("pos") + 1, n), " ").alias("ngram"))


def summarize_matches(matches: DataFrame, keep: int = TOO_DIRTY_CUTOFF + 1) -> DataFrame:
    """Per document: total match count and the first ``keep`` window positions (sorted); no
    more than ``keep`` positions of a document are ever held."""
    w = W.partitionBy("doc_id").orderBy("pos")
    placed = matches.select("doc_id", "pos", F.row_number().over(w).alias("_rn"))
    return placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_matches"),
                                        F.array_sort(F.collect_list(F.when(F.col("_rn") <= keep, F.col("pos")))).alias("positions"))


def _char_offset(tws: Column, j: Column) -> Column:
    """Character offset of whitespace piece ``j`` in the whitespace-to-space text."""
    return F.when(j == 0, F.lit(0)).otherwise(
        F.length(F.call_function("substring_index", tws, F.lit(" "), j)) + 1)


def word_piece_index(pieces) -> Column:
    """Index (into the whitespace pieces) of every non-empty piece, i.e. of every word."""
    return F.filter(F.transform(col(pieces), lambda x, i: F.when(x != "", i).otherwise(F.lit(-1))),
                    lambda j: j >= 0)


def window_spans(tws, pieces, widx, positions, n: int) -> Column:
    """DEC03 for a few windows: array<struct<start,end>> (inclusive end) of the n-gram
    windows starting at the given 0-based word positions.  ``tws`` is the text with every
    whitespace character replaced by a space, ``pieces`` its split on ' ', ``widx`` the
    output of ``word_piece_index`` — pass them as columns so each is computed once."""
    tws, pieces, widx = col(tws), col(pieces), col(widx)

    def span(p):
        j0 = F.get(widx, p)
        j1 = F.get(widx, p + (n - 1))
        return F.struct(_char_offset(tws, j0).alias("start"),
                        (_char_offset(tws, j1) + F.length(F.get(pieces, j1)) - 1).alias("end"))

    return F.transform(col(positions), span)


def removal_windows(text, spans, window: int = WINDOW_TO_REMOVE) -> Column:
    """Each match span widened by ``window`` characters and clipped to the text."""
    L = F.length(col(text))
    return F.transform(col(spans), lambda s: F.struct(
        F.greatest(F.lit(0), s["start"] - window).alias("lo"),
        F.least(L, s["end"] + window).alias("hi")))


def cut_chunks(text, win, n_matches, cutoff: int = TOO_DIRTY_CUTOFF,
               min_slice: int = MINIMUM_SLICE_LENGTH) -> Column:
    """DEC08: the reference's fold, written without state: each kept slice only needs the
    previous window's end, so it is a lag over the (sorted) window array ``win``."""
    text, win, n_matches = col(text), col(win), col(n_matches)
    L = F.length(text)
    k = F.size(win)
    mids = F.when(k > 0, F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(win, i - 1)["hi"]).alias("a"),
                           F.get(win, i)["lo"].alias("b")))
    ).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    kept = F.transform(F.filter(mids, lambda x: x["b"] - x["a"] > min_slice),
                       lambda x: F.substring(text, x["a"] + 1, x["b"] - x["a"]))
    last = F.when(k > 0, F.get(win, k - 1)["hi"]).otherwise(F.lit(-1))
    tail = F.when(last < L - min_slice,
                  F.array(F.call_function("substring", text, last + 2, L - last - 1))
                  ).otherwise(F.array().cast("array<string>"))
    return F.when(n_matches > cutoff, F.array().cast("array<string>")).otherwise(F.concat(kept, tail))


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = NGRAM_N,
                  window: int = WINDOW_TO_REMOVE, cutoff: int = TOO_DIRTY_CUTOFF,
                  min_slice: int = MINIMUM_SLICE_LENGTH, exclude: DataFrame | None = None,
                  id_col: str = "doc_id", text_col: str = "text",
                  max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Per document: doc_id, text, n_matches, chunks (array of kept slices)."""
    dirt = register_contaminants(bench, n, exclude=exclude)
    per_doc = materialize(summarize_matches(
        find_matches(docs, dirt, n, id_col, text_col, max_broadcast_bytes), cutoff + 1))
    side, _ = checked_broadcast(per_doc, max_broadcast_bytes, already_materialized=True)
    j = (spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
             .join(side, "doc_id", "left"))
    dirty = F.col("n_matches") > 0
    # Offsets are only needed for documents with matches; staged projections keep each
    # array computed once per row (the optimizer will not inline a twice-used array).
    j = j.select("doc_id", "text", F.coalesce(F.col("n_matches"), F.lit(0)).alias("n_matches"),
                 "positions", F.when(dirty, F.regexp_replace("text", WS, " ")).alias("tws"))
    j = j.select("doc_id", "text", "n_matches", "positions", "tws",
                 F.split("tws", " ").alias("pieces"))
    j = j.select("doc_id", "text", "n_matches", "positions", "tws", "pieces",
                 word_piece_index("pieces").alias("widx"))
    j = j.select("doc_id", "text", "n_matches",
                 F.when(dirty, window_spans("tws", "pieces", "widx", "positions", n))
                  .otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    j = j.select("doc_id", "text", "n_matches", removal_windows("text", "spans", window).alias("win"))
    return j.select("doc_id", "text", "n_matches",
                    cut_chunks("text", "win", "n_matches", cutoff, min_slice).alias("chunks"))


def clean_documents(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """DEC08: one row per kept chunk (doc_id, chunk_idx, chunk)."""
    d = decontaminate(docs, bench, **kw)
    # posexplode alone gets a filter on the size of its array, which is pushed below all the stages
    # of decontaminate and there holds their expressions once more for each use.
    return d.select("doc_id", F.posexplode_outer("chunks").alias("chunk_idx", "chunk")).filter("chunk_idx is not null")


def contamination_report(docs: DataFrame, bench: DataFrame, cutoff: int = TOO_DIRTY_CUTOFF,
                         **kw) -> DataFrame:
    """DEC09: one row per document: matches, status (clean / cut / dropped), kept chunks
    and kept characters."""
    d = decontaminate(docs, bench, cutoff=cutoff, **kw)
    status = (F.when(F.col("n_matches") > cutoff, "dropped")
               .when(F.col("n_matches") > 0, "cut").otherwise("clean"))
    return d.select("doc_id", F.col("n_matches").cast("bigint").alias("n_matches"), status.alias("status"),
                    F.size("chunks").cast("bigint").alias("n_chunks"),
                    F.aggregate("chunks", F.lit(0).cast("bigint"),
                                lambda a, c: a + F.length(c)).alias("kept_chars"))


def item_contamination(docs: DataFrame, bench: DataFrame, n: int = NGRAM_N,
                       max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """DEC09 by benchmark item: how many documents / windows contain each item's n-grams."""
    dirt = register_contaminants(bench, n)
    hits = find_matches(docs, dirt, n, max_broadcast_bytes=max_broadcast_bytes)
    items = benchmark_ngrams(bench, n).select("item_id", "h", "ngram").distinct()
    return (hits.join(items, ["h", "ngram"])
                .groupBy("item_id")
                .agg(F.countDistinct("doc_id").alias("n_docs"),
                     F.count(F.lit(1)).alias("n_windows")))


def word_offsets(text) -> Column:
    """DEC03: array<struct<start,end>> of every word of a text, 0-based code points, inclusive
    end.  One pass over the characters: a word starts where a character follows a blank (or
    nothing) and ends where a blank (or nothing) follows it."""
    chars = F.regexp_extract_all(F.regexp_replace(col(text), WS, " "), F.lit("(?s)."), F.lit(0))

    def edges(c: Column, step: int) -> Column:
        here = F.transform(c, lambda x, i: F.when((x != " ") & (F.coalesce(F.get(c, i + step), F.lit(" ")) == " "), i).otherwise(F.lit(-1)))
        return F.filter(here, lambda i: i >= 0)

    return let(chars, lambda c: F.arrays_zip(edges(c, -1).alias("start"), edges(c, 1).alias("end")))


def match_spans(docs: DataFrame, bench: DataFrame, n: int = NGRAM_N,
                max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """DEC03 + DEC07: every matching window with its character span on the raw text.

    The places of a document's windows come to its row once (a list bounded by the
    document); the spans are read from its word offsets by position."""
    dirt = register_contaminants(bench, n)
    hits = find_matches(docs, dirt, n, max_broadcast_bytes=max_broadcast_bytes)
    places = materialize(hits.groupBy("doc_id").agg(F.collect_list("pos").alias("_places")))
    side, _ = checked_broadcast(places, max_broadcast_bytes, already_materialized=True)
    d = docs.select("doc_id", "text").join(side, "doc_id").select("doc_id", "_places", word_offsets("text").alias("_at"))
    spans = d.select("doc_id", "_at", F.explode("_places").alias("pos"))
    return spans.select("doc_id", F.col("pos").cast("bigint").alias("pos"),
                        F.get("_at", F.col("pos"))["start"].cast("bigint").alias("start"),
                        F.get("_at", F.col("pos") + (n - 1))["end"].cast("bigint").alias("end"))
