"""Decontamination queries on documents x benchmark (DEC01-DEC09, AGG27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decontam as D
from .registry import duck_janitor, load, query

# ---------------------------------------------------------------- oracle pieces
_BT = f"""bt AS (SELECT item_id, list_filter(string_split_regex({duck_janitor('text')}, '\\s+'), lambda x: x <> '') AS t
               FROM benchmark)"""
_BNG = """bng AS (SELECT item_id, i - 1 AS pos, array_to_string(t[i:i+12], ' ') AS ngram
                FROM bt, LATERAL (SELECT unnest(generate_series(1, len(t) - 12)) AS i))"""
_DW = f"""dw AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''),
                                          lambda x: {duck_janitor('x')}) AS t FROM documents)"""
_HITS = """hits AS (SELECT doc_id, i - 1 AS pos, array_to_string(t[i:i+12], ' ') AS ngram
                 FROM dw, LATERAL (SELECT unnest(generate_series(1, len(t) - 12)) AS i)
                 WHERE array_to_string(t[i:i+12], ' ') IN (SELECT ngram FROM bng))"""
_WORDS = """pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS j
                   FROM (SELECT doc_id, string_split(regexp_replace(text, '\\s', ' ', 'g'), ' ') AS p
                         FROM documents WHERE doc_id IN (SELECT doc_id FROM hits))),
offs AS (SELECT doc_id, j, piece, coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY j
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM pieces),
wds AS (SELECT doc_id, off, length(piece) AS plen,
               row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS widx FROM offs WHERE piece <> '')"""

_CHUNKS = f"""WITH {_BT}, {_BNG}, {_DW}, {_HITS},
cnt AS (SELECT doc_id, count(*) AS m FROM hits GROUP BY doc_id),
first_hits AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM hits
               QUALIFY k <= 11),
{_WORDS},
spans AS (SELECT f.doc_id, f.k, s.off AS st, e.off + e.plen - 1 AS en FROM first_hits f
          JOIN wds s ON s.doc_id = f.doc_id AND s.widx = f.pos
          JOIN wds e ON e.doc_id = f.doc_id AND e.widx = f.pos + 12),
win AS (SELECT s.doc_id, s.k, greatest(0, st - 200) AS lo, least(length(d.text), en + 200) AS hi
        FROM spans s JOIN documents d USING (doc_id)),
mids AS (SELECT doc_id, k, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY k), 0) AS a, lo AS b FROM win),
lasts AS (SELECT doc_id, arg_max(hi, k) AS last_hi FROM win GROUP BY doc_id),
docs AS (SELECT d.doc_id, d.text, length(d.text) AS len, coalesce(c.m, 0) AS m, coalesce(l.last_hi, -1) AS last_hi
         FROM documents d LEFT JOIN cnt c USING (doc_id) LEFT JOIN lasts l USING (doc_id)),
chunks AS (
  SELECT x.doc_id, x.k AS ord, substring(d.text, CAST(x.a + 1 AS BIGINT), CAST(x.b - x.a AS BIGINT)) AS chunk
  FROM mids x JOIN docs d USING (doc_id) WHERE d.m <= 10 AND x.b - x.a > 200
  UNION ALL
  SELECT doc_id, 1000000 AS ord, substring(text, CAST(last_hi + 2 AS BIGINT), CAST(len - last_hi - 1 AS BIGINT)) AS chunk
  FROM docs WHERE m <= 10 AND last_hi < len - 200)"""

ORACLE_REPORT = _CHUNKS + """
SELECT d.doc_id, CAST(d.m AS BIGINT) AS n_matches,
       CASE WHEN d.m > 10 THEN 'dropped' WHEN d.m > 0 THEN 'cut' ELSE 'clean' END AS status,
       CAST(count(c.chunk) AS BIGINT) AS n_chunks, CAST(coalesce(sum(length(c.chunk)), 0) AS BIGINT) AS kept_chars
FROM docs d LEFT JOIN chunks c USING (doc_id)
GROUP BY d.doc_id, d.m"""

ORACLE_CLEAN = _CHUNKS + """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS chunk_idx, chunk
FROM chunks"""

ORACLE_SPANS = f"""WITH {_BT}, {_BNG}, {_DW}, {_HITS}, {_WORDS}
SELECT h.doc_id, CAST(h.pos AS BIGINT) AS pos, CAST(s.off AS BIGINT) AS start,
       CAST(e.off + e.plen - 1 AS BIGINT) AS "end"
FROM hits h JOIN wds s ON s.doc_id = h.doc_id AND s.widx = h.pos
            JOIN wds e ON e.doc_id = h.doc_id AND e.widx = h.pos + 12"""

ORACLE_ITEMS = f"""WITH {_BT}, {_BNG}, {_DW}, {_HITS},
items AS (SELECT DISTINCT item_id, ngram FROM bng)
SELECT i.item_id, CAST(count(DISTINCT h.doc_id) AS BIGINT) AS n_docs, CAST(count(*) AS BIGINT) AS n_windows
FROM hits h JOIN items i USING (ngram) GROUP BY i.item_id"""

ORACLE_WORD_NGRAMS = f"""WITH {_BT}, {_BNG}
SELECT item_id, CAST(pos AS INTEGER) AS pos, ngram FROM bng"""

_CORPUS = f"""ct AS (SELECT doc_id, list_filter(string_split_regex({duck_janitor('text')}, '\\s+'), lambda x: x <> '') AS t
               FROM documents)"""


def _corpus_grams(n: int) -> str:
    return f"""cg AS (SELECT DISTINCT doc_id, array_to_string(t[i:i+{n - 1}], ' ') AS ngram
                FROM ct, LATERAL (SELECT unnest(generate_series(1, len(t) - {n - 1})) AS i))"""


ORACLE_FREQUENT = f"""WITH {_CORPUS}, {_corpus_grams(3)}
SELECT ngram, CAST(count(*) AS BIGINT) AS n_docs FROM cg GROUP BY ngram HAVING count(*) > 10"""

ORACLE_CORPUS = f"""WITH {_CORPUS}, {_corpus_grams(13)}
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_ngrams FROM cg GROUP BY doc_id"""

ORACLE_DIRT = f"""WITH {_BT}, {_BNG}, {_CORPUS}, {_corpus_grams(13)},
freq AS (SELECT ngram FROM cg GROUP BY ngram HAVING count(*) > 10)
SELECT DISTINCT ngram FROM bng WHERE ngram NOT IN (SELECT ngram FROM freq)"""

ORACLE_NORMALIZE = f"""SELECT item_id, {duck_janitor('text')} AS normalized FROM benchmark"""


# ---------------------------------------------------------------- queries
@query("contamination_report", ORACLE_REPORT)
def q_contamination_report(spark, sf_dir):
    """Flagship: which training documents contain benchmark text, and what is left."""
    return D.contamination_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("clean_documents", ORACLE_CLEAN)
def q_clean_documents(spark, sf_dir):
    return D.clean_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("match_ngrams", ORACLE_SPANS)
def q_match_ngrams(spark, sf_dir):
    return D.match_spans(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("item_contamination", ORACLE_ITEMS)
def q_item_contamination(spark, sf_dir):
    return D.item_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("word_ngrams", ORACLE_WORD_NGRAMS)
def q_word_ngrams(spark, sf_dir):
    return D.benchmark_ngrams(load(spark, sf_dir, "benchmark")).select("item_id", "pos", "ngram")


@query("frequent_ngrams", ORACLE_FREQUENT)
def q_frequent_ngrams(spark, sf_dir):
    return D.frequent_ngrams(load(spark, sf_dir, "documents"), n=3, min_docs=10)


@query("corpus_ngrams", ORACLE_CORPUS)
def q_corpus_ngrams(spark, sf_dir):
    return (D.corpus_ngrams(load(spark, sf_dir, "documents"))
            .groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_ngrams")))


@query("dirt_ngrams", ORACLE_DIRT)
def q_dirt_ngrams(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    freq = D.frequent_ngrams(docs, n=13, min_docs=10)
    return D.register_contaminants(load(spark, sf_dir, "benchmark"), exclude=freq).select("ngram")


@query("janitor_normalize", ORACLE_NORMALIZE)
def q_janitor_normalize(spark, sf_dir):
    from ..functions.text import janitor_normalize
    return load(spark, sf_dir, "benchmark").select("item_id", janitor_normalize("text").alias("normalized"))
