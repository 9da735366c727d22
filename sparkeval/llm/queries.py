"""Registered queries of the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .bpe_codec import bpe_round_trip
from .collocations import collocations
from .common import read
from .decontaminate import find_leaks
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality_rules import BOILERPLATE_PATTERN, SEPARATORS, quality_rules
from .secret_scan import secret_scan
from .substring_dedup import substring_dedup
from .token_counts import token_prefixes
from .token_files import encode_and_read
from .url_filter import url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of every document from its prefix table; fit_chars answers how many
    code points fit in 4096 tokens."""
    out = token_prefixes(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), budget=4096)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "fit_chars")


@query("op2_substring_dedup", oracle=r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, i, ws[i:i + 12] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (k) WHERE first < doc_id),
gone_by AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n_words, len(coalesce(g, [])) AS n_removed,
                CASE WHEN g IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END AS ks
         FROM w LEFT JOIN gone_by USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept""")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a 13-word window of an earlier document covers."""
    return substring_dedup(read(spark, sf_dir, "documents"))


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget, with the best place."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op4_line_dedup", oracle=r"""
WITH lines AS (
  SELECT doc_id, i, lines[i + 1] AS line FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
worded AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT doc_id, i AS s, lead(i, 2) OVER w AS e, [line, lead(line, 1) OVER w, lead(line, 2) OVER w] AS k
  FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows WHERE e IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM ranked WHERE r > 1),
marked AS (SELECT l.*, c.i IS NOT NULL AS gone, regexp_matches(line, '[^\x20\x09-\x0D]') AS word FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.i = c.i)
SELECT doc_id, count(*) FILTER (WHERE word) AS n_lines, count(*) FILTER (WHERE word AND gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word, how many of them repeat an earlier three-line window, and the digest
    of the text that stays, per document."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SYMBOLS = "CAST(length(regexp_replace({}, '[^#*$%&|<>]', '', 'g')) AS BIGINT)"
_SEPARATORS = ", ".join(f"'{x}'" for x in SEPARATORS)


@query("op5_quality_rules", oracle=f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
grams AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
          SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams JOIN again USING (doc_id, g)) GROUP BY doc_id),
lines AS (SELECT doc_id, line, {_WORDS.format("line")} AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
judged AS (SELECT doc_id, line, len(lw) AS n, len(list_filter(lw, lambda x: x IN ({_SEPARATORS}))) AS bars, {_SYMBOLS.format("line")} AS sym,
                  regexp_matches(line, '(?i){BOILERPLATE_PATTERN}') AS boiler FROM lines WHERE len(lw) > 0),
ruled AS (SELECT *, CASE WHEN bars >= 3 AND n - bars <= 4 * (bars + 1) THEN 'n' WHEN sym > 0.5 * n THEN 'p' WHEN n <= 30 AND boiler THEN 'b' END AS why FROM judged),
by_doc AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, CAST(coalesce(sum(n) FILTER (WHERE why IS NOT NULL), 0) AS BIGINT) AS n_lost_words,
                  count(*) FILTER (WHERE why = 'p') AS n_punctuation, count(*) FILTER (WHERE why = 'n') AS n_navigation,
                  count(*) FILTER (WHERE why = 'b') AS n_boilerplate FROM ruled GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, {_SYMBOLS.format("text")} AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0) AS n_lost_words,
             coalesce(n_punctuation, 0) AS n_punctuation, coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN by_doc USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_lost_words <= 0.3 * n_words AS kept FROM f""")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, whole-text verdict and line-first verdict of every document."""
    return quality_rules(read(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document.  The table names no owners: a document stands for a
    repository and its source for the owner."""
    return secret_scan(read(spark, sf_dir, "documents"), repo=F.col("doc_id"), owner=F.col("source"))


@query("op7_near_dedup")
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, from the files written."""
    return encode_and_read(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_bpe_codec")
def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the bytes they decode to, as digests."""
    return bpe_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


# Fixed rules of the contract: (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op10_url_filter")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL.  Training labels: rows of ``labels`` whose id is a page's,
    block where the quality is 0."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("block"))
    return url_filter(read(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES)


@query("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_collocations", oracle=r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(range(len(p))) AS piece, unnest(p) AS t FROM (
    SELECT *, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
split AS (SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (SELECT lang, ws[i:i + k - 1] AS g, k FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM split, (VALUES (1), (2), (3)) AS ks(k) WHERE len(ws) >= k)),
f AS (SELECT lang, g, k, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, g, k),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
halves AS (SELECT lang, g, f AS a, cut, g[1:cut] AS head, g[cut + 1:] AS tail FROM candidates, (VALUES (1), (2)) AS t(cut) WHERE cut < k),
cuts AS (SELECT h.lang, h.g, a, x.f AS l, y.f AS r, cut, (1000000 * a * a) // (x.f * y.f) AS score
         FROM halves h JOIN f x ON x.lang = h.lang AND x.g = h.head JOIN f y ON y.lang = h.lang AND y.g = h.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inside AS (SELECT lang, g, max(f) AS longer FROM (SELECT lang, g[1:2] AS g, f FROM candidates WHERE k = 3 UNION ALL SELECT lang, g[2:3], f FROM candidates WHERE k = 3) GROUP BY lang, g),
kept AS (SELECT x.* FROM lowest x LEFT JOIN inside i ON i.lang = x.lang AND i.g = x.g WHERE i.longer IS NULL OR 100 * i.longer < 50 * x.a),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) JOIN n USING (lang) WHERE rank <= 2000""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language by score."""
    return collocations(read(spark, sf_dir, "documents"))
