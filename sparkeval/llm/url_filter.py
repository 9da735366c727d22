"""Operator 10 - URL filter: fixed host/path rules, then mined association rules
(DataFrame functions and Spark's FP-growth only).

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, its path
what follows up to ``?``, ``#`` or the end.  A fixed rule fits its host and all subdomains
when the path starts with the rule's; the longest fitting rule decides.  For the other URLs
the method decides: FP-growth mines token combinations of labelled URLs that go with the
label ``block``; rules are pruned by support, confidence and redundancy and matched by an
inverted index (token -> rule): a rule fits when all its tokens are among the URL's.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule and
verdict allow; equal URLs get equal verdicts; no labelled block rows: no mined rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label=block"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a URL; empty strings where there is no ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    part = lambda k: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    return F.translate(part(1), UPPER, LOWER), part(2), part(3)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting (verdict, host, path) rule, or nulls."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def url_tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens: host labels with their place from the right, path words, query keys."""
    labels = F.transform(F.reverse(F.split(host, r"\.")), lambda x, i: F.concat(F.lit("h"), F.least(i, F.lit(4)).cast("string"), F.lit(":"), x))
    words = F.transform(F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(labels, words, keys))


def mine_rules(urls: DataFrame, labels: DataFrame, min_support: float = 0.001, min_confidence: float = 0.6,
               min_rows: int = 10) -> DataFrame:
    """Association rules (rule_id, tokens, confidence, support) with the consequent block.

    ``urls`` (id, tokens) joins ``labels`` (id, block).  FP-growth keeps tokens of at least
    ``min_support`` of the labelled rows (and ``min_rows`` of them), which bounds what it holds; a rule goes when
    another rule on fewer of the same tokens is as confident."""
    rows = urls.join(labels, "id").select(F.when(F.col("block"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items"))
    support = min(1.0, max(min_support, min_rows / max(1, rows.count())))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK))).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support").withColumn("rule_id", F.xxhash64("tokens"))
    each = rules.select("rule_id", F.size("tokens").alias("n"), "confidence", F.explode("tokens").alias("token"))
    inside = (each.alias("s").join(each.alias("l"), (F.col("s.token") == F.col("l.token")) & (F.col("s.n") < F.col("l.n")) & (F.col("s.confidence") >= F.col("l.confidence")))
              .groupBy(F.col("s.rule_id").alias("s"), F.col("l.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("shared"), F.max("s.n").alias("n"))
              .filter("shared = n").select("rule_id").distinct())
    return rules.join(inside, "rule_id", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct keys of ``urls`` (key, tokens) on which a rule fits, with the best rule's
    confidence.  The index side is broadcast only when measured small."""
    index, _ = checked_broadcast(rules.select(F.explode("tokens").alias("token"), "rule_id", F.size("tokens").alias("n"), "confidence"), max_bytes=16 << 20)
    hits = urls.select("key", F.explode("tokens").alias("token")).join(index, "token")
    fits = hits.groupBy("key", "rule_id").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("confidence").alias("confidence")).filter("c = n")
    return fits.groupBy("key").agg(F.max("confidence").alias("confidence"))


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], min_support: float = 0.001, min_confidence: float = 0.6,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and mined_confidence (null where no mined rule fits) per
    row of ``pages``; ``labels`` has (id, block) for some of the ids."""
    host, path, query = url_parts(F.col("url"))
    seen = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", "url", host.alias("host"), path.alias("path"), query.alias("query"))
    tokens = url_tokens(F.col("host"), F.col("path"), F.col("query"))
    mined = mine_rules(seen.filter(F.col("host") != "").select("id", tokens.alias("tokens")), labels, min_support, min_confidence)
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    judged = seen.withColumns({"rule": rule, "by_rule": verdict})
    open_urls = judged.filter(F.col("rule").isNull() & (F.col("host") != "")).select(F.col("url").alias("key"), "host", "path", "query").distinct()
    hits = match_rules(open_urls.select("key", tokens.alias("tokens")), mined)
    out = judged.join(hits, (F.col("url") == F.col("key")) & F.col("rule").isNull(), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule",
                      F.coalesce("by_rule", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
                      F.col("confidence").alias("mined_confidence"))
