"""Operator 6 - secret scan with corpus-wide ownership frequency.

Every text is scanned once for the base patterns (assign, access, hex) and for candidates:
long mixed tokens that may be credentials.  Hashes of all candidate values are aggregated
over the corpus by distinct repositories and owners: a value that many owners hold is a
copied example, a value that stays with few owners looks live.  Live-looking candidates
outside the base spans are added as spans of kind ``owned``; base spans always stay and
carry the same verdict in the counts n_live and n_example.

Positions are code points, ends exclusive.  Defined cases: a null or empty text has no spans;
a null owner or repository counts as one owner or repository of its own; rows with the same
id and text give equal rows; the scan is linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, write_shared

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")          # same spans as [0-9a-f]+ with shorter matches dropped
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "owned")
MIN_ENTROPY = 3.0                            # bits a character of a candidate


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in map(s.count, set(s)))


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the base patterns."""
    low = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        low += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    low += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(low)


def extra_candidates(text: str, taken: list) -> list[tuple[int, int]]:
    """Long tokens of mixed letters and digits that overlap no base span; ``taken`` is sorted by
    start, so one pass over both lists tells: of the spans that start before a token ends, the
    one that reaches farthest."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        s = m.group()
        while i < len(taken) and taken[i][0] < m.end():
            reach = max(reach, taken[i][2])
            i += 1
        if reach <= m.start() and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= MIN_ENTROPY:
            out.append((m.start(), m.end()))
    return out


def _hash(value: str) -> bytes:
    return hashlib.blake2b(value.encode(), digest_size=16).digest()


def scan(docs: DataFrame, id_col: str, text_col: str, repo: F.Column, owner: F.Column) -> DataFrame:
    """id, repo, owner, kinds / starts / ends / hashes of all spans and candidates."""

    def make():
        def step(rows):
            out = {k: [] for k in ("kinds", "starts", "ends", "hashes")}
            for text in rows["text"]:
                text = text or ""
                base = base_spans(text)
                spans = sorted([(s, k, e, _hash(text[a:b])) for s, k, e, a, b in base] + [(s, 3, e, _hash(text[s:e])) for s, e in extra_candidates(text, base)])
                for name, i in (("starts", 0), ("kinds", 1), ("ends", 2), ("hashes", 3)):
                    out[name].append([x[i] for x in spans])
            return {n: rows[n] for n in ("id", "repo", "owner")} | out

        return step

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"))
    return map_texts(narrow, f"id {dict(docs.dtypes)[id_col]}, repo string, owner string, kinds array<int>, starts array<int>, ends array<int>, hashes array<binary>", make)


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners, n_spans over the whole corpus.  Partial aggregation by
    (hash, repo, owner) first, so a value copied into a third of all rows stays small."""
    own = F.coalesce(F.concat(F.lit("="), F.col("owner")), F.lit(""))
    held = (scanned.select(own.alias("owner"), F.coalesce(F.concat(F.lit("="), F.col("repo")), F.lit("")).alias("repo"), F.explode("hashes").alias("hash"))
            .groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n")))
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
    repos = held.select("hash", "repo").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"))
    owners = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_spans"))
    return owners.join(repos, "hash")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: F.Column | None = None, owner: F.Column | None = None,
                max_owners: int = 2, max_repos: int | None = None) -> DataFrame:
    """Per row of ``docs``: id, n_assign, n_access, n_hex, n_owned, n_live, n_example,
    base_sha256 and spans (kind:start:end by start then kind, comma-joined).

    A value is live-looking when at most ``max_owners`` owners hold it, else a copied example:
    an owner may copy its own secret into any number of repositories.  ``max_repos`` bounds
    the repositories too where a caller wants that."""
    seen = write_shared(scan(docs, id_col, text_col, F.col(id_col) if repo is None else repo, F.col("source") if owner is None else owner)
                        .withColumn("row", F.expr("uuid()")), "secrets")
    each = seen.filter(F.size("hashes") > 0).select("row", F.explode(F.arrays_zip("kinds", "starts", "ends", "hashes")).alias("s"))
    each = each.select("row", F.col("s.kinds").alias("kind"), F.col("s.starts").alias("start"), F.col("s.ends").alias("end"), F.col("s.hashes").alias("hash"))
    few = F.col("n_owners") <= max_owners
    if max_repos is not None:
        few = few & (F.col("n_repos") <= max_repos)
    live = ownership(seen).select("hash", few.alias("live"))
    kept = each.join(live, "hash").filter((F.col("kind") < 3) | F.col("live"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))),
                         lambda x: F.struct(x["kind"].alias("kind"), x["live"].alias("live"), F.concat_ws(
                             ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")).alias("s")))
    found = kept.groupBy("row").agg(listed.alias("list"))                # the spans of one document
    rows = seen.select("row", F.col("id").alias(id_col)).join(found, "row", "left")
    spans = F.coalesce(F.col("list"), F.array().cast("array<struct<kind:int,live:boolean,s:string>>"))
    of_kind = lambda k: lambda x: x["kind"] == k
    count = lambda test: F.size(F.filter(spans, test)).cast("bigint")
    text = lambda test: F.array_join(F.transform(F.filter(spans, test), lambda x: x["s"]), ",")
    return rows.select(
        F.col(id_col), *[count(of_kind(k)).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        count(lambda x: x["live"]).alias("n_live"), count(lambda x: ~x["live"]).alias("n_example"),
        F.sha2(text(lambda x: x["kind"] < 3).cast("binary"), 256).alias("base_sha256"), text(lambda x: F.lit(True)).alias("spans"))
