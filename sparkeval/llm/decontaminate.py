"""Operator 3 - benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items are lower-cased and every run of characters that are neither
letters nor digits becomes one blank.  An item of length L may occur with up to
``floor(error_rate * L)`` edits.  It is split into one piece more than that budget, so any
occurrence holds at least one piece unchanged; an Aho-Corasick automaton finds all exact
piece hits, and Myers' bit-parallel distance verifies the neighbourhood of each.

The items are the query set, written in blocks of bounded size (``block_bytes`` of text) to the
shared folder.  A block is one automaton; a worker keeps ``KEPT`` of them, which one map-only
scan of the documents asks one after the other, so a text is normalised once for all of them.

Defined cases: null or empty texts hold nothing; items shorter than ``min_chars`` after
normalisation are searched without edits, as whole words; items without a letter or digit (null
ones too) hold nothing to search; of places with the same distance the first counts; equal items each give their own row; repeated documents give equal rows; an empty benchmark
leaves every document alone; a text is scanned once, whatever its length.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, new_shared_path

ERROR_RATE = 0.08
MIN_CHARS = 32
BLOCK_BYTES, KEPT = 4 << 20, 8                            # text of a block; blocks that a worker process keeps


def normalise(texts: list[str | None]) -> list[str]:
    low = pc.utf8_lower(pc.fill_null(pa.array(texts, pa.large_string()), ""))
    return pc.utf8_trim(pc.replace_substring_regex(low, pattern=r"[^\pL\pN]+", replacement=" "), characters=" ").to_pylist()


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """budget + 1 nearly equal spans that cover 0..length."""
    n = budget + 1
    cuts = [length * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_occurrence(pattern_masks: dict[str, int], n: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Myers: (least edit distance of the pattern to a substring of ``text``, end of the first
    such substring).  ``anchored``: the substring starts at the text's start."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, score, best, at = full, 0, n, n, 0
    for j, c in enumerate(text):
        eq = pattern_masks.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp) & full
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 | anchored
        hn <<= 1
        vp = (hn | ~(xv | hp)) & full
        vn = hp & xv & full
        if score < best:
            best, at = score, j + 1
    return best, at


class PieceIndex:
    """Automaton over the pieces of one block of items."""

    def __init__(self, items: list[tuple], error_rate: float, min_chars: int):
        import ahocorasick

        self.items = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            short = len(text) < min_chars                   # exact, as whole words
            budget = 0 if short else int(error_rate * len(text))
            number = len(self.items)
            self.items.append((item_id, text, budget, None if short else masks(text), None if short else masks(text[::-1])))
            for a, b in pieces(len(text), budget):
                where.setdefault(text[a:b], []).append((number, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def search(self, text: str, first_only: bool = False) -> list[tuple]:
        """(item id, distance, start, end) of the best occurrence of each item found."""
        starts: dict[int, set[int]] = {}
        if len(self.automaton) and text:
            for end, (size, places) in self.automaton.iter(text):
                for number, offset in places:
                    starts.setdefault(number, set()).add(end + 1 - size - offset)
        found = []
        for number, guesses in starts.items():
            item_id, item, budget, forward, backward = self.items[number]
            n, best, spans = len(item), None, []
            if forward is None:
                at = min((a for a in guesses if (not a or text[a - 1] == " ") and text[a + n:a + n + 1] in ("", " ")), default=None)
                if at is not None:
                    found.append((item_id, 0, at, at + n))
                    if first_only:
                        break
                continue
            for at in sorted(guesses):                     # guesses of one place differ by shifts: one window
                if spans and at - spans[-1][1] <= budget:
                    spans[-1][1] = at
                else:
                    spans.append([at, at])
            for first, last in spans:
                lo = max(0, first - budget)
                window = text[lo:last + n + budget]
                exact = window.find(item)
                d, end = (0, exact + n) if exact >= 0 else best_occurrence(forward, n, window)
                if d <= budget and (best is None or d < best[0]):
                    _, back = (0, n) if exact >= 0 else best_occurrence(backward, n, window[:end][::-1][:n + budget], True)
                    best = (d, lo + end - back, lo + end)
                    if d == 0 or first_only:
                        break
            if best:
                found.append((item_id, *best))
                if first_only:
                    break
        return sorted(found, key=lambda x: (x[2], x[3], str(x[0])))


_INDEXES: dict = {}


def index_for(path: str, block: int, error_rate: float, min_chars: int) -> PieceIndex:
    """One index a worker process and block; the oldest goes when there are more than KEPT."""
    key = path, block, error_rate, min_chars
    if key not in _INDEXES:
        where, inner = fs.FileSystem.from_uri(path)
        there = where.get_file_info(f"{inner}/block={block}").type != fs.FileType.NotFound
        rows = pq.read_table(f"{inner}/block={block}", filesystem=where, columns=["id", "text"], partitioning=None).to_pydict() if there else {"id": [], "text": []}
        while len(_INDEXES) >= KEPT:
            _INDEXES.pop(next(iter(_INDEXES)))
        _INDEXES[key] = PieceIndex(list(zip(rows["id"], rows["text"])), error_rate, min_chars)
    return _INDEXES[key]


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> tuple[str, list[range]]:
    """(folder of the normalised query set in blocks of about ``block_bytes``, the blocks of each
    scan of the documents)."""
    kind = dict(items.dtypes)[item_id]
    clean = map_texts(items.select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("text")), f"id {kind}, text string",
                      lambda: lambda rows: {"id": rows["id"], "text": normalise(rows["text"])}).filter(F.length("text") > 0)
    size = clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    path = new_shared_path(items.sparkSession, "items")
    clean.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(max(1, n)))).repartition(max(1, n), "block").write.partitionBy("block").parquet(path)
    return path, [range(at, min(at + KEPT, n)) for at in range(0, n, KEPT)]


def find_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES,
               id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item id, distance, start, end) of the best occurrence of each item in each
    document that holds it; places count characters of the normalised text."""
    schema = f"id {dict(docs.dtypes)[id_col]}, item {dict(items.dtypes)[item_id]}, distance int, start bigint, end bigint"
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    path, scans = item_blocks(items, item_id, item_text, block_bytes)
    out = None
    for blocks in scans:

        def make(blocks=blocks):
            def step(rows):
                texts, found = normalise(rows["text"]), []
                for b in blocks:
                    index = index_for(path, b, error_rate, min_chars)
                    found += [(i, *x) for i, t in zip(rows["id"], texts) for x in index.search(t)]
                return dict(zip(("id", "item", "distance", "start", "end"), map(list, zip(*found)))) if found else {n: [] for n in ("id", "item", "distance", "start", "end")}

            return step

        part = map_texts(narrow, schema, make)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_id})


def drop_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES,
               text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pipeline form: rows of ``docs`` that hold no benchmark item, all columns; map-only."""
    path, scans = item_blocks(items, item_id, item_text, block_bytes)

    def holds(blocks: range):
        @F.pandas_udf("boolean")
        def leaks(texts: pd.Series) -> pd.Series:
            clean = normalise(texts.tolist())
            found = [False] * len(clean)
            for b in blocks:
                index = index_for(path, b, error_rate, min_chars)
                found = [f or bool(index.search(t, first_only=True)) for f, t in zip(found, clean)]
            return pd.Series(found, dtype=bool)

        return leaks

    for blocks in scans:
        docs = docs.filter(~holds(blocks)(F.col(f"`{text_col}`").cast("string")))
    return docs
