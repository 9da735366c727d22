"""Operator 1 - exact token counts at every prefix of a text (prefix dynamic programming).

Encoder: a sentencepiece BPE model with identity normalisation.  For BPE, a sequence of
pieces is the encoding of its string exactly when every adjacent pair of pieces is the
encoding of its own concatenation.  So each prefix has one last piece, the one that is
compatible with the last piece of the prefix before it, and

    count[i] = count[i - len(piece)] + tokens(piece)

fills a table with the exact token count of every prefix in one pass.  The table answers
truncation ("how many characters fit in N tokens") and budget questions without encoding
again.  No piece crosses from another character to the blank mark, so the program runs
once per distinct blank-led word and a text's table is the concatenation of its words'
tables (stored as one signed byte per code point: the change of the count).

Defined cases: null or empty text -> 0 tokens, empty table; special strings inside a text
are ordinary text; texts of any length take linear time; repeated rows give equal rows.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BLANK = "▁"
CACHED_WORDS = 600_000        # a worker process; emptied when full
CACHED_WORD_CHARS = 64
PAIRS = 1_000_000             # remembered pair checks, emptied when full


class PrefixCounts:
    """Prefix tables for one sentencepiece BPE model file.

    Token 0 stands for the start of a word and for a character outside the vocabulary:
    nothing merges with either."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if sp.encode(" \ufb01  a", out_type=str)[0][:1] != BLANK or sp.decode(sp.encode("\ufb01  a ")) != "\ufb01  a ":
            raise ValueError("the model must be BPE with identity normalisation and a leading blank")
        self.score, self.pieces = {}, [""]
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
                self.pieces.append(sp.id_to_piece(i))
        joined = [p for p in self.score if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in joined):
            raise ValueError("the model has pieces with a blank inside")
        # Between two characters that are neighbours in no piece nothing merges, so words end
        # before a blank, around a lone character and before a mark that only opens pieces.
        inside = set("".join(joined))
        lone = "".join(c for c in "\n\t\r" if c not in inside)
        marks = set(string.punctuation)
        pairs = {p[i:i + 2] for p in joined for i in range(len(p) - 1)}
        while closed := {b for a, b in pairs if b in marks and a not in marks and a != BLANK}:
            marks -= closed
        m, stop = re.escape("".join(sorted(marks))), re.escape(BLANK + lone + "".join(sorted(marks)))
        opens = f"[{BLANK}{m}]" if marks else BLANK
        self.cut = re.compile(f"{opens}+[^{stop}]*|[^{stop}]+" + (f"|[{lone}]" if lone else ""))
        self.ends: dict = {}                               # trie of reversed pieces; key "" holds the token
        for token, piece in enumerate(self.pieces):
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            if piece:
                node[""] = token
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short string: best score first, leftmost among equals."""
        parts, score = list(text), self.score.get
        pair = [score(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        while True:
            best = max((s for s in pair if s is not None), default=None)
            if best is None:
                return parts
            at = pair.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pair[at]
            if at < len(pair):
                pair[at] = score(parts[at] + parts[at + 1])
            if at:
                pair[at - 1] = score(parts[at - 1] + parts[at])

    def fits(self, left: int, token: int) -> bool:
        """Is (left, token) the encoding of its own string?"""
        a, b = self.pieces[left], self.pieces[token]
        known = self.merge(a + b) == ([a, b] if left else [b])
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | token] = known
        return known

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Tables of the given words: changes of the token count, one signed byte per code
        point.  Sorted words go on from the prefix they share with the word before."""
        ends, pairs, fits = self.ends, self.pairs, self.fits
        tables, count, last, out, previous = {}, [0], [0], bytearray(), ""
        for word in sorted(words):
            shared = len(os.path.commonprefix((word, previous)))
            del count[shared + 1:], last[shared + 1:], out[shared:]
            for i in range(shared, len(word)):
                c, k, here = word[i], i, -1
                node = ends.get(c)
                while node is not None:                    # pieces that end here, shortest first
                    token = node.get("")
                    if token is not None:
                        left = last[k]
                        good = pairs.get(left << 32 | token)
                        if good or good is None and fits(left, token):
                            here = count[k] + 1
                            last.append(token)
                            break
                    if not k:
                        break
                    k -= 1
                    node = node.get(word[k])
                if here < 0:                               # outside the vocabulary: its bytes
                    here = count[i] + len(c.encode())
                    last.append(0)
                out.append((here - count[i]) & 255)
                count.append(here)
            tables[word] = bytes(out)
            previous = word
        return tables

    def deltas(self, texts: list[str]) -> list[bytes]:
        """The tables of whole texts.  Byte 0 belongs to the blank put before the text, byte
        p to code point p; the count of the prefix of p >= 1 code points is the sum of bytes
        0..p."""
        known = self.words
        split = [self.cut.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = set().union(*split).difference(known)
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = set().union(*split)
        known.update(self.learn(list(new)))
        tables = [b"".join(map(known.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > CACHED_WORD_CHARS:
                del known[word]
        return tables


_COUNTERS: dict[str, PrefixCounts] = {}


def counter_for(model_file: str) -> PrefixCounts:
    """One counter a worker process: later tasks find its words and pairs known."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PrefixCounts(model_file)
    return _COUNTERS[model_file]


def prefix_counts(deltas: bytes) -> np.ndarray:
    """Token count of every prefix: element p is the count of the first p code points."""
    if not deltas:
        return np.zeros(1, dtype=np.int64)
    out = np.cumsum(np.frombuffer(deltas, dtype=np.int8), dtype=np.int64)
    out[0] = 0
    return out


def fitting_prefix(deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(deltas) <= budget)[-1])


def token_prefixes(docs: DataFrame, model_file: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, fit_chars (code points of the
    longest prefix within ``budget`` tokens) and prefix_deltas (the table).  Map-only."""

    def make():
        counter = counter_for(model_file)

        def step(rows):
            texts = [t or "" for t in rows["text"]]
            tables = counter.deltas(texts)
            totals = [int(np.frombuffer(t, dtype=np.int8).sum(dtype=np.int64)) for t in tables]
            return {
                "id": rows["id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": totals, "prefix_deltas": tables,
                "fit_chars": [fitting_prefix(t, budget) if n > budget else len(x) for x, t, n in zip(texts, tables, totals)],
            }

        return step

    kind = dict(docs.dtypes)[id_col]
    out = map_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
                    f"id {kind}, n_bytes bigint, n_tokens bigint, fit_chars bigint, prefix_deltas binary", make)
    return out.withColumnRenamed("id", id_col)
