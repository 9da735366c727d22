"""Token ids of whole texts, blank-led word by blank-led word.

Some tokenizers never join characters across a blank that stands before a word.  The ids of a
text are then those of its blank-led words put together.  ``WordTable`` splits and
dictionary-encodes the texts of a step in Arrow, asks a coder once for each word it doesn't
know, and gathers the ids of all texts in one numpy step.  A text that can't be cut safely
(several blanks in a row, white space on both sides of a cut, special strings) goes to the
coder's library whole, so the ids are always those of the library.

A coder has ``words(list, lead)`` and ``texts(list)``, both -> (flat ids, ids of each).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import word_hashes

PLAIN, EDGE, WHOLE = 0, 1, 2                                # what a word does to its text
JOINED = 1 << 15                                           # characters of new words in one call of a library
STEP_BYTES, STEP_ROWS = 4 << 20, 4096                      # texts of one step
KNOWN_WORDS, KNOWN_BYTES = 2_000_000, 64                    # words of up to so many bytes that a worker process remembers


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + len], one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lens), lens)]


def runs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words of about JOINED characters."""
    start = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= JOINED:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(words):
        yield start, len(words)


def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)), np.array([len(x) for x in parts], dtype=np.int64)


def _distinct(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes below n, the place of each code among them)."""
    there = np.zeros(n, dtype=bool)
    there[codes] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[codes]


class ByteLevelCoder:
    """A byte-level BPE file of the tokenizers library.  ``plain_specials``: special strings
    inside a text are ordinary text; else they are found as the library does by default."""

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain_specials
        self.n_ids = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_word = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                        and pre.get("use_regex", True) and model.get("type", "BPE") == "BPE" and not model.get("dropout")
                        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in added))
        self.whole = tuple(t["content"] for t in added)
        self.whole_if_blank = False
        # The byte-level alphabet writes each byte as one character.
        self.n_bytes = np.zeros(self.n_ids, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.n_bytes[i] = len(token)
        for t in added:
            self.n_bytes[t["id"]] = len(t["content"].encode())

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return joined([np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def words(self, words: list[str], lead: bool) -> tuple[np.ndarray, np.ndarray]:
        if not lead:
            return self.texts(words)
        out = []
        for a, b in runs(words):
            some = [" " + w for w in words[a:b]]
            flat, _ = self.texts(["".join(some)])
            ends = np.cumsum([len(w.encode()) for w in some])
            found = np.concatenate([[0], np.cumsum(self.n_bytes[flat])])
            cut = np.searchsorted(found, ends)
            if len(found) > cut[-1] and np.array_equal(found[cut], ends):
                out.append((flat, np.diff(cut, prepend=0)))
            else:                                          # white space or a special string among them
                out.append(self.texts(some))
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])


class PieceCoder:
    """A sentencepiece BPE model with identity normalisation that puts a blank before a text.
    Texts whose pieces don't give back their bytes have no ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_ids = self.sp.get_piece_size()
        blank = "▁"
        piece = [self.sp.id_to_piece(i) for i in range(self.n_ids)]
        special = [self.sp.is_control(i) or self.sp.is_unknown(i) for i in range(self.n_ids)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else b"" if special[i] else p.replace(blank, " ").encode() for i, p in enumerate(piece)]
        self.n_bytes = np.array([len(x) for x in self.bytes], dtype=np.int64)
        inside = any(blank in p.lstrip(blank) for p, s in zip(piece, special) if not s)
        fixed = any(hasattr(self.sp, "is_user_defined") and self.sp.is_user_defined(i) for i in range(self.n_ids))
        self.by_word = not inside and not fixed and self.sp.encode("ﬁ a", out_type=str)[0][:1] == blank
        self.whole, self.whole_if_blank = (blank,), True

    def _exact(self, text: str, ids: list[int]) -> bool:
        return b"".join([self.bytes[i] for i in ids]) == (" " + text).encode()

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.sp.encode(texts, num_threads=1) if texts else []
        return joined([np.array(ids if t and self._exact(t, ids) else [], dtype=np.uint32) for t, ids in zip(texts, found)])

    def words(self, words: list[str], lead: bool) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for a, b in runs(words):
            text = " ".join(words[a:b])
            ids = self.sp.encode(text)
            if words[a] and self._exact(text, ids):
                flat = np.array(ids, dtype=np.uint32)
                ends = np.cumsum([len(w.encode()) + 1 for w in words[a:b]])
                found = np.concatenate([[0], np.cumsum(self.n_bytes[flat])])
                cut = np.searchsorted(found, ends)
                if np.array_equal(found[cut], ends):
                    out.append((flat, np.diff(cut, prepend=0)))
                    continue
            out.append(self.texts(words[a:b]))
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])


class Slots:
    """Numbers of words by their 128-bit hashes: open addressing, all words of a step at a time."""

    def __init__(self, most: int):
        self.mask = np.int64((1 << (2 * most - 1).bit_length()) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, dtype=np.int32)
        self.one, self.two = np.zeros(most, dtype=np.uint64), np.zeros(most, dtype=np.uint64)
        self.n = 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        out, live = np.full(len(one), -1, dtype=np.int64), np.arange(len(one))
        at = one.view(np.int64) & self.mask
        while len(live):
            there = self.slots[at]
            same = (there >= 0) & (self.one[there] == one[live]) & (self.two[there] == two[live])
            out[live[same]] = there[same]
            on = (there >= 0) & ~same
            live, at = live[on], (at[on] + 1) & self.mask
        return out

    def add(self, one: np.ndarray, two: np.ndarray) -> None:
        """Give the next numbers to distinct words that aren't in."""
        number = np.arange(self.n, self.n + len(one))
        self.one[number], self.two[number] = one, two
        self.n += len(one)
        at = one.view(np.int64) & self.mask
        while len(number):
            empty = self.slots[at] < 0
            self.slots[at[empty]] = number[empty]
            on = self.slots[at] != number
            number, at = number[on], (at[on] + 1) & self.mask


class WordTable:
    """Ids of words for one or more coders; one table a worker process.  When it is full, the
    half that most steps had stays."""

    def __init__(self, *coders, lead: bool = False, most: int = KNOWN_WORDS):
        self.coders, self.lead, self.most = coders, lead, most
        self.by_word = all(c.by_word for c in coders)
        self.whole = tuple({w for c in coders for w in c.whole})
        self.blank_kind = WHOLE if any(c.whole_if_blank for c in coders) else EDGE
        self.slots, self.kind, self.seen = Slots(most), np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int32)
        self.starts, self.lens = [np.zeros(0, dtype=np.int64) for _ in coders], [np.zeros(0, dtype=np.int32) for _ in coders]
        self.flat = [np.zeros(0, dtype=np.uint32) for _ in coders]

    def _kinds(self, words: pa.Array) -> np.ndarray:
        trimmed = pc.utf8_trim_whitespace(words)
        kind = np.where(np.asarray(pc.equal(trimmed, words)), PLAIN, EDGE).astype(np.uint8)
        kind[np.asarray(pc.binary_length(words)) == 0] = self.blank_kind
        for s in self.whole:
            kind[np.asarray(pc.match_substring(words, s))] = WHOLE
        return kind

    def _coded(self, words: pa.Array, lead: bool) -> tuple[np.ndarray, list, np.ndarray]:
        """(order, for each coder (flat, lens), kinds) of new words, plain ones first."""
        kinds = self._kinds(words)
        order = np.argsort(kinds, kind="stable")
        kinds, some = kinds[order], words.take(pa.array(order)).to_pylist()
        plain, out = int((kinds == PLAIN).sum()), []
        for coder in self.coders:
            got = [coder.words(some[:plain], lead)] if plain else []
            if plain < len(some):                          # one by one; a text with a WHOLE word doesn't use them
                got.append(coder.texts([" " + w if lead and not coder.whole_if_blank else w for w in some[plain:]]))
            flat, lens = (np.concatenate([x[i] for x in got]) for i in range(2))
            if coder.whole_if_blank:                       # a word without ids makes its text whole
                kinds[lens == 0] = WHOLE
            out.append((flat, lens))
        return order, out, kinds

    def _append(self, coded: list, kinds: np.ndarray) -> None:
        for c, (flat, lens) in enumerate(coded):
            self.starts[c] = np.concatenate([self.starts[c], len(self.flat[c]) + np.cumsum(lens) - lens])
            self.lens[c] = np.concatenate([self.lens[c], lens.astype(np.int32)])
            self.flat[c] = np.concatenate([self.flat[c], flat])
        self.kind = np.concatenate([self.kind, kinds])
        self.seen = np.concatenate([self.seen, np.zeros(len(kinds), dtype=np.int32)])

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.seen, kind="stable")[:self.most // 2])
        one, two = self.slots.one[keep], self.slots.two[keep]
        self.slots, self.kind, self.seen = Slots(self.most), self.kind[keep], self.seen[keep] // 2
        self.slots.add(one, two)
        for c in range(len(self.coders)):
            self.flat[c] = gather(self.flat[c], self.starts[c][keep], self.lens[c][keep])
            self.lens[c] = self.lens[c][keep]
            self.starts[c] = np.cumsum(self.lens[c], dtype=np.int64) - self.lens[c]

    def _places(self, wanted: list[tuple[pa.Array, bool]]) -> tuple[list[np.ndarray], int]:
        """(number of each word of each array, numbers that stay).  Longer words are numbered for
        this step only."""
        short = [np.flatnonzero(np.asarray(pc.binary_length(words)) <= KNOWN_BYTES) for words, _ in wanted]
        hashes = []
        for (words, lead), at in zip(wanted, short):
            some = words if len(at) == len(words) else words.take(pa.array(at))
            hashes.append((word_hashes(some, 3 + lead << 40), word_hashes(some, 11 + lead << 40)))
        found = [self.slots.find(*h) for h in hashes]
        if self.slots.n + sum(int((f < 0).sum()) for f in found) > self.most:
            if self.slots.n > self.most // 2:
                self._forget()
            found = [self.slots.find(*h) for h in hashes]
        out = [np.full(len(words), -1, dtype=np.int64) for words, _ in wanted]
        for k, (words, lead) in enumerate(wanted):
            new = np.flatnonzero(found[k] < 0)
            new = new[:max(0, self.most - self.slots.n)]   # what a huge step has beyond is numbered for this step only
            if len(new):
                order, coded, kinds = self._coded(words.take(pa.array(short[k][new])), lead)
                found[k][new[order]] = np.arange(self.slots.n, self.slots.n + len(new))
                self._append(coded, kinds)
                self.slots.add(hashes[k][0][new[order]], hashes[k][1][new[order]])
            out[k][short[k]] = found[k]
            self.seen[found[k][found[k] >= 0]] += 1
        stay = self.slots.n
        for k, (words, lead) in enumerate(wanted):
            rest = np.flatnonzero(out[k] < 0)
            if len(rest):
                order, coded, kinds = self._coded(words.take(pa.array(rest)), lead)
                out[k][rest[order]] = np.arange(len(self.kind), len(self.kind) + len(rest))
                self._append(coded, kinds)
        return out, stay

    def _drop(self, stay: int) -> None:
        """Forget the words numbered for one step."""
        if len(self.kind) == stay:
            return
        self.kind, self.seen = self.kind[:stay], self.seen[:stay]
        for c in range(len(self.coders)):
            self.flat[c] = self.flat[c][:int(self.starts[c][stay])]
            self.starts[c], self.lens[c] = self.starts[c][:stay], self.lens[c][:stay]

    def _library(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        some = texts.to_pylist()
        return [c.texts([" " + t if self.lead and t and not c.whole_if_blank else t for t in some]) for c in self.coders]

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each coder (flat ids, offsets by text).  With ``lead``, a text that isn't empty has
        one more blank before it."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            return [(flat, np.concatenate([[0], np.cumsum(n)])) for flat, n in self._library(texts)]
        parts = pc.split_pattern(texts, " ")
        offsets = np.asarray(parts.offsets).astype(np.int64)
        values = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        first = offsets[:-1]
        coded = values.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        if self.lead:
            (numbers,), stay = self._places([(coded.dictionary, True)])
            place = numbers[codes]
        else:
            follows = np.ones(len(codes), dtype=bool)
            follows[first] = False
            names, where = _distinct(codes[follows], len(coded.dictionary))
            heads, where_head = _distinct(codes[first], len(coded.dictionary))
            (a, b), stay = self._places([(coded.dictionary.take(pa.array(names)), True), (coded.dictionary.take(pa.array(heads)), False)])
            place = np.empty(len(codes), dtype=np.int64)
            place[follows], place[first] = a[where], b[where_head]
        kind = self.kind[place]
        bad = kind == WHOLE
        bad[1:] |= (kind[1:] > PLAIN) & (kind[:-1] > PLAIN)
        bad[first] = kind[first] == WHOLE
        whole = np.flatnonzero(np.bitwise_or.reduceat(bad, first) & (np.asarray(pc.binary_length(texts)) > 0)) if len(first) else first
        empty = np.asarray(pc.binary_length(texts)) == 0
        plain = np.ones(len(codes), dtype=bool)
        for i in np.concatenate([whole, np.flatnonzero(empty)]):
            plain[offsets[i]:offsets[i + 1]] = False
        library = self._library(texts.take(pa.array(whole))) if len(whole) else None
        out = []
        for c in range(len(self.coders)):
            lens = np.where(plain, self.lens[c][place], 0).astype(np.int64)
            flat = gather(self.flat[c], self.starts[c][place], lens)
            each = np.add.reduceat(lens, first) if len(first) else lens
            if library is not None:
                more, n = library[c]
                starts = np.cumsum(each) - each
                starts[whole], each[whole] = len(flat) + np.cumsum(n) - n, n
                flat = gather(np.concatenate([flat, more]), starts, each)
            out.append((flat, np.concatenate([[0], np.cumsum(each)])))
        self._drop(stay)
        return out


def steps(batch: pa.RecordBatch, text: int = 1, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text and STEP_ROWS rows."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(size[at - 1]) if at else 0
        end = max(at + 1, min(at + STEP_ROWS, int(np.searchsorted(size, before + most, side="right"))))
        yield batch.slice(at, end - at)
        at = end


_TABLES: dict[tuple, WordTable] = {}


def byte_table(path: str) -> WordTable:
    """One table a worker process: later tasks find its words known."""
    if ("byte", path) not in _TABLES:
        _TABLES["byte", path] = WordTable(ByteLevelCoder(path))
    return _TABLES["byte", path]


def pair_table(byte_path: str, piece_path: str) -> WordTable:
    """Both tokenizers, special strings as plain text, one blank before a text."""
    if (byte_path, piece_path) not in _TABLES:
        _TABLES[byte_path, piece_path] = WordTable(ByteLevelCoder(byte_path, plain_specials=True), PieceCoder(piece_path), lead=True, most=KNOWN_WORDS // 4)
    return _TABLES[byte_path, piece_path]
