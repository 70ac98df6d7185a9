"""Token ids of whole texts for a word-end BPE tokenizer, many words at a time.

The tokenizer never looks across white space, so a text's ids are those of its
chunks in order.  Plain ASCII chunks are cut into words, digits and punctuation
by arrays over their bytes; distinct words are told by a 64-bit hash, and all
new ones are merged together, one merge of every word a round.  Other Latin
chunks are cut by the pattern; chunks beyond, or with a special token's text,
go through the library's own tokenizer.
"""

from __future__ import annotations

import json
import sys
import types

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from glyphmill.llm.flattext import flat, word_hashes, word_limits

_NONE = np.int32(2**30)
_LONGEST = 64
_MEMO = 250_000
_SAFE = r"[\x21-\x7e¡-įı-ſ]+"
_EMPTY = b""
_KEPT_WORDS = 1_000_000

# What a byte is in a plain chunk; chunks with odd bytes are cut by the pattern.
_LETTER, _DIGIT, _OTHER, _ODD = range(4)
_KIND = np.full(256, _OTHER, np.int8)
_KIND[128:] = _ODD
_KIND[:33] = _ODD
_KIND[[127, ord("'"), ord("|")]] = _ODD
_KIND[ord("0") : ord("9") + 1] = _DIGIT
for _first in "Aa":
    _KIND[ord(_first) : ord(_first) + 26] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class PairTable:
    """(left id, right id) -> rank, as an open-addressing hash table in arrays."""

    def __init__(self, pairs: list[tuple[int, int]], vocabulary: int):
        self.vocabulary, self.bits = vocabulary, 19
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        slots = self._slot(np.array([a * vocabulary + b for a, b in pairs], np.int64))
        for rank, ((a, b), s) in enumerate(zip(pairs, slots.tolist())):
            while self.keys[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.keys[s], self.ranks[s] = a * vocabulary + b, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.vocabulary + right
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.ranks[slot], _NONE)
        missed = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(missed):
            slot[missed] = (slot[missed] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[missed]]
            hit = seen == keys[missed]
            out[missed[hit]] = self.ranks[slot[missed[hit]]]
            missed = missed[~hit & (seen >= 0)]
        return out


class WordBpe:
    """Ids for the tokenizer file at ``path`` (lower case, white space dropped, word ends marked)."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pairs = PairTable([(vocab[a], vocab[b]) for a, b in merges], len(vocab) + 8)
        shown = _byte_symbols()
        self.inner = np.array([vocab[s] for s in shown], np.int32)
        self.final = np.array([vocab[s + "</w>"] for s in shown], np.int32)
        self.safe = regex.compile(_SAFE)
        # Fixed value: how the public tokenizer cuts a text.
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.store = Store()
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _merge_equal(self, t: np.ndarray) -> np.ndarray:
        """Fully merge words of one length (rows of symbol ids); ids padded with -1."""
        out = np.full(t.shape, -1, np.int32)
        rows = np.arange(len(t))
        r = np.full(t.shape, _NONE, np.int32)
        for c in range(t.shape[1] - 1):
            r[:, c] = self.pairs.rank(t[:, c], t[:, c + 1])
        cols = np.arange(t.shape[1])
        while len(t):
            j = r.argmin(axis=1)
            best = r[np.arange(len(t)), j]
            done = best == _NONE
            out[rows[done]] = t[done]
            t, r, rows, j, best = t[~done], r[~done], rows[~done], j[~done], best[~done]
            if not len(t):
                break
            n = np.arange(len(t))
            later = np.minimum(cols + (cols > j[:, None]), t.shape[1] - 1)
            t = np.take_along_axis(t, later, 1)
            t[n, j] = self.merged[best]
            t[:, -1] = -1  # one symbol less
            r = np.take_along_axis(r, np.minimum(cols + (cols >= j[:, None]), t.shape[1] - 1), 1)
            r[:, -1] = _NONE
            left = np.flatnonzero(j > 0)
            r[left, j[left] - 1] = self.pairs.rank(t[left, j[left] - 1], t[left, j[left]])
            after = t[n, np.minimum(j + 1, t.shape[1] - 1)]
            right = np.flatnonzero((j + 1 < t.shape[1]) & (after >= 0))
            r[n, j] = _NONE
            r[right, j[right]] = self.pairs.rank(t[right, j[right]], after[right])
        return out

    def _learn_words(self, words: list[str]) -> None:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            by_length.setdefault(len(raw), []).append((w, raw))
        for length, group in by_length.items():
            if length > _LONGEST:
                for w, _ in group:
                    self.words[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, "<i4").tobytes()
                continue
            raw = np.frombuffer(b"".join(b for _, b in group), np.uint8).reshape(-1, length)
            t = self.inner[raw]
            t[:, -1] = self.final[raw[:, -1]]
            merged = self._merge_equal(t).astype("<i4")
            sizes = (merged >= 0).sum(axis=1)
            for (w, _), ids, n in zip(group, merged, sizes):
                self.words[w] = ids[:n].tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Make every chunk known."""
        if len(self.chunks) > _MEMO:
            self.chunks, self.words = {}, {}
        parts, new = {}, {}
        for c in chunks:
            if c in self.chunks:
                continue
            if "<|" in c or not self.safe.fullmatch(c):
                self.chunks[c] = np.array(self.library.encode(c, add_special_tokens=False).ids, "<i4").tobytes()
                continue
            parts[c] = pieces = self.cut.findall(c.lower())
            for p in pieces:
                if p not in self.words:
                    new[p] = None
        self._learn_words(list(new))
        for c, pieces in parts.items():
            self.chunks[c] = _EMPTY.join([self.words[p] for p in pieces])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one more entry than texts); null is empty."""
        data, offsets = flat(texts)
        starts, ends, first = word_limits(data, offsets)
        begins = np.zeros(len(texts) + 1, np.int64)
        if not len(starts):
            return np.zeros(0, np.int32), begins
        odd = np.concatenate([[0], np.cumsum(_KIND[data] == _ODD)])
        plain = odd[ends] == odd[starts]
        a, b = self._pieces(data, starts[plain], ends[plain])
        at, size = self.store.find(word_hashes(data, a, b, lower=True), a, b, data, self)
        # Chunks that are not plain count as one piece each.
        c, d = starts[~plain], ends[~plain]
        other_ids, other_size = self._others(data, c, d)
        base = len(self.store.ids)
        place = np.concatenate([a, c])
        order = np.argsort(place, kind="stable")
        at = np.concatenate([at, base + np.cumsum(other_size) - other_size])[order]
        size = np.concatenate([size, other_size])[order]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = np.concatenate([self.store.ids, other_ids])
        found = ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        # A text's ids begin with its first piece.
        return found, total[np.searchsorted(place[order], offsets)]

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Limits of the words, digits and punctuation runs of plain chunks."""
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        kind = _KIND[data]
        new = inside.copy()
        new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[starts] = True
        begins = np.flatnonzero(new)
        stops = np.append(begins[1:], len(data))
        chunk_end = ends[np.searchsorted(starts, begins, "right") - 1]
        return begins, np.minimum(stops, chunk_end)

    def _others(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks outside ASCII or with an apostrophe or special marks, through the memo."""
        raw = data.tobytes()
        names = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        self.learn(list(dict.fromkeys(names)))
        coded = [self.chunks[c] for c in names]
        return np.frombuffer(_EMPTY.join(coded), "<i4"), np.array([len(b) >> 2 for b in coded], np.int64)

    def merged_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words and how many each has; words of one length are merged together."""
        size = ends - starts
        n_ids = np.zeros(len(size), np.int64)
        rows, parts = [], []
        for length in np.unique(size).tolist():
            group = np.flatnonzero(size == length)
            raw = _LOWER[data[starts[group][:, None] + np.arange(length)]]
            if length > _LONGEST:
                found = [self.library.encode(w.tobytes().decode(), add_special_tokens=False).ids for w in raw]
                n_ids[group] = [len(f) for f in found]
                parts.append(np.array([x for f in found for x in f], np.int32))
            else:
                t = self.inner[raw]
                t[:, -1] = self.final[raw[:, -1]]
                merged = self._merge_equal(t)
                n_ids[group] = (merged >= 0).sum(axis=1)
                parts.append(merged[merged >= 0])
            rows.append(group)
        # Back to the order of the words.
        rows, flat_ids = np.concatenate(rows), np.concatenate(parts)
        begins = np.empty(len(size), np.int64)
        begins[rows] = np.cumsum(n_ids[rows]) - n_ids[rows]
        total = np.cumsum(n_ids) - n_ids
        return flat_ids[np.repeat(begins - total, n_ids) + np.arange(int(n_ids.sum()))], n_ids


class Store:
    """Ids of known words by the 64-bit hash of the word, in arrays."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def find(self, hashes, starts, ends, data, bpe: WordBpe) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of every word; new words are merged and kept."""
        names, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        known = self._slot(names) >= 0
        if not known.all():
            if len(self.hashes) + int((~known).sum()) > _KEPT_WORDS:
                self.__init__()
                known[:] = False
            new = first[~known]
            ids, size = bpe.merged_words(data, starts[new], ends[new])
            at = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, ids])
            merged = np.concatenate([self.hashes, names[~known]])
            order = np.argsort(merged, kind="stable")
            self.hashes = merged[order]
            self.at = np.concatenate([self.at, at])[order]
            self.size = np.concatenate([self.size, size])[order]
        slot = self._slot(names)[back]
        return self.at[slot], self.size[slot]

    def _slot(self, names: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(names), -1)
        slot = np.minimum(np.searchsorted(self.hashes, names), len(self.hashes) - 1)
        return np.where(self.hashes[slot] == names, slot, -1)


def of_worker(path: str) -> WordBpe:
    """The tokenizer of this Python process: later tasks find it built, with the chunks it has learned.

    Functions travel to workers by value, so a global of this module would
    begin anew with every task; a module of its own name lasts with the process.
    """
    kept = sys.modules.setdefault("_glyphmill_worker", types.ModuleType("_glyphmill_worker"))
    known = vars(kept).setdefault("tokenizers", {})
    if path not in known:
        known[path] = WordBpe(path)
    return known[path]


def _byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    printable = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]
