"""Byte-level BPE encoding by prefix-sharing over the sorted distinct words.

The encoding of a word is fixed by the last token of each of its prefixes: drop the last token and what is
left is the encoding of the shorter prefix. Sorted distinct words are a depth-first walk of their trie, so one
stack of last tokens serves all words and a shared prefix is worked out once.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern over ASCII letters, digits and white space, for texts that have no other characters.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+", re.ASCII)
DEFAULT_VOCABULARY = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
#: Words and pairs of tokens remembered by one Python worker; when full a memory is emptied, which changes no result.
MEMO_WORDS, MEMO_PAIRS = 400_000, 2_000_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encoder over one vocabulary file; ``encode_words`` is exact BPE for each word."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items() if all(c in letters for c in s)}
        self.size = max(model["vocab"].values()) + 1
        self.length = [0] * self.size
        for b, i in self.ids.items():
            self.length[i] = len(b)
        # The longest token that ends in two given bytes: no longer one needs to be tried.
        self.reach: dict[bytes, int] = {}
        for b in self.ids:
            if len(b) > self.reach.get(b[-2:], 1):
                self.reach[b[-2:]] = len(b)
        # Merges in order: rank and both parts of each merged token.
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * self.size
        self.rank = [-1] * self.size
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y = self.ids[raw(a)], self.ids[raw(b)]
            t = self.ids[raw(a + b)]
            self.merged[x, y] = t
            if self.parts[t] is None:
                self.parts[t], self.rank[t] = (x, y), r
        self._fits: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self._any, self._ascii = regex.compile(PATTERN).findall, _ASCII.findall

    def find(self, text: str) -> list[str]:
        """The pieces of a text between which no merge reaches."""
        return self._ascii(text) if text.isascii() else self._any(text)

    def _stands(self, a: int, b: int) -> bool:
        """Whether the text of tokens a and b is encoded as exactly these two.

        Undo the merges of both tokens in reverse order of rank; the pair stands unless at some time the two
        tokens at the seam would have been merged before the merge undone last.
        """
        rank, parts, never = self.rank, self.parts, len(self.merged) + 1
        limit, tie = never, False
        while True:
            t = self.merged.get((a, b))
            # A merge at the seam wins if its rank is lower, or equal and further left than the one undone.
            if t is not None and (rank[t] < limit or (rank[t] == limit and tie)):
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, tie, a = ra, False, parts[a][1]
            else:
                limit, tie, b = rb, True, parts[b][0]

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Encodings of sorted distinct non-empty words, in the same order."""
        if len(self._fits) > MEMO_PAIRS:
            self._fits.clear()
        get, length, reach, size, known, stands = self.ids.get, self.length, self.reach.get, self.size, self._fits, self._stands
        out = []
        last: list[int] = [-1]  # last token of each prefix of the word at hand
        before = b""
        for w in words:
            whole = get(w)
            if whole is not None:  # every token is the encoding of its own bytes
                out.append((whole,))
                continue
            n, k, most = len(w), 0, min(len(w), len(before))
            while k < most and w[k] == before[k]:
                k += 1
            del last[k + 1 :]
            for i in range(k + 1, n + 1):
                far = reach(w[i - 2 : i], 1) if i > 1 else 1
                for j in range(i - far if i > far else 0, i):
                    t = get(w[j:i])
                    if t is None:
                        continue
                    if j:
                        key = last[j] * size + t
                        ok = known.get(key)
                        if ok is None:
                            ok = known[key] = stands(last[j], t)
                        if not ok:
                            continue
                    last.append(t)
                    break
            before = w
            tokens, i = [], n
            while i:
                t = last[i]
                tokens.append(t)
                i -= length[t]
            tokens.reverse()
            out.append(tuple(tokens))
        return out

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the offsets of each text; null is like empty."""
        words = self.words
        if len(words) > MEMO_WORDS:
            words.clear()
        split = [self.find(t) if t else () for t in texts]
        new = set(chain.from_iterable(split)).difference(words)
        if new:
            by_bytes = sorted((w.encode("utf-8"), w) for w in new)
            words.update(zip((w for _, w in by_bytes), self.encode_words([b for b, _ in by_bytes])))
        get = words.__getitem__
        per = [list(chain.from_iterable(map(get, s))) for s in split]
        offsets = np.zeros(len(per) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in per], out=offsets[1:])
        return np.fromiter(chain.from_iterable(per), dtype=np.int32, count=int(offsets[-1])), offsets


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str = DEFAULT_VOCABULARY) -> TrieEncoder:
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def slices(lengths: list[int], most: int = 2_000_000):
    """Consecutive ranges of items of at most so many characters in all, at least one item each."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if lengths:
        yield start, len(lengths)


def encode_batches(batches, key: str, text: str, path: str):
    """Arrow batches of (key, ids) for batches with a key and a text column."""
    enc = encoder(path)
    for batch in batches:
        keys, texts = batch.column(batch.schema.get_field_index(key)), batch.column(batch.schema.get_field_index(text)).to_pylist()
        for a, b in slices([len(t) if t else 0 for t in texts]):
            flat, offsets = enc.encode_texts(texts[a:b])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), ids], names=[key, "ids"])


def encode_column(docs, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY):
    """Token ids of every text, without special tokens.

    Null and empty texts give an empty list; other columns are not carried along, so their names cannot
    clash. Works on each row alone: no shuffle.
    """
    t = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        lambda batches: encode_batches(batches, key, text, path), f"`{key}` {t}, ids array<int>"
    )
