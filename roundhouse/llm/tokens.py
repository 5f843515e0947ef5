"""Token ids of whole texts with a public tokenizer file, one distinct word at a time.

The word-level BPE drops white space and never merges across it, so a text's
ids are the concatenation of its words' ids; each distinct word of a worker is
encoded once.
"""

from __future__ import annotations

import os

import numpy as np

from . import text as T

MAX_CACHED = 2_000_000  # words; the cache starts anew beyond it


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known = np.empty(0, dtype=np.uint64)   # sorted word hashes
        self.place = np.empty(0, dtype=np.int64)    # their index below
        self.ids = np.empty(0, dtype=np.uint32)
        self.start = np.zeros(1, dtype=np.int64)

    def _learn(self, at: np.ndarray, hashes: np.ndarray, words: list[str]) -> None:
        """Adds sorted new hashes that belong before the known ones at ``at``."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.fromiter((i for x in lists for i in x), dtype=np.uint32, count=int(n.sum()))
        place = np.arange(len(self.start) - 1, len(self.start) - 1 + len(words))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
        self.ids = np.concatenate([self.ids, flat])
        self.known, self.place = np.insert(self.known, at, hashes), np.insert(self.place, at, place)

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int | None = None):
        """(ids of all texts, first id of each text); ``end_id`` closes every text."""
        hashes, first, starts, ends = T.word_hashes(buf, offsets)
        if len(self.known) > MAX_CACHED:
            self.clear()
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            raw = buf.tobytes()
            self._learn(at[new], distinct[new], [raw[starts[i]:ends[i]].decode("utf-8") for i in where[new]])
            at = np.searchsorted(self.known, distinct)
        word = self.place[at][inverse]
        size = self.start[word + 1] - self.start[word]
        before = np.concatenate([[0], np.cumsum(size)])
        closing = 0 if end_id is None else 1
        bounds = before[first] + closing * np.arange(len(offsets))
        out = np.empty(int(bounds[-1]), dtype=np.uint32)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        target = before[:-1] + closing * text
        step = np.arange(int(before[-1])) - np.repeat(before[:-1], size)
        out[np.repeat(target, size) + step] = self.ids[np.repeat(self.start[word], size) + step]
        if closing:
            out[bounds[1:] - 1] = end_id
        return out, bounds


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
