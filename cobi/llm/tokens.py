"""Token ids of whole texts by a public tokenizer, encoding each word once.

The vocabulary used here never joins characters across white space, so a text's
ids are its white-space separated words' ids in order.  A chunk's distinct words
are found by hash on its bytes; only words that this worker has not seen yet go
through the tokenizer, in one text with a mark between them, and the rest is
array gathering.  Words are encoded as they stand (case and special-token strings
included), so ids equal those of ``Tokenizer.encode(text,
add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np

from cobi.llm import words as W

TOKENIZER = "word_bpe_49k.json"
END = 1                # id that ends each document
REMEMBERED = 1_000_000  # words a worker remembers; then it starts anew
_MARK = 1              # a control byte, one token of its own between spaces


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray, between: bytes) -> bytes:
    """The pieces data[start:end] with ``between`` after each."""
    gap = np.frombuffer(between, dtype=np.uint8)
    size = end - start
    stop = np.cumsum(size + len(gap))
    out = np.empty(int(stop[-1]) if len(stop) else 0, dtype=np.uint8)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(stop - size - len(gap), size) + place] = data[np.repeat(start, size) + place]
    for k, b in enumerate(gap):
        out[stop - len(gap) + k] = b
    return out.tobytes()


class Encoder:
    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        if not os.path.isabs(name):
            import public_tokenizers
            name = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(name)
        mark = self._ids(chr(_MARK))
        # the mark must be one id that no word without it can have
        self.mark = mark[0] if len(mark) == 1 and self._ids(f"a {chr(_MARK)} a") == [*self._ids("a"), *mark, *self._ids("a")] else None
        self._forget()

    @staticmethod
    def shared(name: str = TOKENIZER) -> Encoder:
        """The encoder of this process: it remembers words over tasks."""
        kept = sys.modules.setdefault("_shared_encoders", types.ModuleType("_shared_encoders")).__dict__
        if name not in kept:
            kept[name] = Encoder(name)
        return kept[name]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=W.U64)       # hashes of the words, sorted
        self.slots = np.zeros(0, dtype=np.int64)   # their slots: slot k has ids[limit[k]:limit[k + 1]]
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.limit = np.zeros(1 << 14, dtype=np.int64)

    def _encode_words(self, w: W.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of the words."""
        start, end = w.start[which], w.end[which]
        has_mark = np.concatenate([[0], np.cumsum(w.data == _MARK)])
        alone = has_mark[end] > has_mark[start]
        if self.mark is None or alone.any():
            parts = [self._ids(w.text(int(k)).decode("utf-8", "replace")) for k in which]
            return np.array([x for p in parts for x in p], np.uint32), np.array([len(p) for p in parts], np.int64)
        text = gathered(w.data, start, end, b" \x01 ").decode("utf-8", "replace")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        marks = ids == self.mark
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def _learn(self, w: W.Words, keys: np.ndarray, which: np.ndarray) -> None:
        new, sizes = self._encode_words(w, which)
        n, used = len(self.keys), int(self.limit[len(self.keys)])
        while n + len(keys) + 1 > len(self.limit):
            self.limit = np.concatenate([self.limit, np.zeros_like(self.limit)])
        while used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.limit[n + 1:n + 1 + len(keys)] = used + np.cumsum(sizes)
        self.ids[used:used + len(new)] = new
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slots = np.insert(self.slots, at, np.arange(n, n + len(keys)))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids, limits) of a chunk of documents, each followed by ``end``."""
        w = W.Words(data, offsets, W.NON_SPACE)
        keys, first, place = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            self._learn(w, keys[new], first[new])
        slots = self.slots[np.searchsorted(self.keys, keys)]
        begin, size = self.limit[slots][place], (self.limit[slots + 1] - self.limit[slots])[place]
        word_end = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - word_end[:-1], size) + np.arange(word_end[-1])]
        limits = word_end[w.first]
        if end is not None:
            ids = np.insert(ids, limits[1:], end)
            limits = limits + np.arange(len(limits))
        return ids, limits
