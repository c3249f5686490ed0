"""Words of whole text columns, found and hashed on the UTF-8 bytes.

Every word class of the operators is a set of bytes (all separators are
ASCII), so a batch of texts is one byte array: word limits come from two
comparisons of a mask with its shifted self, and each word's 64-bit hash from
eight bytes at a time.  Nothing here loops over documents or words in Python.

Words are compared by 64-bit hash; callers that decide equality on sequences
use two independent 64-bit hashes (``mix`` with different salts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)

#: bytes of a word for ``[^\x20\x09-\x0D]+``
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: bytes of a word for ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, every other byte as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: texts are worked on in pieces of about this many bytes, whole documents each
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser; a salt gives an independent-looking hash."""
    x = x ^ U64((salt * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * _M2
    x = (x ^ (x >> U64(27))) * _M3
    return x ^ (x >> U64(31))


class Words:
    """Words of a run of documents.

    ``data`` bytes (folded), ``start``/``end`` byte limits of each word,
    ``first`` word number at which each document starts (one more entry than
    documents).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = table[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        full = offsets[:-1] < offsets[1:]
        edge = offsets[:-1][full]
        begin[edge] = inside[edge]
        edge = offsets[1:][full] - 1
        stop[edge] = inside[edge]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        left = self.end - self.start
        h = left.astype(U64) * _M1
        h = mix(h ^ (eight[self.start] & _MASKS[np.minimum(left, 8)]))
        todo = np.flatnonzero(left > 8)
        at, left = self.start[todo] + 8, left[todo] - 8
        while len(todo):
            h[todo] = mix(h[todo] ^ (eight[at] & _MASKS[np.minimum(left, 8)]), 1)
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        return h

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, dat = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(dat, dtype=np.uint8) if dat is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str,
           most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of whole rows with about ``most`` bytes of text each
    (one row alone if it is longer): (rows, bytes, offsets)."""
    data, offsets = column_bytes(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield batch.slice(i, j - i), data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j
    pa.default_memory_pool().release_unused()


def windows(h: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``length`` words from each position (``len - length + 1`` of
    them), built by doubling: H(2n, i) = H(n, i) * A^n + H(n, i + n)."""
    h = mix(h, salt) if salt else h
    if len(h) < length:
        return np.zeros(0, dtype=U64)
    base = 0xD6E8FEB86659FD93 + 2 * salt
    out, have, at = None, 0, 0
    power, size = h, 1
    a = base
    while True:
        if length & size:
            part = power[at:at + len(h) - length + 1]
            # words already taken precede this part
            out = part.copy() if out is None else out * U64(a) + part
            have += size
            at += size
        if have == length:
            return mix(out, 7)
        power = power[:len(power) - size] * U64(a) + power[size:]
        a = (a * a) & 0xFFFFFFFFFFFFFFFF
        size *= 2


def inside_document(first: np.ndarray, length: int) -> np.ndarray:
    """Start positions (word numbers) of windows of ``length`` words that lie
    inside one document."""
    counts = np.diff(first)
    n = np.maximum(counts - length + 1, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which is faster than hashing here)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def distinct_pairs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document number, key) pairs, in document order."""
    if not len(doc):
        return doc, key
    order = np.argsort(key)
    small = doc.astype(np.uint16) if doc.max() < 1 << 16 else doc  # 16 bits are sorted by radix
    order = order[np.argsort(small[order], kind="stable")]
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[new], key[new]
