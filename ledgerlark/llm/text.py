"""Byte-level word kernels shared by the text operators (they run inside tasks on Arrow batches).

Words are ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes; a null text has no words.

Hashes chain a 64-bit finaliser over eight bytes (of a word) or over halves (of a run of words), so no algebra of the
values cancels out; with one seed, words of at most eight bytes and one length never collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 256
SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit, and different inputs have different outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pair of each a and b."""
    return mix(mix(a + np.uint64(0xA0761D6478BD642F)) ^ b)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of buf[s:e] for every pair."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(seed))
    if not len(out):
        return out
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(buf) + 1,), strides=(1,))
    at, k = np.arange(len(out)), 0
    while len(at) and k < LONG_WORD:
        left = size[at] - k
        out[at] = mix(out[at] ^ (eight[starts[at] + k] & _LOW_BYTES[np.minimum(left, 8)]))
        at, k = at[left > 8], k + 8
    for i in at.tolist():
        out[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
    return out


def window_hashes(values: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of values[i:i + size] for every i that leaves so many."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, taken, run, width = np.full(n, mix(np.array([size + seed & (1 << 64) - 1], dtype=np.uint64))[0]), 0, values, 1
    while True:
        if size & width:
            total, taken = _both(total, run[taken : taken + n]), taken + width
        if 2 * width > size:
            return total
        run, width = _both(run[:-width], run[width:]), 2 * width


class Words:
    """The words of some consecutive documents of a batch."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        """buf: the texts' bytes one after another; bounds: n + 1 offsets of the texts in it."""
        self.buf, self.bounds = buf, bounds
        sep = _SEP[buf]
        first, last = np.ones(len(buf), dtype=bool), np.ones(len(buf), dtype=bool)
        first[1:], last[:-1] = sep[:-1], sep[1:]
        inner = bounds[(bounds > 0) & (bounds < len(buf))]
        first[inner], last[inner - 1] = True, True
        self.starts, self.ends = np.flatnonzero(first & ~sep), np.flatnonzero(last & ~sep) + 1
        #: words[doc_words[d]:doc_words[d + 1]] belong to document d
        self.doc_words = np.searchsorted(self.starts, bounds)

    def hashes(self, second: bool = False) -> np.ndarray:
        """A hash of each word. second: with the other seed."""
        return word_hashes(self.buf, self.starts, self.ends, SEEDS[second])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, word after the last, document) of each shingle; a document of fewer words is one shingle, of none has none."""
        counts = np.diff(self.doc_words)
        n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        doc = np.repeat(np.arange(len(counts)), n)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + self.doc_words[:-1][doc]
        return first, np.minimum(first + size, self.doc_words[1:][doc]), doc

    def shingle_hashes(self, hashes: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document) of each shingle, from the hashes of the words."""
        first, end, doc = self.shingles(size)
        out, lengths = np.zeros(len(first), dtype=np.uint64), end - first
        for k in np.unique(lengths).tolist():
            own = lengths == k
            out[own] = window_hashes(hashes, k, seed)[first[own]]
        return out, doc

    def document_hashes(self, hashes: np.ndarray, seed: int) -> np.ndarray:
        """A hash of each document's word sequence, from the hashes of the words."""
        raw, at = hashes.astype("<u8").tobytes(), (8 * self.doc_words).tolist()
        return np.array([xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(at[:-1], at[1:])], dtype=np.uint64)


def as_strings(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column


def chunks(column: pa.ChunkedArray | pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first, end, words) for runs of documents of about ``limit`` bytes; one long text may exceed it."""
    texts = as_strings(column)
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, n)
        buf = data[offsets[first] : offsets[end]]
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
        yield first, end, Words(buf, np.asarray(offsets[first : end + 1] - offsets[first]))
        first = end
