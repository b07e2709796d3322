"""Vectorised text helpers for Arrow batches inside Spark tasks.

Everything works on the UTF-8 bytes of a batch at once: words are found by a byte
table, hashed by differences of one running polynomial, and combined to shingles,
with no Python loop over documents or words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are worked on together; bounds the memory of a task.
CHUNK = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U), np.ones(1, U)]

_bytes = np.arange(256)
#: Words between blanks: everything but space, tab, newline, vertical tab, form feed, return.
BLANK_WORDS = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))
#: Words of letters and digits; every byte of a non-ASCII character counts as a letter.
ALNUM_WORDS = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)) | ((_bytes >= 65) & (_bytes <= 90)) | (_bytes >= 128)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = x + U((seed * _BASE + 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), CHUNK + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, U(base))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
        if size > 16 * CHUNK:  # not kept for one giant text
            big = tuple(_powers)
            _powers[:] = [np.ones(1, U), np.ones(1, U)]
            return big
    return _powers[0], _powers[1]


def _give_back() -> None:
    """Return freed memory to the system, so that idle workers don't hold what their last task needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `limit` bytes of text each, one row at least."""
    worked = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        before = np.cumsum(lengths) - lengths
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(before, before[at] + limit, "left")))
            yield batch.slice(at, end - at)
            at = end
        worked += int(lengths.sum())
        if worked > 16 * CHUNK:
            worked = 0
            _give_back()
    _give_back()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more than there are texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a chunk: doc (row), start, end (bytes), hash; bytes are lower-cased on demand."""

    def __init__(self, texts: pa.Array, table: np.ndarray = BLANK_WORDS, lower: bool = True, hashed: bool = True):
        raw, self.offsets = flat(texts)
        self.n_docs = len(self.offsets) - 1
        self.data = LOWER[raw] if lower else raw
        inside = table[raw]
        n = len(raw)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            before[self.offsets[:-1][self.offsets[:-1] < n]] = False
            after[self.offsets[1:][self.offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        #: Words of each document, and the number of words before it.
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.cumsum(self.counts) - self.counts
        self._sums = None
        if hashed:
            self.hash = self.hashed(self.start, self.end)

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges."""
        with np.errstate(over="ignore"):
            n = len(self.data)
            up, down = powers(n + 1)
            if self._sums is None:
                self._sums = np.zeros(n + 1, U)
                np.cumsum((self.data.astype(U) + U(1)) * up[:n], out=self._sums[1:])
            h = (self._sums[end] - self._sums[start]) * down[start]
            return mix(h ^ ((end - start).astype(U) << U(56)))

    def ngrams(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words in a row, and the number of the first word; documents with fewer words have none."""
        w = self.hash
        if len(w) < n:
            return np.empty(0, U), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(w) - n + 1])
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), U)
            for k in range(n):
                h = h * U(0xD6E8FEB86659FD93) + w[at + k]
        return mix(h, seed + n), at

    def shingles(self, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """As ngrams, in order of documents, where a document of 1 to n - 1 words has its whole sequence as one.

        Returns the hashes and the document of each.
        """
        h, at = self.ngrams(n)
        doc = self.doc[at]
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        if len(short):
            with np.errstate(over="ignore"):
                x = self.counts[short].astype(U)
                for k in range(n - 1):
                    has = self.counts[short] > k
                    i = np.minimum(self.first[short] + k, len(self.hash) - 1)
                    x = np.where(has, x * U(0xD6E8FEB86659FD93) + self.hash[i], x)
            h, doc = np.concatenate([h, mix(x, 77)]), np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
        return h, doc


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted by document and value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed ones that Spark has."""
    return np.ascontiguousarray(x).view(np.int64)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with the same keys from batches in which such rows follow one another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def plain(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column without nulls as a numpy array."""
    return batch[column].to_numpy(zero_copy_only=False)
