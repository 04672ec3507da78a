"""Whole batches of UTF-8 text as numpy arrays: words, their hashes, and shingles of them.

A batch's texts lie end to end in one byte array. Words are the runs of bytes that are not ASCII white
space (``[^\\x20\\x09-\\x0D]+``); they never reach over a text's end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_LIBC = ctypes.CDLL(None)
#: Text bytes that are worked on at once; a longer text is worked on alone.
SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, SLICE + 1), base, U64)
        x[0] = 1
        have = _pow[base] = np.cumprod(x, dtype=U64)
        if n > 4 * SLICE:  # one very long text does not keep its table
            del _pow[base]
    return have[:n]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` text bytes each, at least a row each."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.maximum(np.cumsum(size) - 1, 0) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory to the system, as a Python worker stays for many tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts end to end, and the n + 1 offsets; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"").cast(pa.large_binary())
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def span_hashes(data: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Hashes of the bytes from start to end, for each pair of arrays; no span may be empty at the very end of data."""
    n = len(data)
    if not n:
        return [np.zeros(len(a), U64) for a, _ in spans]
    total = np.zeros(n + 1, U64)
    np.cumsum(_VALUE[data] * _powers(_BASE, n), out=total[1:], dtype=U64)
    back = _powers(_INVERSE, n)
    return [mix((total[b] - total[a]) * back[np.minimum(a, n - 1)]) for a, b in spans]


def first_seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code from 0 for each key, in order of appearance, and where each code is seen first."""
    coded = pa.array(keys).dictionary_encode()
    code = coded.indices.to_numpy()
    first = np.zeros(len(coded.dictionary), np.int64)
    first[code[::-1]] = np.arange(len(keys))[::-1]
    return code, first


class Words:
    """start, end (byte positions), text (index of the text) and, on demand, 64-bit hashes of all words; lower: A-Z count as a-z."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        data = LOWER[data] if lower else data
        self.data, self.offs = data, offs
        n = len(data)
        solid = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.text = np.searchsorted(offs, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(offs) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self) -> np.ndarray:
        """Polynomial hash of each word's bytes, then mixed: equal words, equal hashes; others differ but for a chance of 2^-64 a pair."""
        return span_hashes(self.data, [(self.start, self.end)])[0]


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct n-word shingles, ascending within the text, and the offsets of the texts in them.

    A text of fewer than n words, at least one, has its whole word sequence as its only shingle.
    """
    h, docs = words.hashes(), len(words.offs) - 1
    seed = mix(np.arange(1, n + 1, dtype=U64) * U64(0xA24BAED4963EE407))
    size = len(h)
    full = np.zeros(0, U64)
    if size >= n:
        full = np.full(size - n + 1, seed[n - 1], U64)
        for k in range(n):
            full = mix(full * U64(_BASE) + h[k : size - n + 1 + k])
    out, lens = [], np.zeros(docs, np.int64)
    first = words.first
    for d in range(docs):
        a, b = first[d], first[d + 1]
        if b - a >= n:
            s = np.sort(full[a : b - n + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            acc = seed[b - a - 1 : b - a]
            for x in h[a:b]:
                acc = mix(acc * U64(_BASE) + x)
            s = acc
        else:
            continue
        out.append(s)
        lens[d] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(lens)])


def per_text(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values between successive offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]
