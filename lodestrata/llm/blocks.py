"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A block is a run of rows of an Arrow batch whose texts hold about
``BLOCK_BYTES``; only a text longer than that makes a larger block. Words are
told apart by 64-bit hashes that mix every byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 2 << 20
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LONG = 64

#: Bytes of words: digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes that are no white space.
SOLID = np.ones(256, bool)
SOLID[0x20] = SOLID[0x09:0x0E] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def release() -> None:
    """Give freed memory back to the system: Spark keeps a Python worker for later tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _M2
    x = (x ^ (x >> _U(27))) * _M3
    return x ^ (x >> _U(31))


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, starts): the texts joined with a line feed before, between and after; null counts as empty."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    group = (np.cumsum(size) - size) // limit
    edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = batch.slice(a, b - a)
        texts = pc.fill_null(rows.column(column).cast(pa.binary()), b"").to_pylist()
        buf = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        yield rows, buf, np.cumsum(size[a:b]) - size[a:b] + 1


def spans(buf: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes in ``solid``. The first and last byte must not be."""
    inside = solid[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    size = end - start
    h = mix(size.astype(_U) * _M1 + _M1)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    at = np.arange(len(start))
    for k in range(0, _LONG, 8):
        if k:
            at = at[size[at] > k]
            if not len(at):
                break
        left = np.minimum(size[at] - k, 8)
        word = eights[start[at] + k] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - left.astype(_U) * _U(8)))
        h[at] = mix((h[at] ^ word) * _M1 + _U(k + 1))
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]].tobytes())
    return h


def owners(word_start: np.ndarray, text_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words in order: the text of each, and the first word of each text (one more at the end)."""
    first = np.searchsorted(word_start, text_start)
    first = np.append(first, len(word_start))
    return np.repeat(np.arange(len(text_start)), np.diff(first)), first


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n <= 1 << 22:
            _POWERS[base] = have
    return have


def grams(words: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` consecutive words; ``base`` picks the hash function."""
    n = len(words)
    if n < k:
        return np.empty(0, _U)
    up, down = _powers(base, n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(words * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1] + _U(k))


def runs(words: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of the words ``[begin, end)``, for each pair of bounds; equals ``grams`` at equal lengths."""
    n = len(words)
    up, down = _powers(base, n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(words * up[:n], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(_U))
