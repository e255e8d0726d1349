"""Words and their hashes over Arrow batches of texts, as numpy arrays.

Used inside Spark tasks only. Texts come in chunks of at most CHUNK_BYTES, or one text if that is
longer, so that a task holds a few arrays of that size whatever the table's size.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = (1 << 20) - 64


def return_memory() -> None:
    """From now on this process gives arrays and batches of 1 MiB or more back to the machine when they are freed.

    Allocators keep what was once the most by default, in workers that wait for the next task too.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which would grow otherwise


return_memory()
_MASK = (1 << 64) - 1
#: Odd multipliers by which the hashes of a run's words are put together.
_Q = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

#: True for the bytes of words: neither space nor TAB, LF, VT, FF, CR.
BLANK_FREE = np.ones(256, bool)
BLANK_FREE[[9, 10, 11, 12, 13, 32]] = False
#: True for ASCII letters and digits and for all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets: one more than texts). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts."""
    data, offsets = text_bytes(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = BLANK_FREE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of words in bytes and, for each text, the index of its first word (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = is_word[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = w[0], w[-1]
    np.not_equal(w[1:], w[:-1], out=edge[1:-1])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    joined = np.unique(cut[w[cut] & w[cut - 1]])  # a text ends inside a run
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]), kind="stable")
    starts, ends = at[0::2].astype(np.int64), at[1::2].astype(np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def _powers_for(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    return _powers(base, size)


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two independent 64-bit hashes of each word's bytes, the halves of its XXH3-128: an array of two rows.

    Each distinct word of the chunk is hashed once.
    """
    if not len(starts):
        return np.zeros((2, 0), np.uint64)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    plain = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)])
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    kind, width = (pa.binary(), np.int32) if bounds[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    words = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(bounds.astype(width)), pa.py_buffer(plain)]).dictionary_encode()
    distinct = words.dictionary.to_numpy(zero_copy_only=False)
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(digests[words.indices.to_numpy()].T)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return word_digests(data, starts, ends)[0]


def run_hashes(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of each run of n values of h, by first position: len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers_for(_Q[which], len(h) + 1)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


def exact_runs(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n values of h from each of the positions `at` on, mixed value by value."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for j in range(n):
            out = mix(out * np.uint64(_Q[1]) + h[at + j])
        return out


def in_texts(first_word: np.ndarray, n: int) -> np.ndarray:
    """For the runs of n words over all texts in a row: True where a run stays in one text."""
    total = int(first_word[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for j in range(1, n):
        cut = first_word[1:-1] - j
        cut = cut[(cut >= 0) & (cut < len(ok))]
        ok[cut] = False
    return ok


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(all words in a row, each followed by one space; where each begins; its bytes)."""
    size = ends - starts
    put = np.concatenate([[0], np.cumsum(size + 1)])
    plain = np.full(put[-1], 32, np.uint8)
    at, own = np.arange(size.sum()), np.repeat(np.arange(len(size)), size)
    plain[at + own] = data[at + (starts - (put[:-1] - np.arange(len(size))))[own]]
    return plain.tobytes(), put, size
