"""Words and shingles of Arrow text columns, by whole-array numpy operations.

A chunk of documents is one byte array; words are runs of word bytes that do not cross a document's
bounds. A word's 64-bit hash comes from its blocks of eight bytes, read in place, so few words are cut out one by one.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; a longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20


def _mask(separators: Iterable[int]) -> np.ndarray:
    m = np.ones(256, bool)
    m[list(separators)] = False
    return m


#: ``[^\x20\x09-\x0D]+``
BY_SPACE = _mask([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z are lower-cased
BY_ALNUM = _mask([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


#: Bytes with A-Z lower-cased, and as they are.
LOWER, PLAIN = _lower(), np.arange(256, dtype=np.uint8)
#: For each length up to 8, which bits of eight bytes belong to it.
HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Words of more bytes are hashed one by one.
LONG = 64


def release() -> None:
    """Give freed memory back at a task's end: workers stay alive beside the next stage's JVM tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column (null: empty) and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return raw, off - off[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text each: (slice, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = text_bytes(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
    release()


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = BY_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of each document's first word and the total) of all words."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    m = is_word[data]
    heads = off[:-1][off[:-1] < off[1:]]
    prev = np.empty_like(m)
    prev[0], prev[1:] = False, m[:-1]
    prev[heads] = False
    starts = np.flatnonzero(m & ~prev)
    nxt = np.empty_like(m)
    nxt[-1], nxt[:-1] = False, m[1:]
    nxt[heads[1:] - 1] = False
    ends = np.flatnonzero(m & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word; with LOWER, of the word with A-Z lower-cased.

    A word's length and its blocks of eight bytes are scrambled in turn, so words of up to eight bytes and one length never
    collide; words of more than LONG bytes have a cryptographic hash.
    """
    if not len(starts):
        return np.empty(0, U64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data if values is PLAIN else values[data]
    eight = np.ndarray(len(data) + 1, U64, padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) ^ (eight[starts] & HEADS[np.minimum(size, 8)]))
    more = np.flatnonzero((size > 8) & (size <= LONG))
    for at in range(8, LONG, 8):
        if not len(more):
            break
        h[more] = mix((h[more] * U64(0x9FB21C651E98DF25)) ^ (eight[starts[more] + at] & HEADS[np.minimum(size[more] - at, 8)]))
        more = more[size[more] > at + 8]
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words within documents, in order, and the index of each document's first.

    A document of fewer words, but not none, has one run: all its words.
    """
    n = np.diff(first)
    runs = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    if not len(h):
        return np.empty(0, U64), bounds
    padded = np.concatenate([h, np.zeros(k - 1, U64)])
    total = np.zeros(len(h), U64)
    for j in range(k):
        total += padded[j : j + len(h)] * U64(pow(0x9FB21C651E98DF25, j + 1, 1 << 64))
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], runs)
    out = total[at]
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = h[first[i] : first[i + 1]]
        out[bounds[i]] = sum(int(x) * pow(0x9FB21C651E98DF25, j + 1, 1 << 64) for j, x in enumerate(own)) + len(own) & (1 << 64) - 1
    return mix(out), bounds
