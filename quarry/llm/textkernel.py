"""Vectorised passes over the bytes of many texts at once."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes, unless a single text is longer.
STEP_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(size, _U)
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * _U(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i]: polynomial hash of the first i bytes."""
    h = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * _power(_BASE, len(data)), out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), wherever they stand."""
    return mix((h[end] - h[start]) * _power(_INVERSE, len(h))[start])


def rolling_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every span of the given width."""
    n = len(h) - width
    return mix((h[width:] - h[:n]) * _power(_INVERSE, n)) if n > 0 else np.zeros(0, _U)


#: Bytes of a span that are hashed one block after the other; longer spans are hashed in
#: pieces of this length, and then the pieces' hashes.
SPAN_PIECE = 4096
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)
_STEP = _U(0xD6E8FEB86659FD93)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes [start, end) of each span, wherever they stand. Eight bytes
    at a time go through a mixing chain that starts from the length."""
    length = end - start
    h = mix(length.astype(_U) * _U(_BASE) + _U(seed))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    for k in np.flatnonzero(length > SPAN_PIECE).tolist():
        at = np.arange(int(start[k]), int(end[k]), SPAN_PIECE)
        part = hash_spans(data, at, np.minimum(at + SPAN_PIECE, int(end[k])), seed).view(np.uint8)
        h[k] ^= hash_spans(part, np.array([0]), np.array([len(part)]), seed)[0]
    live = np.flatnonzero((length > 0) & (length <= SPAN_PIECE))
    at, left, now = start[live], length[live], h[live]
    while len(live):
        now = mix((now ^ (eight[at] & _KEEP[np.minimum(left, 8)])) * _STEP + _U(_BASE))
        at, left = at + 8, left - 8
        over = left <= 0
        if over.any():
            h[live[over]] = now[over]
            live, at, left, now = live[~over], at[~over], left[~over], now[~over]
    return h


def same_spans(
    a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray
) -> np.ndarray:
    """Do the spans of ``length`` bytes from ``a_start`` in a and from ``b_start`` in b agree
    byte by byte?"""
    one, two = (
        np.ndarray((len(x) + 1,), "<u8", np.concatenate([x, np.zeros(8, np.uint8)]), strides=(1,)) for x in (a, b)
    )
    out = np.ones(len(length), bool)
    live = np.flatnonzero(length > 0)
    p, q, left = a_start[live], b_start[live], length[live]
    while len(live):
        same = ((one[p] ^ two[q]) & _KEEP[np.minimum(left, 8)]) == 0
        out[live[~same]] = False
        go = same & (left > 8)
        live, p, q, left = live[go], p[go] + 8, q[go] + 8, left[go] - 8
    return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string array without a copy; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        kind = np.int32
    else:
        kind = np.int64
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if buffers[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can: workers stay alive
    beside the JVM between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def steps(batch: pa.RecordBatch, text_at: int, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each; a longer text stands alone.
    What the steps have freed goes back to the system after the last."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths.astype(np.int64)) // size)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes of words in the looser sense: ASCII letters and digits, and all of non-ASCII characters.
_ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _ALNUM[_a:_b] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, loose: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the words of all texts. Words are runs of bytes that are not white
    space, or with ``loose`` runs of letters and digits."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _ALNUM[data] if loose else ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]
    # A word ends where the next byte is outside or belongs to another text.
    ends = np.zeros(n + 1, bool)
    ends[1:n] = inside[:-1] & (~inside[1:] | begins[1:])
    ends[n] = inside[-1]
    return np.flatnonzero(begins), np.flatnonzero(ends)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, number of its text)."""
    start, end = word_spans(data, offsets)
    hashes = hash_spans(_LOWER[data], start, end)
    return hashes, np.searchsorted(offsets, start, side="right") - 1
