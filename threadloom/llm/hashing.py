"""Hashes of words, shingles and byte windows of whole batches of texts, by numpy over the texts' UTF-8 bytes.

A byte string's hash is a polynomial with random byte values and a random odd base modulo 2**64, then mixed; a sequence's
is built from its words' mixed hashes. Texts are taken a block at a time; a block holds BLOCK bytes, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_PLACE_BITS = 25
U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_RNG.integers(2**61, 2**62)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_WORD_BYTES = np.where(_SPACE, U(0), _BYTES)
_FOLDED_BYTES = _WORD_BYTES[_FOLD]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and doubled as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.array([1], U) if have is None else have
        while len(have) < n:
            have = np.concatenate([have, have * U(pow(base, len(have), 2**64))])
        if len(have) <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of runs of texts; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
        yield i, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """h with h[e] - h[s], times the inverse power of s, the hash of values[s:e]."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _power(_BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of values[s:e]; prefix is prefix_hash(values)."""
    return mix((prefix[ends] - prefix[starts]) * _power(_INVERSE, len(prefix))[starts])


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix_hash(_BYTES[data])


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and the number of the first word of every text (and of none after the last)."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    prefix = prefix_hash((_FOLDED_BYTES if fold else _WORD_BYTES)[data])
    return span_hash(prefix, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and where each text's begin. A text with fewer words has its whole sequence as one."""
    n = np.diff(begins)
    so_far, by_length = np.zeros(len(hashes), U), []
    for j in range(k):
        so_far = so_far[: len(hashes) - j] if j else so_far
        so_far = mix(so_far * U(0x9E3779B97F4A7C15) + hashes[j:] + U(j + 1))
        by_length.append(so_far)
        if len(hashes) <= j + 1:
            break
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_begins = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(out_begins[-1]) + np.repeat(begins[:-1] - out_begins[:-1], counts)
    out = np.zeros(len(at), U)
    of = np.repeat(np.minimum(n, k), counts)
    for length in np.unique(of):
        mine = of == length
        out[mine] = by_length[length - 1][at[mine]]
    return out, out_begins


def window_minima(values: np.ndarray, begins: np.ndarray, width: int, span: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of width values inside one part (parts begin at begins): where the least value is, leftmost on ties.

    span: what a window covers in the numbering of begins, width unless given; the last part ends where the last window does.
    Returned by runs of windows that share it: (place of the least value, first window, last window)."""
    n = len(values)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    if n > 1 << _PLACE_BITS:  # by slices, so that the order is the same for texts of every length
        step = (1 << _PLACE_BITS) - width
        found = []
        for a in range(0, n - width + 1, step):
            inside = begins[(begins > a) & (begins < a + step - 1 + (span or width))] - a
            found.append([x + a for x in window_minima(values[a : a + step + width - 1], np.append(0, inside), width, span)])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    shift = U(_PLACE_BITS)
    packed = (values >> shift << shift) | np.arange(n, dtype=U)
    pad = -n % width
    grid = np.concatenate([packed, np.full(pad, ~U(0), U)]).reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - width + 1], left[width - 1 : n])
    at = (least & ((U(1) << shift) - U(1))).astype(np.int64)
    span = span or width
    part = np.searchsorted(begins, np.arange(n - width + 1), "right")
    whole = np.flatnonzero(np.arange(n - width + 1) + span <= np.append(begins, n - width + span)[part])
    at = at[whole]
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)]))
    return at[new], whole[new], whole[np.append(new[1:], len(at)) - 1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
