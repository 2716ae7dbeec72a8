"""Whole-batch text primitives on UTF-8 bytes, used inside Arrow tasks.

A block is the concatenated bytes of some whole texts plus their offsets; words, hashes and per-text
sums are then a few numpy passes over the block instead of a Python loop over words. Blocks hold
about ``BLOCK`` bytes, so a task's memory does not follow the batch size; one longer text is a block
of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words that end at ASCII white space.
WS_WORD = ~_SPACE
#: Bytes of words made of digits, ASCII letters and every character beyond ASCII.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of ASCII letters and every character beyond ASCII.
LETTER_WORD = ALNUM_WORD.copy()
LETTER_WORD[0x30:0x3A] = False
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_MULT_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash multiplier and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _MULT), ("down", _MULT_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) over whole texts; nulls count as empty texts."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def spans(buf: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``member`` bytes, none across texts; and where each text's runs begin."""
    if len(buf) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    inside = member[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal for equal bytes wherever they stand."""
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUE[buf] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def prefixes(rows: np.ndarray) -> np.ndarray:
    """Running sums of equally long byte rows, from which ``stretch_hash`` takes the hash of any stretch."""
    up, _ = _powers(rows.shape[1] + 1)
    out = np.zeros((rows.shape[1] + 1, len(rows)), np.uint64)
    np.cumsum(_VALUE[rows.T] * up[:-1, None], axis=0, out=out[1:])
    return out


def stretch_hash(total: np.ndarray, start: int, size: int) -> np.ndarray:
    """``span_hashes`` of the stretch of ``size`` bytes from ``start`` of every row."""
    _, down = _powers(start + 1)
    return mix((total[start + size] - total[start]) * down[start] + np.uint64(size * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each text's stretch given by ``offs``."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def owner(offs: np.ndarray) -> np.ndarray:
    """For each element of the stretches given by ``offs``, the number of its text."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive elements (the caller leaves out those that cross texts)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * _MULT + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


def windows(offs: np.ndarray, n: int) -> np.ndarray:
    """Starts of n-element windows that stay inside a text."""
    size = np.diff(offs)
    if not len(size) or offs[-1] < n:
        return np.zeros(0, np.int64)
    left = np.repeat(offs[1:], size) - np.arange(offs[-1])
    return np.flatnonzero(left >= n)
