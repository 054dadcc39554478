"""Vectorised word splitting and hashing over UTF-8 bytes (numpy only).

A word's hash is the mixed sum of one fixed random number for each place and byte
at it, taken from a running sum, so a text of any length costs a few array
passes and no loop over its words. Runs of words are hashed by doubling: halves
are mixed into wholes. Neither is a polynomial, so no family of words of regular
build shares a hash.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes hashed at a time; longer texts go in blocks that end between words.
BLOCK = 1 << 20
#: Places of a word whose numbers are kept in a table; those of later ones are worked out.
PLACES = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


_NUMBERS = mix(np.arange(1, PLACES * 256 + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``[^\\x20\\x09-\\x0D]``."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def run_spans(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one kind; kind 0 is left out."""
    if not len(kinds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(kinds)) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(kinds)]))
    keep = kinds[starts] != 0
    return starts[keep], ends[keep]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and disjoint."""
    out, i = np.empty(len(starts), dtype=U), 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
        part = buf[low : ends[j - 1]]
        s, e = starts[i:j] - low, ends[i:j] - low
        place = np.arange(len(part)) - np.repeat(s, np.diff(s, append=len(part)))
        at = (place << 8) + part
        if int((e - s).max()) <= PLACES:
            number = _NUMBERS.take(at, mode="clip")  # between words anything may stand: it isn't summed
        else:
            number = mix((at.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
        sums = np.zeros(len(part) + 1, dtype=U)
        np.cumsum(number, out=sums[1:])
        out[i:j] = mix(sums[e] - sums[s] + (e - s).astype(U) * U(0xC2B2AE3D27D4EB4F))
        i = j
    return out


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive items."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out, size, doubled, width = None, 0, h, 1
    while True:
        if k & width:  # what is done so far, then a run of this width
            out = doubled[: len(h) - width + 1] if out is None else _joined(out, doubled[size:], width)
            size += width
        if 2 * width > k:
            return out[:n]
        doubled = _joined(doubled, doubled[width:], width)
        width *= 2


def _joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    n = min(len(left), len(right))
    return mix(left[:n] * U(0xD6E8FEB86659FD93) + mix(right[:n] + U(width)))


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """For each start, the leftmost position of the least of ``width`` values."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(x[right] < x[left], right, left)
        have += step
    return at[:n]
