"""Words and their 64-bit hashes, found for a whole block of texts at once with numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a word: the six ASCII white-space characters.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that end a word for phrase matching: all of ASCII but digits and letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False
NOT_ALNUM[128:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def powers(n: int, which: str = "up") -> np.ndarray:
    held = _powers.get(which)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 20), _BASE if which == "up" else _BASE_INVERSE, _U)
        held[0] = 1
        held = _powers[which] = np.multiply.accumulate(held)
    return held[:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text (one more for the total)."""
    n = len(data)
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; equal bytes have equal hashes wherever they stand, in any block."""
    if not len(starts):
        return np.zeros(0, _U)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * powers(len(data)), out=total[1:])
    out = (total[ends] - total[starts]) * powers(len(data), "down")[starts]
    return mix(out + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def per_text_unique(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their bounds."""
    out, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    for k in range(len(bounds) - 1):
        a, b = bounds[k], bounds[k + 1]
        if b - a > 1:
            part = np.sort(values[a:b])
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        else:
            part = values[a:b]
        out.append(part)
        sizes[k] = len(part)
    return (np.concatenate(out) if out else values[:0]), np.concatenate(([0], np.cumsum(sizes)))


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles, repeats included; with fewer words, of the whole sequence; and their bounds."""
    n = np.diff(bounds)
    if not len(words):
        return np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    full = np.zeros(len(words), _U)
    m = max(len(words) - k + 1, 0)
    acc = np.zeros(m, _U)
    for j in range(k):
        acc = acc * _U(_BASE) + words[j : j + m]
    full[:m] = mix(acc + _U(k))
    keep = np.ones(len(words), bool)
    ends = bounds[1:]
    for j in range(k - 1):  # the last k-1 words of each text start no shingle
        at = ends - 1 - j
        keep[at[(n > j)]] = False
    short = np.flatnonzero((n > 0) & (n < k))
    for t in short:
        value = _U(0)
        with np.errstate(over="ignore"):
            for w in words[bounds[t] : bounds[t + 1]]:
                value = value * _U(_BASE) + w
            full[bounds[t]] = mix(np.array([value + _U(n[t])], _U))[0]
        keep[bounds[t]] = True
    sizes = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    return full[keep], np.concatenate(([0], np.cumsum(sizes)))
