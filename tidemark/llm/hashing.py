"""Vectorised hashing inside a task: words, Rabin-Karp hashes of windows, ranks of doubled length, content-chosen positions."""

from __future__ import annotations

import numpy as np

#: ASCII white space, the only separators of words here.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE)] = True
_WORD_BYTE = np.where(_IS_SPACE, np.uint64(0), _BYTE)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse."""

    def __init__(self, base: int):
        self._bases = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self._known = [np.ones(1, np.uint64)] * 2

    def __call__(self, n: int, inverse: bool = False) -> np.ndarray:
        if len(self._known[inverse]) < n:
            self._known[inverse] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, self._bases[inverse], np.uint64))])
        return self._known[inverse][:n]


_WORD = Powers(int(_BASE))
#: The two independent rolling hashes of windows.
_FIRST, _SECOND = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit polynomial hash a word, and where the words start. Long texts are read in segments that end between words."""
    out, places, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(raw):
        to = at + _SEGMENT
        while to < len(raw) and raw[to] not in SPACE:
            to += 1
        buf = np.frombuffer(raw[at:to], np.uint8)
        space = _IS_SPACE[buf]
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if len(starts):
            places.append(starts + at)
            buf, starts = buf[starts[0] :], starts - starts[0]
            width = np.diff(np.append(starts, len(buf)))
            offset = np.arange(len(buf)) - np.repeat(starts, width)
            out.append(mix(np.add.reduceat(_WORD_BYTE[buf] * _WORD(int(width.max()) + 1)[offset], starts)))
        at = to
    return np.concatenate(out), np.concatenate(places)


def rolling(items: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every run of `length` items, under two bases: the hash of a run is that of the run before less
    its first item, plus the new last one, which running sums of items times powers give for all runs at once."""
    n = len(items) - length + 1
    one, two = np.empty(max(n, 0), np.uint64), np.empty(max(n, 0), np.uint64)
    for at in range(0, n, _SEGMENT):
        part = items[at : at + _SEGMENT + length - 1]
        for out, powers, x in ((one, _FIRST, part), (two, _SECOND, mix(part + _BASE))):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(len(x)))])
            m = len(x) - length + 1
            out[at : at + m] = mix((sums[length:] - sums[:-length]) * powers(m, inverse=True))
    return one, two


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _BASE + (right ^ (right >> np.uint64(29))))


def doubled_at(raw: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two ranks of the strings of `length` (8 or more) bytes at each position: up to eight bytes are their own rank, and
    each longer string has that of the pair of its first 2**k and its last 2**k bytes, the two halves overlapping at the
    last step."""
    eight = np.ndarray((len(raw),), "<u8", raw + b"\0" * 8, strides=(1,))

    def rank(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length == 8:
            x = eight[at]
            return mix(x), mix(x ^ _BASE)
        half = 1 << (length - 1).bit_length() - 1
        left, right = rank(at, half), rank(at + (length - half), half)
        return _paired(left[0], right[0]), _paired(right[1], left[1])

    one, two = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    for i in range(0, len(at), _SEGMENT >> 4):
        one[i : i + (_SEGMENT >> 4)], two[i : i + (_SEGMENT >> 4)] = rank(at[i : i + (_SEGMENT >> 4)], length)
    return one, two


def _slide(op, a: np.ndarray, w: int) -> np.ndarray:
    """op (minimum or maximum) over every w neighbours."""
    m = 1
    while 2 * m <= w:
        a = op(a[:-m], a[m:])
        m *= 2
    return op(a[: len(a) - (w - m)], a[w - m :]) if w > m else a


def first_minima(order: np.ndarray, w: int) -> np.ndarray:
    """For every w neighbours the position of the first smallest order number. It depends on these neighbours only, and
    never moves back from one start to the next."""
    key = order.astype(np.uint64) << np.uint64(32) | np.arange(len(order), dtype=np.uint64)
    return (_slide(np.minimum, key, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
