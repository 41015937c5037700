"""Rolling hashes over bytes or words, and windows grouped by content, in numpy (used inside tasks)."""

from __future__ import annotations

import numpy as np

from shardlens.llm.common import AT_END

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_ODD), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    return x ^ (x >> U64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (quicker than ``np.unique`` on 64-bit hashes)."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def byte_units(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).astype(U64) + U64(1)


class _Powers:
    """Powers of the hash base and of its inverse, grown as longer texts come."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, f, U64)]), dtype=U64) for f in (_ODD, _INVERSE))
        return self.up, self.down


    def forget(self) -> None:
        """After a very long text: back to a usual size."""
        if len(self.up) > MOST_POWERS:
            self.up, self.down = self.up[:MOST_POWERS].copy(), self.down[:MOST_POWERS].copy()


MOST_POWERS = 1 << 18
_powers = _Powers()
AT_END.append(_powers.forget)


def word_units(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, i.e. each run of bytes other than ASCII white space (as ``bytes.split``)."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, U64)
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers.get(len(b) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum((b.astype(U64) + U64(1)) * up[:len(b)], dtype=U64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive units, by doubling."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, block, size, power = None, 0, units, 1, _ODD
    while True:
        if k & size:
            out = block[:n] if out is None else out * power + block[done:done + n]
            done += size
        if done == k:
            return mix(out)
        block = block[:len(block) - size] * power + block[size:]
        power, size = U64(int(power) ** 2 % (1 << 64)), 2 * size


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    n, span = len(x) - width + 1, 1
    while 2 * span <= width:
        x, span = pick(x[:len(x) - span], x[span:]), 2 * span
    return pick(x[:n], x[width - span:width - span + n]) if width > span else x[:n]


def anchors(units: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows grouped by the smallest hash of a gram in them: first window, number of windows, that hash (48 bits).

    Every window of ``window`` units is in one group. Two equal windows have the same smallest hash, wherever they
    stand; a group is a run of windows, cut so that its units number under twice the window.
    """
    h = grams(units, gram)
    width = window - gram + 1
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _sliding(h, width, np.minimum) >> U64(16)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(first, len(least)))
    pieces = -(-size // width)
    if len(pieces) and pieces.max() > 1:  # a long run comes from repetitive text
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, size = np.repeat(first, pieces) + nth * width, np.repeat(size, pieces) - nth * width
        size = np.minimum(size, width)
    return first, size, least[first].astype(np.int64)


def repeated(units: np.ndarray, gram: int, hashes: np.ndarray) -> np.ndarray:
    """Which of the group hashes belong to a gram that the text shows more than once."""
    h = np.sort(grams(units, gram) >> U64(16)).astype(np.int64)
    twice = h[1:][h[1:] == h[:-1]]
    if not len(twice):
        return np.zeros(len(hashes), bool)
    return twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes
