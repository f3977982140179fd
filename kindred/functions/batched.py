"""Edit similarities of many pairs at once, in numpy.

A block of pairs is two matrices of code points, a row a pair, padded with values that are no characters. Blocks hold
pairs of like length, so that padding costs little. The longest common subsequence runs Hyyroe's recurrence with a
bit-vector of 64-bit words for each pair, a character of the shorter side at a time, with carries from word to word;
Jaro's greedy matching takes the first free equal position of the window for all pairs at once. Pairs whose shorter side
is over `LONG` characters are the caller's: one integer of any length is faster there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LONG = 512
#: Code points of a block's wider matrix.
BLOCK = 1 << 18


def _matrix(texts: list[str], lengths: np.ndarray, pad: int) -> np.ndarray:
    width = max(1, int(lengths.max(initial=0)))
    out = np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width)
    out[np.arange(width) >= lengths[:, None]] = pad
    return out


def blocks(a: list[str], b: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, codes of a, codes of b, lengths of a, lengths of b) of pairs of like length."""
    la, lb = (np.fromiter(map(len, s), np.int64, len(s)) for s in (a, b))
    order = np.lexsort((la, lb, np.maximum(la, lb)))
    start = 0
    while start < len(order):
        # The longest pair of a block is its last; it sets the width.
        widest = int(max(la[order[start]], lb[order[start]], 1))
        end = start + max(1, BLOCK // widest)
        while end - start > 1 and (end - start) * int(max(la[order[min(end, len(order)) - 1]], lb[order[min(end, len(order)) - 1]], 1)) > 2 * BLOCK:
            end = start + (end - start) // 2
        at = order[start:end]
        yield at, _matrix([a[i] for i in at], la[at], 0xFFFFFFFF), _matrix([b[i] for i in at], lb[at], 0xFFFFFFFE), la[at], lb[at]
        start = end


def _subsequence(x: np.ndarray, y: np.ndarray, ly: np.ndarray, lx: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences; the recurrence runs over the columns of y."""
    n, width = x.shape
    words = -(-width // 64)
    padded = np.zeros((n, words * 64), bool)
    row = np.full((n, words), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(y.shape[1]):
        np.equal(x, y[:, j : j + 1], out=padded[:, :width])
        hit = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        both = row & hit
        total = row + both
        if words > 1:
            carry = total < row
            for w in range(1, words):
                more = total[:, w] + carry[:, w - 1]
                carry[:, w] |= more < total[:, w]
                total[:, w] = more
        row = total | (row & ~hit)
    # Zero bits among a side's own places; a padded place is never hit and stays one.
    ones = np.bitwise_count(row).sum(1, dtype=np.int64)
    return words * 64 - ones


def common_subsequence(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    out = np.zeros(len(a), np.int64)
    for at, x, y, lx, ly in blocks(a, b):
        out[at] = _subsequence(x, y, ly, lx) if y.shape[1] <= x.shape[1] else _subsequence(y, x, lx, ly)
    return out


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of each pair of different, non-empty texts; the bonus counts above 0.7."""
    out = np.zeros(len(a))
    for at, x, y, lx, ly in blocks(a, b):
        n = len(at)
        reach = np.maximum(0, np.maximum(lx, ly) // 2 - 1)
        free = np.ones(y.shape, bool)
        taken = np.zeros(x.shape, bool)
        place, rows = np.arange(y.shape[1]), np.arange(n)
        for i in range(x.shape[1]):
            low, high = max(0, i - int(reach.max())), min(y.shape[1], i + int(reach.max()) + 1)
            if low >= high:
                break
            near = (y[:, low:high] == x[:, i : i + 1]) & free[:, low:high] & (np.abs(place[low:high] - i) <= reach[:, None])
            first = near.argmax(1)
            met = near[rows, first]
            taken[met, i] = True
            free[rows[met], low + first[met]] = False
        m = taken.sum(1)
        order = np.zeros((n, max(1, int(m.max(initial=0)))), np.uint32), np.zeros((n, max(1, int(m.max(initial=0)))), np.uint32)
        for side, codes, used in ((order[0], x, taken), (order[1], y, ~free)):
            r, c = np.nonzero(used)
            side[r, used.cumsum(1)[r, c] - 1] = codes[r, c]
        moved = (order[0] != order[1]).sum(1) // 2
        some = np.maximum(m, 1)
        jaro = np.where(m > 0, (m / np.maximum(lx, 1) + m / np.maximum(ly, 1) + (m - moved) / some) / 3, 0.0)
        width = min(4, x.shape[1], y.shape[1])
        same = (x[:, :width] == y[:, :width]).cumprod(1).sum(1) if width else np.zeros(n)
        out[at] = np.where(jaro > 0.7, jaro + 0.1 * same * (1 - jaro), jaro)
    return out
