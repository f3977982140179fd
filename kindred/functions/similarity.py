"""String similarities from 0 to 1.

Both empty: 1; one empty: 0; equal: 1. Jaccard is 0 if either side is empty. The edit similarities
have no builtin (levenshtein() counts a substitution as one edit, these count two) and are Arrow UDFs;
each batch works on its distinct pairs only, all at once (see batched.py). Token forms are built by column functions around them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kindred.functions import batched


def longest_common_subsequence(a: str, b: str) -> int:
    """Length, with one machine-wide integer a row (Hyyroe's bit-parallel recurrence)."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 2 * longest_common_subsequence(a, b) / (len(a) + len(b)) if a and b else 0.0


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity; above 0.7 a common start of up to 4 characters adds to it."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left, right = [True] * len(b), [], []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            left.append(c)
            right.append(j)
    m = len(left)
    if not m:
        return 0.0
    moved = sum(c != b[j] for c, j in zip(left, sorted(right), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    start = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + 0.1 * start * (1 - jaro)


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 1.0 if a == b else 0.0
    shared, mine, theirs = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and not (mine and theirs):
        return 1.0
    whole = [f"{shared} {rest}" if shared else rest for rest in (mine, theirs)]
    best = indel(*whole)
    return max(best, indel(shared, whole[0]), indel(shared, whole[1])) if shared else best


def indels(a: list[str], b: list[str]) -> np.ndarray:
    """indel of each pair, all together."""
    out = np.array([1.0 if x == y else 0.0 for x, y in zip(a, b, strict=True)])
    todo = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y and x and y]
    long = [i for i in todo if min(len(a[i]), len(b[i])) > batched.LONG]
    for i in long:
        out[i] = indel(a[i], b[i])
    todo = sorted(set(todo) - set(long)) if long else todo
    x, y = [a[i] for i in todo], [b[i] for i in todo]
    sizes = np.fromiter((len(p) + len(q) for p, q in zip(x, y, strict=True)), np.int64, len(todo))
    out[todo] = 2 * batched.common_subsequence(x, y) / sizes
    return out


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    """jaro_winkler of each pair, all together."""
    out = np.array([1.0 if x == y else 0.0 for x, y in zip(a, b, strict=True)])
    todo = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y and x and y]
    out[todo] = batched.jaro_winkler([a[i] for i in todo], [b[i] for i in todo])
    return out


def token_sets(a: list[str], b: list[str]) -> np.ndarray:
    """token_set of each pair, all together: what is shared starts both wholes, so only the wholes need comparing."""
    out, at, left, right = np.zeros(len(a)), [], [], []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x, y = set(p.split()), set(q.split())
        shared = x & y
        if not x or not y:
            out[i] = float(p == q)
        elif shared and (len(shared) == len(x) or len(shared) == len(y)):
            out[i] = 1.0
        else:
            start = " ".join(sorted(shared))
            wholes = [f"{start} {rest}" if start else rest for rest in (" ".join(sorted(x - y)), " ".join(sorted(y - x)))]
            if start:
                out[i] = max(2 * len(start) / (len(start) + len(w)) for w in wholes)
            at.append(i)
            left.append(wholes[0])
            right.append(wholes[1])
    out[at] = np.maximum(out[at], indels(left, right))
    return out


def _over_pairs(scores):
    def batch(a: pa.Array, b: pa.Array) -> pa.Array:
        place: dict[tuple[str, str], int] = {}
        at = [place.setdefault((x or "", y or ""), len(place)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        found = scores([p[0] for p in place], [p[1] for p in place])
        return pa.array(found[at] if at else [], pa.float64())

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return batch(a, b)

    return F.arrow_udf(run, DoubleType())


_indel, _jaro_winkler, _token_set = _over_pairs(indels), _over_pairs(jaro_winklers), _over_pairs(token_sets)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Normalised insert-delete similarity, 2 LCS / (lengths)."""
    return _indel(a, b)


def jaro_winkler_ratio(a: Column, b: Column) -> Column:
    return _jaro_winkler(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    ordered = lambda s: F.array_join(F.array_sort(F.split(s, " ")), " ")
    return _indel(ordered(a), ordered(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    return _token_set(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token lists as sets."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))
