"""Edit distances up to a limit, with one bit per cell of the band.

The band around the main diagonal holds the rows j - limit .. j + limit of column
j; bit k stands for row j - limit + k, so that bits keep their diagonal from one
column to the next. `plus` and `minus` say where a cell is one above or below
the one before it in the column, `level` where it equals its neighbour on the
diagonal. (Hyyro's form of Myers' algorithm.) The distance is read along the
diagonal that ends in the last cell.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np


def banded(a: Sequence[Hashable], b: Sequence[Hashable], limit: int) -> int:
    """The edit distance of two sequences, or limit + 1 if it is larger."""
    m, n = len(a), len(b)
    if abs(m - n) > limit:
        return limit + 1
    low, top = 0, min(m, n)
    while low < top and a[low] == b[low]:
        low += 1
    a, b, m, n, top = a[low:], b[low:], m - low, n - low, top - low
    end = 0
    while end < top and a[m - 1 - end] == b[n - 1 - end]:
        end += 1
    m, n = m - end, n - end
    if not m or not n:
        return max(m, n)
    limit_in = min(limit, max(m, n))
    width = 2 * limit_in + 1
    full = (1 << width) - 1
    where: dict[Hashable, int] = {}
    for i in range(m):
        where[a[i]] = where.get(a[i], 0) | (1 << i)
    plus, minus, score = full ^ ((1 << limit_in) - 1), 0, max(m - n, 0)
    read = 1 << (limit_in + m - n)
    for j in range(n):
        same = where.get(b[j], 0)
        shift = j - limit_in
        same = (same >> shift if shift >= 0 else same << -shift) & full
        level = ((((same & plus) + plus) ^ plus) | same | minus) & full
        right_up = minus | (full ^ (level | plus))
        right_down = level & plus
        if not level & read:
            score += 1
            if score > limit:
                return limit + 1
        down = level >> 1
        plus = right_down | (full ^ (down | right_up))
        minus = down & right_up
    return score


def banded_pairs(codes_a: Sequence[np.ndarray], codes_b: Sequence[np.ndarray], limit: int) -> np.ndarray:
    """The distances of many pairs at once, each limit + 1 if larger; limit at most 31.

    All pairs advance by one column together, with a 64-bit band each. Common ends
    are cut off first, and pairs beyond the limit leave early.
    """
    if not 0 <= limit <= 31:
        raise ValueError("limit must lie between 0 and 31")
    out = np.full(len(codes_a), limit + 1, np.int64)
    work: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, (a, b) in enumerate(zip(codes_a, codes_b, strict=True)):
        if abs(len(a) - len(b)) > limit:
            continue
        top = min(len(a), len(b))
        differ = np.flatnonzero(a[:top] != b[:top])
        low = int(differ[0]) if len(differ) else top
        tail = np.flatnonzero(a[len(a) - top + low :][::-1] != b[len(b) - top + low :][::-1])
        end = int(tail[0]) if len(tail) else top - low
        a, b = a[low : len(a) - end], b[low : len(b) - end]
        if not len(a) or not len(b):
            out[i] = max(len(a), len(b))
        else:
            work.append((i, a, b))
    if not work:
        return out
    work.sort(key=lambda w: -len(w[2]))
    at = np.array([w[0] for w in work])
    m, n = np.array([len(w[1]) for w in work]), np.array([len(w[2]) for w in work])
    none = np.full(limit, -1, np.int64)
    left = np.concatenate([x for w in work for x in (none, w[1].astype(np.int64), none, none)])
    right = np.concatenate([w[2] for w in work]).astype(np.int64)
    from_a = np.concatenate([[0], np.cumsum(m + 3 * limit)[:-1]])
    from_b = np.concatenate([[0], np.cumsum(n)[:-1]])
    width = 2 * limit + 1
    full = np.uint64((1 << width) - 1)
    one = np.uint64(1)
    plus = np.full(len(work), full ^ np.uint64((1 << limit) - 1), np.uint64)
    minus = np.zeros(len(work), np.uint64)
    score = np.maximum(m - n, 0)
    read = (limit + m - n).astype(np.uint64)
    live = np.arange(len(work))
    for j in range(int(n[0])):
        if j % 16 == 0 or n[live[-1]] <= j:
            live = live[(n[live] > j) & (score[live] <= limit)]
            if not len(live):
                break
        c = right[from_b[live] + j]
        same = np.zeros(len(live), np.uint64)
        for k in range(width):
            same |= (left[from_a[live] + j + k] == c).astype(np.uint64) << np.uint64(k)
        p, q = plus[live], minus[live]
        level = ((((same & p) + p) ^ p) | same | q) & full
        right_up, right_down = q | (full & ~(level | p)), level & p
        score[live] += ((level >> read[live]) & one) == 0
        down = level >> one
        plus[live], minus[live] = right_down | (full & ~(down | right_up)), down & right_up
    out[at] = np.minimum(score, limit + 1)
    return out
