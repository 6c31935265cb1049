"""Numeric features of texts, computed over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from graphlens.llm.common import FOLD, SPACE, U64, Substrings, mix, per_row, words

NAMES = (
    "log_words mean_word letters digits symbols upper spaces distinct_words repeated_word distinct_pairs distinct_fives "
    "top_word words_per_line distinct_lines stops symbol_words long_word short_words bars line_ends same_start"
).split()

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[46, 33, 63]] = True
_BAR = np.zeros(256, bool)
_BAR[[124, 60, 62, 123, 125, 61, 95, 47, 92]] = True
_SYMBOL = ~(_LETTER | _DIGIT | SPACE | _STOP)
_SYMBOL[[44, 39, 45, 34, 58, 59]] = False


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of distinct keys, and how often the most frequent one occurs."""
    count, most = np.zeros(n), np.zeros(n)
    if len(keys):
        salted = np.sort((mix(keys + rows.astype(U64) * U64(0xD1B54A32D192ED03)) >> U64(24)) | (rows.astype(U64) << U64(40)))
        first = np.flatnonzero(np.concatenate([[True], salted[1:] != salted[:-1]]))
        runs, at = np.diff(np.append(first, len(salted))), (salted[first] >> U64(40)).astype(np.int64)
        count = np.bincount(at, minlength=n).astype(float)
        np.maximum.at(most, at, runs)
    return count, most


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of `NAMES` per text. A text without words has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    if not len(raw):
        return out
    size = np.maximum(np.diff(offsets), 1)
    share = lambda table: per_row(table[raw].astype(np.int64), offsets, np.add, 0) / size
    starts, ends, rows = words(raw, offsets)
    lengths = ends - starts
    count = np.bincount(rows, minlength=n).astype(float)
    some = np.maximum(count, 1)
    sub = Substrings(FOLD[raw])
    keys = sub.of(starts, ends)
    kinds, top = _distinct(keys, rows, n)

    def grams(k: int) -> np.ndarray:
        if len(keys) < k:
            return np.ones(n)
        whole = rows[k - 1 :] == rows[: len(rows) - k + 1]
        made = keys[: len(keys) - k + 1].copy()
        for j in range(1, k):
            made = mix(made) + keys[j : len(keys) - k + 1 + j]
        at = rows[: len(keys) - k + 1][whole]
        total = np.bincount(at, minlength=n)
        return np.where(total > 0, _distinct(made[whole], at, n)[0] / np.maximum(total, 1), 1.0)

    # lines: cut at new lines and at the ends of texts
    breaks = raw == 10
    cuts = np.unique(np.concatenate([np.flatnonzero(breaks) + 1, offsets]))
    begin, end = cuts[:-1], cuts[1:]
    filled = end - begin > 1
    begin, end = begin[filled], end[filled]
    at = np.searchsorted(offsets, begin, side="right") - 1
    lines = np.maximum(np.bincount(at, minlength=n), 1)
    stripped = np.where(raw[end - 1] == 10, end - 1, end)
    last = raw[np.maximum(stripped - 1, 0)]
    kinds_of_lines, _ = _distinct(sub.of(begin, stripped), at, n)
    heads, _ = _distinct(sub.of(begin, np.minimum(begin + 6, stripped)), at, n)
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (rows[1:] == rows[:-1])
    symbol = _SYMBOL[raw[starts]] | _SYMBOL[raw[np.maximum(ends - 1, 0)]] | _SYMBOL[raw[np.maximum(ends - 2, starts)]]
    columns = [
        np.log1p(count), np.bincount(rows, lengths, n) / some, share(_LETTER), share(_DIGIT), share(_SYMBOL), share(_UPPER), share(SPACE),
        kinds / some, np.bincount(rows, same, n) / some, grams(2), grams(5), top / some, count / lines,
        kinds_of_lines / lines, np.bincount(rows, _STOP[raw[ends - 1]], n) / some, np.bincount(rows, symbol, n) / some,
        np.log1p(per_row(lengths, np.searchsorted(rows, np.arange(n + 1)), np.maximum, 0)), np.bincount(rows, lengths <= 2, n) / some,
        share(_BAR), np.bincount(at, _STOP[last], n) / lines, 1 - heads / lines,
    ]
    out[:] = np.stack(columns, axis=1)
    out[count == 0] = 0
    return out
