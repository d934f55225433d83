"""String similarity: shares of the longest common subsequence, from 0 to 100, by pandas UDFs (not for use inside lambdas).

A row of the table of common lengths is the bits of one integer, so a letter costs a few operations on integers.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def places(text: str) -> dict[str, int]:
    """For each letter of a text, the bits of its positions."""
    out: dict[str, int] = {}
    for i, letter in enumerate(text):
        out[letter] = out.get(letter, 0) | 1 << i
    return out


def common(at: dict[str, int], size: int, text: str) -> int:
    """Length of the longest common subsequence of a text and one of `size` letters whose places are given."""
    full = row = (1 << size) - 1
    for letter in text:
        met = row & at.get(letter, 0)
        row = (row + met | row - met) & full
    return size - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if a == b else 200.0 * common(places(b), len(b), a) / (len(a) + len(b))


def best_window(short: str, long: str) -> float:
    """The best ratio of a text against the windows of its length, and the shorter ones at the edges, of a text not shorter.

    Windows one apart differ by one common letter at most, so those that can't pass the best so far are stepped over."""
    if short in long:
        return 100.0
    m, n, at = len(short), len(long), places(short)
    start = most = 0
    while start <= n - m:
        now = common(at, m, long[start : start + m])
        most = max(most, now)
        start += most - now + 1
    best = 200.0 * most / (2 * m)
    for w in range(m - 1, 0, -1):
        if 200.0 * w / (m + w) <= best:
            break
        best = max(best, *(200.0 * common(at, m, edge) / (m + w) for edge in (long[:w], long[n - w :])))
    return best


def whole_or_part(a: str, b: str) -> float:
    if len(a) == len(b):
        return max(best_window(a, b), best_window(b, a))
    return best_window(a, b) if len(a) < len(b) else best_window(b, a)


def _of_two(f: Callable[[str, str], float | int], kind: str) -> Callable[[Column, Column], Column]:
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype=object)

    return lambda a, b: F.pandas_udf(each, kind)(a, b)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    return _of_two(lambda x, y: common(places(y), len(y), x), "int")(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * common / (length of a + length of b); two empty strings are equal, null gives null."""
    return _of_two(ratio, "double")(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    """The best indel ratio of the shorter string against windows of the longer, edge windows included."""
    blank = (F.char_length(a) == 0) | (F.char_length(b) == 0)
    return F.when(a == b, F.lit(100.0)).when(blank, F.lit(0.0)).otherwise(_of_two(whole_or_part, "double")(a, b))
