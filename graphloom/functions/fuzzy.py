"""String similarity from 0 to 100: the plain ratio as a column expression, the others as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the table of prefixes at a time, folded over a's characters."""
    chars = lambda s: F.split(s, "")
    first = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(previous: Column, x: Column) -> Column:
        # acc grows by the entry for each character of b; the entry before it is acc's last
        step = lambda acc, j: F.array_append(acc, F.when(F.substr(b, j, F.lit(1)) == x, F.element_at(previous, j) + 1).otherwise(F.greatest(F.element_at(previous, j + 1), F.element_at(acc, -1))))
        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), step)

    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(F.element_at(F.aggregate(chars(a), first, row), -1))


def ratio(a: Column, b: Column) -> Column:
    """100 times twice the longest common subsequence over both lengths; two empty texts are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * longest_common(a, b) / total)


def could_reach(a: Column, b: Column, least: float) -> Column:
    """Whether lengths alone allow the ratio; loses no pair."""
    return F.lit(200.0) * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


def lcs(a: str, b: str) -> int:
    """Longest common subsequence with one integer's bits as the row of the table."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_of(a: str, b: str) -> float:
    """The best ratio of the shorter text with any window of its length of the longer one, or a shorter one at its ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    ends = [b[:k] for k in range(1, n)] + [b[-k:] for k in range(1, n)]
    return max(ratio_of(a, w) for w in [*(b[k : k + n] for k in range(len(b) - n + 1)), *ends])


def token_sort_of(a: str, b: str, by=ratio_of) -> float:
    return by(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str, by=ratio_of) -> float:
    """The best ratio among the common words, and those with what is left of either text."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    if by is partial_of:
        return 100.0 if both else by(left, right)
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([by(one, two), *([by(both, one), by(both, two)] if both else [])])


#: Weights of the combined ratio: of scores on sorted or common words, and of windows by how the lengths compare.
WORDS, WINDOWS, SHORT_WINDOWS = 0.95, 0.9, 0.6


def weighted_of(a: str, b: str) -> float:
    """The best of the plain ratio and weighted scores on words; windows count once one text is half as long again."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio_of(a, b)
    if longer < 1.5:
        return max(best, WORDS * max(token_sort_of(a, b), token_set_of(a, b)))
    scale = WINDOWS if longer <= 8 else SHORT_WINDOWS
    return max(best, scale * partial_of(a, b), WORDS * scale * max(token_sort_of(a, b, partial_of), token_set_of(a, b, partial_of)))


@F.pandas_udf(DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_of(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_of(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")
