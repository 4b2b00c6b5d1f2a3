"""Edit scripts of words, and of characters within runs of unequal words; Arrow-batched, as no column function gives them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .distance import common_ends, is_within, levenshtein

#: Weight of an edit against a hit: of all shortest scripts the one with most hits is taken.
EDIT = 1 << 32
#: Cells of a table that is kept for tracing back; larger problems are halved first.
CELLS = 1 << 20

COUNTS = StructType()
for _name in ("hits", "subs", "dels", "ins"):
    COUNTS.add(_name, LongType())
PAIRS = ArrayType(StructType().add("g", StringType()).add("o", StringType()))


def _rows(a: np.ndarray, b: np.ndarray):
    """The rows of the cost table of a against b, one at a time."""
    steps = EDIT * np.arange(len(b) + 1, dtype=np.int64)
    row = steps.copy()
    yield row
    for x in a:
        best = row + EDIT
        np.minimum(best[1:], row[:-1] + np.where(b == x, -1, EDIT), out=best[1:])
        row = np.minimum.accumulate(best - steps) + steps
        yield row


def _last(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    for row in _rows(a, b):
        pass
    return row


def _plainly(a: list, b: list) -> list[tuple[int, int]] | None:
    """The script where reading the two is enough to know it: as many signs on both sides and no hit to be won by moving
    one, or all of one side within the other, from its end. It is the one that the table gives."""
    n, m = len(a), len(b)
    if n == m:
        same = sum(map(eq, a, b))
        return [(k, k) for k in range(n)] if shared(a, b) == same else None
    if n * m > CELLS:
        return None
    short, long = (a, b) if n < m else (b, a)
    at, i = [-1] * len(long), len(short)
    for j in range(len(long) - 1, -1, -1):
        if i and long[j] == short[i - 1]:
            i -= 1
            at[j] = i
        elif i > j:
            return None
    return [(i, j) if n < m else (j, i) for j, i in enumerate(at)]


def shared(a: list, b: list) -> int:
    """Signs that both have, wherever they stand."""
    times: dict = {}
    for x in a:
        times[x] = times.get(x, 0) + 1
    found = 0
    for x in b:
        if left := times.get(x):
            times[x] = left - 1
            found += 1
    return found


#: Diagonals up to which the table is filled cell by cell.
NARROW = 24


def _band(a: list, b: list, edits: int) -> tuple[list[list[int]], int]:
    """The table's rows along the diagonals that a script of so many edits can reach, and the first of these; far is beyond them.

    Cells of best scripts have their costs, no other cell has less than its cost.
    """
    n, m = len(a), len(b)
    beside = (edits - abs(n - m)) // 2
    low, high = min(0, m - n) - beside, max(0, m - n) + beside
    width, far = high - low + 1, EDIT << 20
    row = [EDIT * t if 0 <= (t := low + k) <= m else far for k in range(width)]
    rows = [row]
    for i, x in enumerate(a, 1):
        before, row, left = row, [far] * width, far
        for k in range(max(0, -low - i), min(width, m - low - i + 1)):
            j = i + low + k
            best = before[k] + (-1 if b[j - 1] == x else EDIT) if j else far
            if k + 1 < width and before[k + 1] + EDIT < best:
                best = before[k + 1] + EDIT
            if left + EDIT < best:
                best = left + EDIT
            row[k] = left = best
        rows.append(row)
    return rows, low


def script(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Pairs of positions in order; -1 stands for none (a deletion or an insertion)."""
    a, b = ([*x.tolist()] if isinstance(x, np.ndarray) else x for x in (a, b))
    head, tail = common_ends(a, b)
    left = [(k, k) for k in range(head)]
    right = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        middle = [(i, -1) for i in range(n)] + [(-1, j) for j in range(m)]
    elif (middle := _plainly(a, b)) is None:
        middle = _tabled(a, b)
    return left + [(i + head if i >= 0 else -1, j + head if j >= 0 else -1) for i, j in middle] + right


def _tabled(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    if n == 1 or n * m <= CELLS:
        edits = levenshtein(a, b)
        if edits < NARROW:
            rows, low = _band(a, b, edits)
            at = lambda i, j: rows[i][j - i - low] if 0 <= j - i - low < len(rows[0]) else EDIT << 20
            return _traced(a, b, at)
    codes = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([codes[w] for w in t], np.int64) for t in (a, b))
    if n > 1 and n * m > CELLS:
        half = n // 2
        cut = int(np.argmin(_last(x[:half], y) + _last(x[half:][::-1], y[::-1])[::-1]))
        return script(a[:half], b[:cut]) + [(i + half if i >= 0 else -1, j + cut if j >= 0 else -1) for i, j in script(a[half:], b[cut:])]
    table = list(_rows(x, y))
    return _traced(a, b, lambda i, j: table[i][j])


def _traced(a: Sequence, b: Sequence, at: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """The script of a table, from its end: a pair before a deletion, a deletion before an insertion."""
    i, j, out = len(a), len(b), []
    cost = at(i, j)
    while i or j:
        if i and j and cost == (before := at(i - 1, j - 1)) + (-1 if a[i - 1] == b[j - 1] else EDIT):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost == (before := at(i - 1, j)) + EDIT:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            before = at(i, j)
            out.append((-1, j))
        cost = before
    return out[::-1]


def by_surplus(a: list, b: list) -> tuple[int, int, bool]:
    """A lower bound of the edits between a and b, the signs that both have, and whether one script has that few edits and so many hits.

    It loses only signs of which a has more and adds only those of which it has fewer; where the texts part, that alone tells the edit.
    """
    more: dict = {}
    for x in a:
        more[x] = more.get(x, 0) + 1
    for x in b:
        more[x] = more.get(x, 0) - 1
    lost = sum(x for x in more.values() if x > 0)
    both = len(a) - lost
    least, n, m = max(lost, len(b) - both), len(a), len(b)
    i = j = cost = hits = 0
    while i < n and j < m:
        x, y = a[i], b[j]
        if x == y:
            i, j, hits = i + 1, j + 1, hits + 1
            continue
        loses, adds = more[x] > 0, more[y] < 0
        if not (loses or adds) or cost == least:
            return least, both, False
        cost += 1
        if loses:
            more[x] -= 1
            i += 1
        if adds:
            more[y] += 1
            j += 1
    return least, both, cost + max(n - i, m - j) == least and hits == both


def operation_counts(a: list, b: list) -> tuple[int, int, int, int]:
    """Hits, substitutions, deletions and insertions of the shortest script with most hits.

    Where reading the two is not enough, the distance comes first, bit-parallel; the table is then filled along the
    diagonals that it allows.
    """
    head, tail = common_ends(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return head + tail, 0, n, m
    if n != m and is_within(*((a, b) if n < m else (b, a))):
        return head + tail + min(n, m), 0, max(0, n - m), max(0, m - n)
    k, hits, told = by_surplus(a, b)
    if not told and not (n == m and sum(map(eq, a, b)) == hits):
        k = levenshtein(a, b, k)
        hits = _most_hits(a, b, k)
    subs = n + m - 2 * hits - k
    return head + tail + hits, subs, n - hits - subs, m - hits - subs


def _most_hits(a: list, b: list, edits: int) -> int:
    """Hits of the scripts of so many edits, the fewest, that have most."""
    n, m = len(a), len(b)
    if edits < NARROW:
        rows, low = _band(a, b, edits)
        return EDIT * edits - rows[n][m - n - low]
    codes = {w: c for c, w in enumerate(dict.fromkeys([*a, *b]))}
    beside = (edits - abs(n - m)) // 2
    low, width = min(0, m - n) - beside, abs(n - m) + 2 * beside + 1
    # column t of row i is place i + low + t of b
    y = np.array([-1] * -low + [codes[w] for w in b] + [-1] * (n + width))
    steps, far = EDIT * np.arange(width, dtype=np.int64), np.int64(1) << 60
    row = np.where(np.arange(width) >= -low, steps + EDIT * low, far)
    for i, word in enumerate(a):
        best = row + np.where(y[i : i + width] == codes[word], -1, EDIT)
        np.minimum(best[:-1], row[1:] + EDIT, out=best[:-1])
        row = np.minimum(np.minimum.accumulate(best - steps) + steps, far)
    return int(EDIT * edits - row[m - n - low])


def word_script(gt: str, hyp: str) -> tuple[list[str], list[str], list[tuple[int, int]]]:
    g, h = gt.split(), hyp.split()
    return g, h, script(g, h)


def run_lengths(a: list, b: list) -> Iterator[tuple[int, int]]:
    """Lengths on both sides of the runs between hits."""
    n = m = 0
    for i, j in script(a, b):
        if i >= 0 and j >= 0 and a[i] == b[j]:
            if n or m:
                yield n, m
            n = m = 0
        else:
            n, m = n + (i >= 0), m + (j >= 0)
    if n or m:
        yield n, m


def unequal_runs(gt: str, hyp: str) -> Iterator[tuple[str, str]]:
    """The runs of words between hits, as texts of both sides."""
    g, h, pairs = word_script(gt, hyp)
    left, right = [], []
    for i, j in pairs:
        if i >= 0 and j >= 0 and g[i] == h[j]:
            if left or right:
                yield " ".join(left), " ".join(right)
            left, right = [], []
        else:
            left += [g[i]] if i >= 0 else []
            right += [h[j]] if j >= 0 else []
    if left or right:
        yield " ".join(left), " ".join(right)


@lru_cache(1 << 14)
def character_edits(g: str, h: str) -> tuple[tuple[str, str], ...]:
    """The unequal pairs of characters of two runs of words; the empty string stands for none or white space."""
    pairs = script(g, h)
    made = ((g[i].strip() if i >= 0 else "", h[j].strip() if j >= 0 else "") for i, j in pairs)
    return tuple(p for p in made if p[0] != p[1])


@F.pandas_udf(COUNTS)
def word_operations(gt: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Counts of the shortest script of words with most hits; null texts count as empty."""
    out = [operation_counts(x.split(), y.split()) for x, y in zip(gt.fillna(""), hyp.fillna(""), strict=True)]
    return pd.DataFrame(out, columns=["hits", "subs", "dels", "ins"], dtype="int64")


@F.pandas_udf(PAIRS)
def character_confusions(gt: pd.Series, hyp: pd.Series) -> pd.Series:
    """Unequal characters of each run of unequal words; white space is neither lost nor added."""
    out = []
    for x, y in zip(gt.fillna(""), hyp.fillna(""), strict=True):
        out.append([{"g": p, "o": q} for a, b in unequal_runs(x, y) for p, q in character_edits(a, b)])
    return pd.Series(out, dtype=object)
