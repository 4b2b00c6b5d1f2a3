"""Exact edit distance and longest common subsequence of whole texts, bit-parallel.

A column of the table is two integers of as many bits as the longer text has signs (Myers 1999, Hyyrö 2003), so a text
of 30,000 signs costs 30,000 steps of 500 machine words. Where the distance is small beside the length, only a window
along the diagonal is kept, widened until the distance fits into it: the cut-off makes the cost follow the errors.
Batches of pairs are measured together: where a lower and an upper bound meet there is no table, and the windows of the
others are columns of 64-bit words, a word for each pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable, Sequence
from itertools import repeat, zip_longest
from operator import contains, eq

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: Diagonals on each side that are tried first, and how much wider a window is than a bound or the errors so far let expect.
FIRST_WINDOW, MARGIN = 24, 1.25


def common_ends(a: Sequence, b: Sequence) -> tuple[int, int]:
    """Lengths of the common head and of the common tail of what follows it."""
    short = min(len(a), len(b))
    head = next((k for k, same in enumerate(map(eq, a, b)) if not same), short) if short and a[0] == b[0] else 0
    rest = short - head
    tail = 0
    while tail < rest and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, tail


def _places(a: Sequence[Hashable]) -> dict:
    """Bits of the places of each sign of a."""
    lists: dict = {}
    for k, x in enumerate(a):
        lists.setdefault(x, []).append(k)
    size = (len(a) + 7) // 8
    out = {}
    for x, at in lists.items():
        if len(at) < 32:
            out[x] = sum(1 << k for k in at)
        else:
            raw = bytearray(size)
            for k in at:
                raw[k >> 3] |= 1 << (k & 7)
            out[x] = int.from_bytes(raw, "little")
    return out


def _whole(places: dict, n: int, b: Sequence) -> int:
    """The distance from the whole table; n is the length of the text of places."""
    full = (1 << n) - 1
    up, down = full, 0
    get = places.get
    for x in b:
        same = get(x, 0)
        zero = (((same & up) + up) ^ up) | same | down
        right = down | ~(zero | up) & full
        left = zero & up
        right = right << 1 | 1
        up = (left << 1 | ~(zero | right)) & full
        down = zero & right
    # the last column starts with the length of b and goes up or down at each place
    return len(b) + up.bit_count() - (down & full).bit_count()


def _windowed(places: dict, n: int, b: Sequence, beside: int) -> tuple[bool, int]:
    """Whether few edits do, and the distance, else how much of b was read; b is not the longer text.

    The window has the main diagonal, that of the last cell, those between and as many beside them on either side. A way that
    leaves it and comes back costs two edits for each diagonal beyond.
    """
    apart = n - len(b)
    width, most = apart + 2 * beside + 1, apart + 2 * beside + 1
    full = (1 << width) - 1
    # bit i of column j is row j - beside + i; rows above the first differ in nothing
    up, down = full >> beside << beside, 0
    goal = 1 << (beside + apart)
    found = apart
    get = places.get
    for j, x in enumerate(b, 1):
        same = get(x, 0)
        if same:
            # row r is bit r - 1 of the places
            same = (same >> (j - beside - 1) if j > beside else same << (beside + 1 - j)) & full
        zero = (((same & up) + up) ^ up) | same | down
        if not zero & goal:
            found += 1
            if found > most:
                return False, j
        right = down | ~(zero | up) & full
        left = zero & up
        zero = (zero & full) >> 1
        up = (left | ~(zero | right)) & full
        down = zero & right
    return True, found


def levenshtein(a: Sequence, b: Sequence, least: int = 0) -> int:
    """Least number of insertions, deletions and substitutions that make b of a (strings, or lists of hashable things).

    least is a lower bound, if one is known; the first window is as wide as it asks for.
    """
    if len(a) < len(b):
        a, b = b, a
    head, tail = common_ends(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not b:
        return len(a)
    places, n = _places(a), len(a)
    apart = n - len(b)
    beside = FIRST_WINDOW + int(MARGIN * max(0, least - apart) / 2)
    while apart + 2 * beside + 1 < n:
        inside, found = _windowed(places, n, b, beside)
        if inside:
            return found
        beside = max(2 * beside, int(MARGIN * beside * len(b) / found))
    return _whole(places, n, b)


def few_edits(a: Sequence, b: Sequence, most: int) -> int | None:
    """The distance if it is at most most, from as many diagonals as that takes."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    head, tail = common_ends(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not b:
        return len(a)
    inside, found = _windowed(_places(a), len(a), b, most // 2)
    return found if inside and found <= most else None


def common_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    head, tail = common_ends(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    places = _places(a)
    full = (1 << len(a)) - 1
    open_ = full
    for x in b:
        same = places.get(x, 0)
        if same:
            hit = open_ & same
            open_ = (open_ + hit | open_ & ~hit) & full
    return head + tail + len(a) - open_.bit_count()


#: Letters are counted in so many classes for the lower bound; signs of both texts that are measured together.
LETTER_CLASSES, SIGNS_AT_ONCE = 64, 1 << 20
#: More than any code point; signs that are read ahead where the surplus leaves two ways open; signs of two texts from which each
#: sign is counted for itself.
EVERY_SIGN, AHEAD, LONG = 0x110000, 4, 2_000
#: Diagonals of a word, and pairs below which a step on all of them costs more than pair after pair.
DIAGONALS, FEW_PAIRS = 63, 24


def is_within(short: Sequence, long: Sequence) -> bool:
    """Whether short is a subsequence of long."""
    if short == long[: len(short)]:
        return True
    rest = iter(long)
    return all(map(contains, repeat(rest), short))


def is_made_of(a: str, b: str, more: list[int] | dict[int, int], least: int, classes: int = LETTER_CLASSES) -> bool:
    """Whether b comes from a by least edits that lose only signs of which a has more, and add only those of which it has fewer.

    more is the surplus of a by class of letters, so least, the larger sum of its two sides, is a lower bound; a way of that cost
    shows that it is the distance. Where the texts part, the surplus tells the edit, and the next signs if it leaves two. Equal runs are passed 64 signs at once.
    """
    try:
        x, y, width = a.encode("latin-1"), b.encode("latin-1"), 1
    except UnicodeEncodeError:
        x, y, width = a.encode("utf-32-le", "surrogatepass"), b.encode("utf-32-le", "surrogatepass"), 4
    n, m, bits, step, read = len(a), len(b), 8 * width, 64 * width, int.from_bytes
    i = j = cost = 0
    while i < n and j < m:
        if a[i] == b[j]:
            p, q = i * width, j * width
            differ = read(x[p : p + step], "little") ^ read(y[q : q + step], "little")
            # beyond its end a text reads as zeros
            run = min(((differ & -differ).bit_length() - 1) // bits if differ else 64, n - i, m - j)
            i, j = i + run, j + run
            continue
        lost, added = ord(a[i]) % classes, ord(b[j]) % classes
        loses, adds = more[lost] > 0, more[added] < 0
        if not (loses or adds) or cost == least:
            return False
        cost += 1
        if loses and adds:
            # one for the other, unless what follows says that it is one of the two
            near, far = a[i + 1 : i + 1 + AHEAD], b[j + 1 : j + 1 + AHEAD]
            if near != far:
                fit = common_ends(near, far)[0]
                if common_ends(near, b[j : j + AHEAD])[0] > fit:
                    adds = False
                elif common_ends(a[i : i + AHEAD], far)[0] > fit:
                    loses = False
        if loses:
            more[lost] -= 1
            i += 1
        if adds:
            more[added] += 1
            j += 1
    return cost + max(n - i, m - j) == least


def _signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the lengths of each."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.fromiter(map(len, texts), np.int64, len(texts))


def _letters(signs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each class of letters is in each text."""
    at = np.repeat(np.arange(len(lengths)) * LETTER_CLASSES, lengths) + signs % LETTER_CLASSES
    return np.bincount(at, minlength=len(lengths) * LETTER_CLASSES).reshape(-1, LETTER_CLASSES)


def _in_words(a: list[str], b: list[str]) -> np.ndarray:
    """Distances of pairs whose lengths differ by less than DIAGONALS, no b longer than its a; -1 where more diagonals are needed.

    The window has the main diagonal, that of the last cell and as many on both sides as fit in a word. A way that leaves
    it and comes back costs at least two edits more than the distance of its outermost diagonals.
    """
    order = sorted(range(len(a)), key=lambda k: -len(b[k]))
    (x, n), (y, m) = _signs([a[k] for k in order]), _signs([b[k] for k in order])
    apart = n - m
    beside = (DIAGONALS - 1 - apart) // 2
    both = np.concatenate([x, y])
    used = np.zeros(int(both.max()) + 1, bool)
    used[both] = True
    kinds = np.count_nonzero(used)
    small = np.uint8 if kinds < 255 else np.uint16 if kinds < 65_535 else np.uint32
    coded = (np.cumsum(used) - 1)[both]
    coded, rows = coded.astype(small) + small(1), np.arange(len(a))
    # 0 is no sign; a column of the long text's window starts at the number of the short one's sign
    long = np.zeros((len(a), int(m[0]) + DIAGONALS), small)
    at = np.repeat(beside, n) + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    long[np.repeat(rows, n), at] = coded[: len(x)]
    short = np.zeros((int(m[0]), len(a)), small)
    short[np.arange(len(y)) - np.repeat(np.cumsum(m) - m, m), np.repeat(rows, m)] = coded[len(x) :]
    one, full = np.uint64(1), np.uint64((1 << DIAGONALS) - 1)
    side = beside.astype(np.uint64)
    up, down = full >> side << side, np.zeros(len(a), np.uint64)
    goal = (beside + apart).astype(np.uint64)
    found = apart.copy()
    lines = np.zeros((len(a), DIAGONALS + 1), bool)
    active = np.searchsorted(-m, -np.arange(1, int(m[0]) + 1), "right")
    for j, live in enumerate(active.tolist()):
        if live < FEW_PAIRS:
            found[:live] = apart[:live] + 2 * beside[:live] + 2
            break
        np.equal(long[:live, j : j + DIAGONALS], short[j, :live, None], out=lines[:live, :DIAGONALS])
        same = np.packbits(lines[:live], axis=1, bitorder="little").view("<u8")[:, 0]
        u, d = up[:live], down[:live]
        zero = (((same & u) + u) ^ u) | same | d
        found[:live] += (~(zero >> goal[:live]) & one).astype(np.int64)
        right = d | ~(zero | u) & full
        left = zero & u
        zero = (zero & full) >> one
        up[:live] = (left | ~(zero | right)) & full
        down[:live] = zero & right
    out = np.empty(len(a), np.int64)
    out[order] = np.where(found <= apart + 2 * beside + 1, found, -1)
    return out


def _together(a: list[str], b: list[str]) -> np.ndarray:
    """distances() of unequal pairs of a bounded size."""
    (x, n), (y, m) = _signs(a), _signs(b)
    more = _letters(x, n) - _letters(y, m)
    least = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
    out = np.full(len(a), -1)
    alike = np.flatnonzero(n == m)
    if len(alike):
        mine = n == m
        differ = x[np.repeat(mine, n)] != y[np.repeat(mine, m)]
        unequal = np.bincount(np.repeat(np.arange(len(alike)), n[alike]), differ, len(alike)).astype(np.int64)
        met = unequal == least[alike]
        out[alike[met]] = unequal[met]
    for k in np.flatnonzero((out < 0) & (least == np.abs(n - m))):
        if is_within(*((a[k], b[k]) if n[k] < m[k] else (b[k], a[k]))):
            out[k] = least[k]
    for k in np.flatnonzero((out < 0) & (n + m < LONG)):
        if is_made_of(a[k], b[k], more[k].tolist(), int(least[k])):
            out[k] = least[k]
    open_ = np.flatnonzero((out < 0) & (least < DIAGONALS) & (n > 0) & (m > 0))
    if len(open_) >= FEW_PAIRS:
        ordered = [(a[k], b[k]) if n[k] >= m[k] else (b[k], a[k]) for k in open_]
        out[open_] = _in_words(*map(list, zip(*ordered, strict=True)))
    for k in np.flatnonzero(out < 0):
        # signs of one class may hide each other
        own, others = Counter(a[k]), Counter(b[k])
        by_sign = {ord(x): own[x] - others[x] for x in own.keys() | others.keys()}
        lost = sum(x for x in by_sign.values() if x > 0)
        bound = max(lost, lost + len(b[k]) - len(a[k]))
        out[k] = bound if is_made_of(a[k], b[k], by_sign, bound, EVERY_SIGN) else levenshtein(a[k], b[k], bound)
    return out


def distances(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """levenshtein() of each pair of texts. Equal pairs cost nothing; pairs whose signs alone say as much as their places, or of
    which one is within the other, cost a reading."""
    out = np.zeros(len(a), np.int64)
    part, size = [], 0
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x != y:
            part.append(k)
            size += len(x) + len(y)
        if size >= SIGNS_AT_ONCE:
            out[part] = _together([a[i] for i in part], [b[i] for i in part])
            part, size = [], 0
    if part:
        out[part] = _together([a[i] for i in part], [b[i] for i in part])
    return out


@F.pandas_udf(LongType())
def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    known = np.flatnonzero(a.notna().to_numpy() & b.notna().to_numpy())
    out = pd.Series(pd.NA, range(len(a)), dtype="Int64")
    out.iloc[known] = distances(a.iloc[known].tolist(), b.iloc[known].tolist())
    return out


@F.pandas_udf(ArrayType(LongType()))
def line_distances(a: pd.Series, b: pd.Series) -> pd.Series:
    """Distances of the lines of two texts by number, as many as the text with more lines has; null where a text is."""
    out, rows, left, right = [None] * len(a), [], [], []

    def measured() -> None:
        found = np.split(distances(left, right), np.cumsum([n for _, n in rows])[:-1])
        for (k, _), errors in zip(rows, found, strict=True):
            out[k] = errors
        for column in (rows, left, right):
            column.clear()

    size = 0
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is None or y is None:
            continue
        pairs = list(zip_longest(x.split("\n"), y.split("\n"), fillvalue=""))
        rows.append((k, len(pairs)))
        left.extend(p for p, _ in pairs)
        right.extend(p for _, p in pairs)
        size += len(x) + len(y)
        if size >= SIGNS_AT_ONCE:
            measured()
            size = 0
    if rows:
        measured()
    return pd.Series(out, dtype=object)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points of two columns, each evaluated once; null where one is.

    Equal texts cost nothing, all others are measured in Arrow batches.
    """
    differ = a != b
    return F.when(a == b, F.lit(0)).otherwise(_distances(F.when(differ, a), F.when(differ, b))).cast("bigint")
