"""Reading order: pairs of regions that two orders put the same way round, counted by inversions instead of pair by pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

#: Places that are compared each with each before runs are merged.
SMALL = 64
ORDER = StructType().add("ref_pairs", LongType()).add("hyp_pairs", LongType()).add("common", LongType())


def inversions(places: np.ndarray) -> int:
    """Pairs of different numbers of which the larger comes first, by merging sorted halves."""
    if len(places) < 2:
        return 0
    parts, count = np.array_split(places, -(-len(places) // SMALL)), 0
    for k, part in enumerate(parts):
        count += int(np.triu(part[:, None] > part, 1).sum())
        parts[k] = np.sort(part)
    while len(parts) > 1:
        merged = []
        for left, right in zip(parts[::2], parts[1::2], strict=False):
            count += int((len(left) - np.searchsorted(left, right, "right")).sum())
            merged.append(np.sort(np.concatenate([left, right]), kind="stable"))
        parts = merged + parts[len(parts) - len(parts) % 2 :]
    return count


def order_counts(ref: list, hyp: list) -> tuple[int, int, int]:
    """Ordered pairs of ref, of hyp, and those of both; a region that is named again counts where it comes first."""
    ref, place = list(dict.fromkeys(ref)), {r: k for k, r in enumerate(dict.fromkeys(hyp))}
    both = np.array([place[r] for r in ref if r in place], np.int64)
    pairs = lambda n: n * (n - 1) // 2
    return pairs(len(ref)), pairs(len(place)), pairs(len(both)) - inversions(both)


@F.pandas_udf(ORDER)
def region_order(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """order_counts of two lists of regions in each row; null lists are empty."""
    rows = [order_counts([] if r is None else list(r), [] if h is None else list(h)) for r, h in zip(ref, hyp, strict=True)]
    return pd.DataFrame(rows, columns=ORDER.names, dtype="int64")
