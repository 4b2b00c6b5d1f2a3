"""One-to-one matching of entities and of regions by overlap; Arrow-batched, as a greedy choice is no column function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

SPAN = "array<struct<label:string,start:bigint,end:bigint>>"
REGION = "array<struct<type:string,x:double,y:double,w:double,h:double>>"
_COUNTS = ArrayType(StructType().add("label", StringType()).add("tp", LongType()).add("fp", LongType()).add("fn", LongType()))


def span_overlap(a: dict, b: dict) -> float:
    """Shared characters over all characters of two spans (end exclusive)."""
    shared = max(0, min(a["end"], b["end"]) - max(a["start"], b["start"]))
    union = max(0, a["end"] - a["start"]) + max(0, b["end"] - b["start"]) - shared
    return shared / union if union > 0 else 0.0


def box_overlap(a: dict, b: dict) -> float:
    """Shared area over all area of two boxes."""
    wide = max(0.0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]))
    high = max(0.0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - wide * high
    return wide * high / union if wide * high and union > 0 else 0.0


def matched(refs: list[dict], hyps: list[dict], label: str, overlap, low, high, least: float) -> list[tuple[int, int]]:
    """Pairs of positions with equal labels (but for case) and an overlap of least or more, the largest first.

    Both sides are swept in the order of their beginnings, so only pairs that touch are compared.
    """
    order = sorted(range(len(hyps)), key=lambda j: low(hyps[j]))
    open_: list[int] = []
    found, at = [], 0
    for i in sorted(range(len(refs)), key=lambda i: low(refs[i])):
        while at < len(order) and low(hyps[order[at]]) < high(refs[i]):
            open_.append(order[at])
            at += 1
        open_ = [j for j in open_ if high(hyps[j]) > low(refs[i])]
        for j in open_:
            if refs[i][label].casefold() == hyps[j][label].casefold() and (score := overlap(refs[i], hyps[j])) >= least:
                found.append((-score, i, j))
    used_i, used_j, pairs = set(), set(), []
    for _, i, j in sorted(found):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            pairs.append((i, j))
    return pairs


def counts(refs: list[dict], hyps: list[dict], pairs: list[tuple[int, int]], label: str) -> list[dict]:
    """Hits, surplus and missing ones of each label; hits and missing ones go to the reference's label."""
    rows: dict[str, dict] = {}
    hit_i, hit_j = {i for i, _ in pairs}, {j for _, j in pairs}
    at = lambda name: rows.setdefault(name, {"label": name, "tp": 0, "fp": 0, "fn": 0})
    for i, r in enumerate(refs):
        at(r[label])["tp" if i in hit_i else "fn"] += 1
    for j, h in enumerate(hyps):
        if j not in hit_j:
            at(h[label])["fp"] += 1
    return [rows[k] for k in sorted(rows)]


def _matcher(label: str, overlap, low, high, least: float):
    @F.pandas_udf(_COUNTS)
    def run(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        out = []
        for r, h in zip(refs, hyps, strict=True):
            r, h = (list(x) if x is not None else [] for x in (r, h))
            out.append(counts(r, h, matched(r, h, label, overlap, low, high, least), label))
        return pd.Series(out, dtype=object)

    return run


def entity_counts(least: float = 0.5):
    """A column function (references, found), both SPAN: counts by label. Null arrays are empty."""
    return _matcher("label", span_overlap, lambda e: e["start"], lambda e: e["end"], least)


def region_counts(least: float = 0.5):
    """A column function (references, found), both REGION: counts by type. Null arrays are empty."""
    return _matcher("type", box_overlap, lambda r: r["y"], lambda r: r["y"] + r["h"], least)
