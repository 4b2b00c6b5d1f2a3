"""Scores and degradations of grey images, given as height, width and one byte a pixel; Arrow-batched numpy.

Decoding image files is left to the reader of the caller's choice, as no decoder comes with Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructType

SCORES = ("sharpness", "noise", "rotation", "contrast")
# Scales and weights of the scores.
_SHARP, _NOISE, _WEIGHTS = 500.0, 30.0, {"sharpness": 0.4, "contrast": 0.3, "noise": 0.2, "rotation": 0.1}
COMPLEXITY = {"noise": 0.25, "blur": 0.25, "low_contrast": 0.25, "rotation": 0.25}
KINDS = ("noise", "blur", "rotation", "resolution", "binarisation")


def scores(grey: np.ndarray) -> tuple[float, float, float, float]:
    """Sharpness (variance of the Laplacian), noise (median step), rotation (degrees, the best of ±5) and contrast of an image."""
    a = grey.astype(np.float64)
    h, w = a.shape
    if not a.size:
        return 0.0, 0.0, 0.0, 0.0
    lap = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1] if min(h, w) >= 3 else a
    noise = float(np.median(np.concatenate([np.abs(np.diff(a, axis=1)).ravel(), np.abs(np.diff(a, axis=0)).ravel()]))) if min(h, w) >= 2 else 0.0
    low, high = np.percentile(a, [5, 95])
    return min(1.0, float(lap.var()) / _SHARP), min(1.0, noise / _NOISE), rotation(a), float((high - low) / (high + low)) if low + high else 0.0


def rotation(a: np.ndarray) -> float:
    """The whole angle up to 5 degrees whose shifted rows differ most in their sums; 0 for small images."""
    h, w = a.shape
    if min(h, w) < 20:
        return 0.0
    rows = a[:: max(1, h // 100)]
    # sums of each row from any column on
    tails = np.concatenate([np.cumsum(rows[:, ::-1], axis=1)[:, ::-1], np.zeros((len(rows), 1))], axis=1)
    best = max(range(-5, 6), key=lambda d: (tails[np.arange(len(rows)), np.clip(np.round(np.arange(len(rows)) * math.tan(math.radians(d))).astype(int), 0, w - 1)].var(), -d))
    return float(best)


def degraded(grey: np.ndarray, kind: str, level: float, seed: int = 0) -> np.ndarray:
    """An image with more noise (standard deviation), blur (radius), rotation (degrees), less resolution (share kept) or two tones."""
    a = grey.astype(np.float64)
    if not a.size or level == 0 and kind != "binarisation":
        return grey
    if kind == "noise":
        a = a + np.random.default_rng(seed).normal(0, level, a.shape)
    elif kind == "blur":
        r = int(level)
        padded = np.pad(a, r, mode="edge")
        a = sum(padded[y : y + a.shape[0], x : x + a.shape[1]] for y in range(2 * r + 1) for x in range(2 * r + 1)) / (2 * r + 1) ** 2
    elif kind == "rotation":
        h, w = a.shape
        y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
        c, s = math.cos(math.radians(level)), math.sin(math.radians(level))
        sy, sx = np.rint(c * y + s * x + (h - 1) / 2).astype(int), np.rint(c * x - s * y + (w - 1) / 2).astype(int)
        inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
        a = np.where(inside, a[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 255.0)
    elif kind == "resolution":
        keep = [np.minimum((np.arange(n) * max(1, round(n * level)) // n) * n // max(1, round(n * level)), n - 1) for n in a.shape]
        a = a[keep[0]][:, keep[1]]
    elif kind == "binarisation":
        counts = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
        below, sums = np.cumsum(counts), np.cumsum(counts * np.arange(256))
        with np.errstate(divide="ignore", invalid="ignore"):
            between = np.nan_to_num((sums[-1] * below - sums * below[-1]) ** 2 / (below * (below[-1] - below)))
        a = np.where(grey > int(between.argmax()), 255.0, 0.0)
    else:
        raise KeyError(f"no degradation is named {kind}")
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


_RESULT = StructType()
for _name in SCORES:
    _RESULT.add(_name, DoubleType())


@F.pandas_udf(_RESULT)
def image_scores(height: pd.Series, width: pd.Series, pixels: pd.Series) -> pd.DataFrame:
    """scores() of each image; zeros for none and for pixels that do not fill it."""
    rows = []
    for h, w, p in zip(height, width, pixels, strict=True):
        good = p is not None and h and w and len(p) == h * w
        rows.append(scores(np.frombuffer(p, np.uint8).reshape(int(h), int(w))) if good else (0.0,) * 4)
    return pd.DataFrame(rows, columns=list(SCORES))


def degraded_pixels(kind: str, level: float):
    """A column function (height, width, pixels): the pixels of the degraded image."""

    @F.pandas_udf(BinaryType())
    def run(height: pd.Series, width: pd.Series, pixels: pd.Series) -> pd.Series:
        return pd.Series([degraded(np.frombuffer(p, np.uint8).reshape(int(h), int(w)), kind, level).tobytes() for h, w, p in zip(height, width, pixels, strict=True)], dtype=object)

    return run


def quality(s: Column) -> Column:
    """The weighted quality (0 to 1, four places) of a struct of scores."""
    value = _WEIGHTS["sharpness"] * s["sharpness"] + _WEIGHTS["contrast"] * s["contrast"] + _WEIGHTS["noise"] * (1 - s["noise"]) + _WEIGHTS["rotation"] * F.greatest(F.lit(0.0), 1 - F.abs(s["rotation"]) / 10)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 4)


def tier(q: Column) -> Column:
    return F.when(q >= 0.7, "good").when(q >= 0.4, "medium").otherwise("poor")


def complexity(s: Column, weights: dict[str, float] = COMPLEXITY, most_degrees: float = 10.0) -> Column:
    """How hard an image is to read: the weighted mean of noise, blur, lack of contrast and rotation, each 0 to 1."""
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    parts = {"noise": clip(s["noise"]), "blur": 1 - clip(s["sharpness"]), "low_contrast": 1 - clip(s["contrast"]), "rotation": clip(F.abs(s["rotation"]) / most_degrees)}
    return clip(sum(weights[k] * v for k, v in parts.items()) / sum(weights.values()))
