"""Embedding whitening from an exact integer scatter.

Entries become whole numbers. Every task subtracts the shift and sums its vectors and their cross-products without
rounding: matrix products of limbs so short that float64 holds their sums exactly, put together as integers of any
size. Only n * XᵀX - SSᵀ, formed exactly, is converted to float and decomposed by eigh.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored

#: An entry c becomes floor(FACTOR * c) + SHIFT; SHIFT is taken off before anything is multiplied.
FACTOR, SHIFT = 1024, 100_000
#: Components that are returned.
COMPONENTS = 8
#: Bits of a limb and rows of one product: 2 * 20 + 12 bits are within the 53 of a float64.
LIMB_BITS, PRODUCT_ROWS = 20, 4_096
#: Bits of the pieces in which integers of any size travel through Spark's sums of longs.
PIECE_BITS = 32
#: Entries beyond it either way, before the shift, are taken as this.
LARGEST = 9.2e18


def shifted(vectors: pa.ListArray, width: int) -> np.ndarray:
    """floor(FACTOR * c) of vectors of one width, as rows of longs: the whole numbers less their shift."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.clip(np.floor(values * FACTOR), -LARGEST, LARGEST).astype(np.int64)


def cross_products(x: np.ndarray) -> np.ndarray:
    """XᵀX of rows of longs as Python integers, exactly."""
    width = x.shape[1]
    total = np.zeros((width, width), object)
    for at in range(0, len(x), PRODUCT_ROWS):
        rest, limbs = x[at : at + PRODUCT_ROWS], []
        while np.abs(rest).max(initial=0) >= 1 << LIMB_BITS:
            limbs.append((rest & ((1 << LIMB_BITS) - 1)).astype(np.float64))
            rest = rest >> LIMB_BITS
        limbs.append(rest.astype(np.float64))
        for i, one in enumerate(limbs):
            for j, two in enumerate(limbs):
                total += (one.T @ two).astype(np.int64).astype(object) << LIMB_BITS * (i + j)
    return total


def _pieces(value: int) -> list[int]:
    """value as the sum of pieces times powers of 2**PIECE_BITS; the last one has the sign."""
    out = []
    while not -(1 << PIECE_BITS) < value < 1 << PIECE_BITS:
        out.append(value & ((1 << PIECE_BITS) - 1))
        value >>= PIECE_BITS
    return [*out, value]


def scatter(vectors: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S and the cross-products XᵀX of shifted vectors of one width. As large as the width squared, whatever n is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            x = shifted(batch.column(0), width)
            n += len(x)
            sums += (x >> PIECE_BITS).sum(0).astype(object) * (1 << PIECE_BITS) + (x & ((1 << PIECE_BITS) - 1)).sum(0).astype(object)
            products += cross_products(x)
        cells = [(-1, -1, n), *((-1, i, s) for i, s in enumerate(sums)), *((i, j, products[i, j]) for i in range(width) for j in range(i, width))] if n else []
        rows = [(i, j, k, v) for i, j, value in cells for k, v in enumerate(_pieces(int(value)))]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["i", "j", "piece", "v"])
        release()

    parts = vectors.select("embedding").mapInArrow(run, "i int, j int, piece int, v bigint").groupBy("i", "j", "piece").agg(F.sum("v").alias("v"))
    n, sums, products = 0, [0] * width, np.zeros((width, width), object)
    for r in parts.collect():  # a few rows for each pair of dimensions
        value = r.v << PIECE_BITS * r.piece
        if r.i >= 0:
            products[r.i, r.j] += value
            products[r.j, r.i] = products[r.i, r.j]
        elif r.j >= 0:
            sums[r.j] += value
        else:
            n += value
    return n, sums, products


def decompose(n: int, sums: list[int], products: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), unit eigenvectors (columns) and explained shares of the covariance (n * XᵀX - SSᵀ) / n².

    At most so many components, without those whose variance is zero up to rounding: the data give them no direction.
    """
    exact = n * products - np.outer(np.array(sums, object), np.array(sums, object))
    covariance = np.array([[v / (n * n) for v in row] for row in exact], np.float64)
    trace = sum(exact[i, i] for i in range(len(sums))) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = np.flatnonzero(values > len(sums) * np.finfo(np.float64).eps * max(values[0], 0.0))[:components]
    return values[kept], vectors[:, kept], values[kept] / trace if trace else values[kept]


def project(vectors: DataFrame, width: int, n: int, sums: list[int], values: np.ndarray, directions: np.ndarray) -> DataFrame:
    """vec_id, deviation (sum over dimensions of (n * x - S)²) and whitened (one entry for each component) of each vector."""
    total = np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shifted(batch.column(1), width)
            furthest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
            # n * x - S, in longs where they hold the sum of its squares
            x = n * x - total.astype(np.int64) if furthest * furthest * width < 1 << 63 else n * x.astype(object) - total
            deviation = pa.array([d if d < 10**38 else None for d in (x * x).sum(1).tolist()], pa.decimal128(38, 0))
            whitened = (x / n).astype(np.float64) @ directions / np.sqrt(values)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(values), pa.int32()), pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], ["vec_id", "deviation", "whitened"])
        release()

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, deviation decimal(38,0), whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for vectors (vec_id, embedding).

    Rows whose vector is null or holds null, NaN or infinite entries are left out, as are those of another length than
    most have (of equally many lengths, the longest). Repeated rows count and come back once for each; a null vec_id is
    kept; other columns are not read. Fewer components than asked for come back where the vectors span fewer, none where
    all are alike; an empty table gives an empty result. identity_error is measured on the whitened vectors: the largest
    entry of their covariance less the identity. Entries beyond the range of longs are taken as its ends,
    a deviation of more than 38 digits is null.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    vectors = vectors.select("vec_id", "embedding").where("embedding IS NOT NULL").where(finite).withColumn("embedding", F.col("embedding").cast("array<double>"))
    most = vectors.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    none = vectors.sparkSession.createDataFrame([], "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if most is None or not most["width"]:
        return none
    width = most["width"]
    vectors = vectors.where(F.size("embedding") == width)
    n, sums, products = scatter(vectors, width)
    values, directions, explained = decompose(n, sums, products, components)
    if not len(values):
        return none
    white = stored(project(vectors, width, n, sums, values, directions), "whitened")
    at = [F.col("whitened")[k] for k in range(len(values))]
    pairs = [(i, j) for i in range(len(at)) for j in range(i, len(at))]
    # covar_pop centres each value before it multiplies
    error = white.agg(F.greatest(F.lit(0.0), *(F.abs(F.covar_pop(at[i], at[j]) - float(i == j)) for i, j in pairs))).first()[0]
    shares = F.array(*(F.lit(float(e)) for e in explained))
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", shares[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"))
