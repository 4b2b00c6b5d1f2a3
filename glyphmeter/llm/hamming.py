"""Exact top-k search over binary codes by incremental multi-index hashing.

A code has one bit for each dimension, set where the value is positive. Its bytes are the segments of the index: each
has a table from its 256 values to the codes that hold them. A query looks up growing radii of each segment in turn;
once radius r is done in the segments before s, every code within m * r + s - 1 bits has been seen (m segments), so the
search ends as soon as the k-th verified distance is below that.

Codes are dealt into blocks of a bounded size, and every block of queries meets every block of codes in a task of its
own. Equal codes are indexed once, with their k smallest ids; equal queries are asked once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: Codes of an index block and queries of a query block.
BLOCK_CODES, BLOCK_QUERIES = 16_384, 1_024

_POP = np.array([bin(v).count("1") for v in range(256)], np.uint8)
#: The byte masks with so many bits.
_MASKS = [np.flatnonzero(_POP == r).astype(np.uint8) for r in range(9)]


class MultiIndex:
    """The tables of one block of distinct codes (rows of bytes) and the sorted ids of each code."""

    def __init__(self, codes: np.ndarray, ids: list[np.ndarray]):
        self.codes, self.ids = codes, ids
        self.counts = np.array([len(i) for i in ids])
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, s], np.arange(257)) for s, o in enumerate(self.order)]

    def top(self, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k smallest (distance, id) of the block, exactly."""
        n, m = self.codes.shape
        seen = np.zeros(n, bool)
        found, distances = [], []
        for radius in range(9):
            for s in range(m):
                values = query[s] ^ _MASKS[radius]
                order, starts = self.order[s], self.starts[s]
                got = np.concatenate([order[starts[v] : starts[v + 1]] for v in values.tolist()])
                got = got[~seen[got]]
                if len(got):
                    seen[got] = True
                    found.append(got)
                    distances.append(_POP[self.codes[got] ^ query].sum(1, dtype=np.int64))
                if found and (best := self._best(found, distances, k)) and best[0] <= m * radius + s:
                    return best[1]
        return self._best(found, distances, 0)[1][:k] if found else []

    def _best(self, found: list, distances: list, k: int) -> tuple[int, list[tuple[int, int]]] | None:
        """The k-th distance and the k smallest pairs, if there are k yet; with k = 0 all pairs."""
        rows, far = np.concatenate(found), np.concatenate(distances)
        if self.counts[rows].sum() < k:
            return None
        order = np.argsort(far, kind="stable")
        if k:
            kth = far[order[np.searchsorted(np.cumsum(self.counts[rows[order]]), k)]]
            order = order[far[order] <= kth]
        pairs = sorted((int(far[i]), int(x)) for i in order for x in self.ids[rows[i]])
        return (pairs[k - 1][0], pairs[:k]) if k else (0, pairs)


def _codes(vectors: DataFrame, width: int, k: int) -> DataFrame:
    """id and code of the vectors; of equal codes in a batch only the k smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids)), np.diff(offsets))
            bits = np.zeros((len(ids), width * 8), bool)
            bits[row, np.arange(offsets[0], offsets[-1]) - offsets[:-1][row]] = values[offsets[0] : offsets[-1]] > 0
            frame = pd.DataFrame({"id": ids, "code": [c.tobytes() for c in np.packbits(bits, axis=1)]})
            frame = frame.sort_values("id").groupby("code", sort=False).head(k)
            yield pa.RecordBatch.from_arrays([pa.array(frame["id"], pa.int64()), pa.array(frame["code"], pa.binary())], ["id", "code"])

    return vectors.mapInArrow(run, "id bigint, code binary")


def _blocks(codes: DataFrame, size: int, schema: str) -> tuple[DataFrame, int]:
    n = max(1, -(-codes.count() // size))
    pack = lambda key, part: pd.DataFrame({"block": [key[0]], "codes": [b"".join(part["code"])], "ids": [[np.asarray(i) for i in part["ids"]] if "ids" in part else []]})
    return codes.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")).groupBy("block").applyInPandas(pack, schema), n


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and distance: the k nearest rows of vectors (vec_id, embedding) for each query row.

    Distances are Hamming distances of the codes; ties go to the smaller vec_id. A query is itself a row and may find
    itself. Rows without vec_id or embedding are left out, null, NaN and missing values of an embedding set no bit.
    Fewer than k rows give fewer ranks; repeated rows are found, and asked, once for each. An empty table gives no rows.
    """
    vectors = vectors.select(F.col("vec_id").alias("id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    vectors = vectors.withColumn("embedding", F.transform("embedding", lambda x: F.when(F.isnan(x), 0).otherwise(F.coalesce(x.cast("float"), F.lit(0.0).cast("float")))))
    shared_dir(vectors.sparkSession)  # checkpoints need it
    width = -(-(vectors.agg(F.max(F.size("embedding"))).first()[0] or 0) // 8) or 1
    w = Window.partitionBy("code").orderBy("id")
    classes = _codes(vectors, width, k).withColumn("at", F.row_number().over(w)).where(F.col("at") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asking = _codes(vectors.where(F.expr("id IS NOT NULL") & is_query), width, 1 << 62)
    index, n_index = _blocks(classes.checkpoint(), BLOCK_CODES, "block int, codes binary, ids array<array<bigint>>")
    asked, n_asked = _blocks(asking.select("code").distinct().checkpoint(), BLOCK_QUERIES, "block int, codes binary, ids array<array<bigint>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, ids, queries in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                table = MultiIndex(np.frombuffer(codes.as_buffer(), np.uint8).reshape(-1, width), [np.array(i) for i in ids.as_py()])
                rows = [(q.tobytes(), d, i) for q in np.frombuffer(queries.as_buffer(), np.uint8).reshape(-1, width) for d, i in table.top(q, k)]
                cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["code", "distance", "vec_id"])

    # every block of codes meets every block of queries; the blocks, not their rows, are joined
    pairs = index.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))).join(asked.select(F.col("block").alias("asked"), F.col("codes").alias("queries")), "asked")
    local = pairs.repartition(n_index * n_asked, "asked", "block").select("codes", "ids", "queries").mapInArrow(run, "code binary, distance bigint, vec_id bigint")
    best = local.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("distance", "vec_id")).cast("int")).where(F.col("rank") <= k)
    return asking.select(F.col("id").alias("query_id"), "code").join(best, "code").select("query_id", "rank", "vec_id", "distance")
