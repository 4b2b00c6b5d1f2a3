"""Resampled intervals and the facts that compare strata."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(rows: DataFrame, key: str, unit: str, value: str, resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """key, mean, low, high, units: the mean of value and its percentile interval over Poisson resamples of the units.

    A unit's weights come from a hash of the unit and the seed, so the result does not depend on partitions and engines
    are resampled alike. Tasks add weighted sums of their rows; a row is never copied. Null values count in no resample.
    """
    hashed = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.lit(seed), unit).alias("unit"), F.col(value).cast("double").alias("value"))

    # chances that a Poisson variable of mean 1 is at most 0, 1, 2, ...
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])
    salts = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def weights(units: np.ndarray) -> np.ndarray:
        """A row of weights for each unit, from a hash of the unit and the resample."""
        x = units[:, None] ^ salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.searchsorted(steps, (x ^ (x >> np.uint64(31))) / 2.0**64, "right").astype(np.float64)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                drawn = weights(part["unit"].to_numpy().astype(np.uint64))
                for name, rows in part.groupby("key", sort=False).indices.items():
                    x = part["value"].to_numpy()[rows]
                    sums[name] = sums.get(name, 0) + np.stack([x @ drawn[rows], drawn[rows].sum(0)])
        for name, (total, weight) in sums.items():
            yield pd.DataFrame({"key": name, "k": np.arange(resamples), "total": total, "weight": weight})

    added = hashed.mapInPandas(add, f"key {rows.schema[key].dataType.simpleString()}, k int, total double, weight double")
    means = added.groupBy("key", "k").agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("m"))
    tail = (1 - level) / 2
    found = means.groupBy("key").agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    return hashed.groupBy("key").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("units")).join(found, "key").withColumnRenamed("key", key)


#: Units of a leaf of the tree of draws, about, and resamples that are drawn in it at once.
LEAF_UNITS, DRAWN_AT_ONCE = 4_096, 128


def resampled_sums(rows: DataFrame, key: str, unit: str, value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """key, k, total and drawn: of each resample (k) of a key's units with replacement the sum of value and the number drawn, which is that of the units.

    Units are dealt to leaves by a hash. The draws of a resample are split between the two halves of the hashes by their
    sizes, binomially, and so on down to the leaves, where single units are drawn. A split's chance depends on its place
    in the tree alone, so the result is the same in any partitions; keys with the same units are resampled alike. A leaf
    holds the rows of its units, however often one is repeated. Null values are left out.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.lit(seed), unit).alias("unit"), F.col(value).cast("double").alias("value"))
    most = known.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, most / LEAF_UNITS))))
    leaf = F.shiftrightunsigned("unit", 64 - depth) if depth else F.lit(0).cast("bigint")
    known = known.withColumn("leaf", leaf)
    sizes = known.groupBy("key", "leaf").agg(F.count(F.lit(1)).alias("n"))
    steps = sizes.withColumn("level", F.explode(F.expr(f"sequence(0, {depth})")))
    # the node at level l is the first l bits; a step leads from it to one of its sides; the last is the leaf itself
    steps = steps.withColumns({"node": F.expr(f"CASE WHEN level = 0 THEN 0L ELSE shiftright(leaf, {depth} - level) END"), "side": F.expr(f"CASE WHEN level < {depth} THEN shiftright(leaf, {depth} - level - 1) & 1 ELSE 0 END")})
    splits = steps.groupBy("key", "level", "node").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("left"))
    paths = steps.drop("n").join(splits, ["key", "level", "node"]).groupBy(F.col("key").alias("of"), F.col("leaf").alias("at")).agg(F.sort_array(F.collect_list(F.struct("level", "node", "side", "all", "left"))).alias("path"))

    def draw(units: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["unit", "value"])
        x, steps = units["value"].to_numpy(), list(path["path"].iloc[0])
        chance = lambda step: np.random.Generator(np.random.Philox(key=[seed, step["level"] << 57 | step["node"]]))
        drawn = np.full(resamples, steps[0]["all"])
        for step in steps[:-1]:
            left = chance(step).binomial(drawn, step["left"] / step["all"])
            drawn = drawn - left if step["side"] else left
        own, total = chance(steps[-1]), np.empty(resamples)
        for at in range(0, resamples, DRAWN_AT_ONCE):
            total[at : at + DRAWN_AT_ONCE] = own.multinomial(drawn[at : at + DRAWN_AT_ONCE], np.full(len(x), 1 / len(x))) @ x
        return pd.DataFrame({"key": units["key"].iloc[0], "k": np.arange(resamples), "total": total, "drawn": drawn})

    kind = rows.schema[key].dataType.simpleString()
    leaves = known.groupBy("key", "leaf").cogroup(paths.groupBy("of", "at")).applyInPandas(draw, f"key {kind}, k int, total double, drawn bigint")
    return leaves.groupBy("key", "k").agg(F.sum("total").alias("total"), F.sum("drawn").alias("drawn")).withColumnRenamed("key", key)


def multinomial_intervals(rows: DataFrame, key: str, unit: str, value: str, resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """key, units, mean, low, high: the mean of value and its percentile interval over resampled_sums."""
    tail = (1 - level) / 2
    means = resampled_sums(rows, key, unit, value, resamples, seed).select(key, (F.col("total") / F.col("drawn")).alias("m"))
    found = means.groupBy(key).agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("units"), F.avg(value).alias("mean")).join(found, key)


def stratum_facts(metrics: DataFrame, least_documents: int = 3, margin: float = 0.75, factor: float = 2.0, gap: float = 0.05) -> DataFrame:
    """fact, stratum, engine, value: winners by a margin over the second, and collapses against an engine's whole."""
    micro = (F.sum("errors") / F.sum("ref_chars")).alias
    whole = metrics.groupBy("engine").agg(micro("whole"))
    local = metrics.where("stratum IS NOT NULL").groupBy("stratum", "engine").agg(F.count(F.lit(1)).alias("documents"), micro("local"))
    w = Window.partitionBy("stratum").orderBy(F.col("local").asc_nulls_last(), "engine")
    ranked = local.join(whole, "engine").withColumns({"k": F.row_number().over(w), "next": F.lead("local").over(w)})
    won = (F.col("k") == 1) & (F.col("documents") >= least_documents) & (F.col("local") < margin * F.col("next"))
    fell = (F.col("local") > factor * F.col("whole")) & (F.col("local") - F.col("whole") > gap)
    facts = F.array_compact(F.array(F.when(won, "stratum_winner"), F.when(fell, "stratum_collapse")))
    return ranked.select(F.explode(facts).alias("fact"), "stratum", "engine", F.col("local").alias("value"))
