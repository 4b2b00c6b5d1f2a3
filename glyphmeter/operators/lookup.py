"""Names looked up in a dimension: the key that a name is, else the longest key that it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_key(names: DataFrame, name: str, keys: DataFrame, key: str) -> DataFrame:
    """Every different name with its key, null without one; of keys of one length the first by its bytes.

    The runs of a name that are as long as some key meet the keys in an equi-join, so a name costs its length for each
    length that keys have, however many keys there are. Null names and null or empty keys are left out.
    """
    keys = keys.select(F.col(key).alias("_key")).where("_key IS NOT NULL AND _key <> ''").distinct()
    lengths = sorted(r[0] for r in keys.select(F.length("_key")).distinct().collect())  # as many as the longest key has signs
    known = names.select(name).where(F.col(name).isNotNull()).distinct()
    if not lengths:
        return known.withColumn("key", F.lit(None).cast("string"))
    runs = lambda n: F.when(F.length(name) >= n, F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda at: F.substring(F.col(name), at, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    pieces = known.select(name, F.explode(F.array_distinct(F.flatten(F.array(*[runs(n) for n in lengths])))).alias("_key"))
    best = pieces.join(keys, "_key").groupBy(name).agg(F.min(F.struct((-F.length("_key")).alias("n"), "_key")).alias("b"))
    return known.join(best, name, "left").select(name, F.col("b._key").alias("key"))
