"""Engine reports over document metrics: aggregates, rankings, strata, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import beside, medians
from .ranks import running


def micro_cer() -> Column:
    """Errors over reference characters; documents without a count stay out."""
    return F.try_divide(F.sum("errors"), F.sum("ref_chars"))


def aggregate(metrics: DataFrame, *keys: str, median: bool = True) -> DataFrame:
    """Per key: micro, mean, exact median (if asked for), min, max and sample deviation (0 for one document) of the CER, and counts."""
    rows = metrics.groupBy(*keys).agg(
        micro_cer().alias("micro_cer"), F.avg("cer").alias("mean_cer"), F.min("cer").alias("min_cer"), F.max("cer").alias("max_cer"),
        F.coalesce(F.stddev_samp("cer"), F.when(F.count("cer") > 0, 0.0)).alias("stdev_cer"), F.count(F.lit(1)).alias("documents"), F.count_if(F.col("cer").isNull()).alias("without_cer"),
    )
    if not median:
        return rows
    both = beside(rows, medians(metrics, "cer", *keys), *keys, how="left")
    return both.select(*keys, "micro_cer", "mean_cer", F.col("median").alias("median_cer"), "min_cer", "max_cer", "stdev_cer", "documents", "without_cer")


def representative(report: DataFrame) -> Column:
    """Of micro, median and mean CER the first that a report has."""
    return F.coalesce(*[c for c in ("micro_cer", "median_cer", "mean_cer") if c in report.columns])


def ranked(report: DataFrame, *within: str) -> DataFrame:
    """position from 1 by representative CER, engines without one last; ties by name."""
    w = Window.partitionBy(*within).orderBy(representative(report).asc_nulls_last(), "engine")
    return report.withColumn("position", F.row_number().over(w))


def homogeneity(metrics: DataFrame) -> DataFrame:
    """The leader's spread of representative CER over strata: leader, best and worst stratum, gap."""
    leader = ranked(aggregate(metrics, "engine")).where("position = 1").select("engine")
    strata = aggregate(metrics.join(F.broadcast(leader), "engine"), "engine", "stratum")
    strata = strata.withColumn("r", representative(strata))
    return strata.groupBy(F.col("engine").alias("leader")).agg(
        F.count(F.lit(1)).alias("strata"), F.min_by("stratum", F.struct("r", "stratum")).alias("best_stratum"),
        F.max_by("stratum", F.struct("r", "stratum")).alias("worst_stratum"), (F.max("r") - F.min("r")).alias("gap"),
    )


def reliability_curve(metrics: DataFrame, steps: int = 20) -> DataFrame:
    """Mean CER of the easiest share of documents, for each step of the share; at least one document each."""
    rows = running(metrics.where("cer IS NOT NULL").select("engine", "cer", "doc_id"), "engine", "cer", "cer", "doc_id")
    cut = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).where(F.col("k") == F.greatest(F.lit(1), F.floor(F.col("step") * F.col("n") / F.lit(steps))))
    return cut.select("engine", "step", F.col("k").cast("bigint").alias("documents"), (F.col("total") / F.col("k")).alias("mean_cer"))


def worst_share(metrics: DataFrame, share: float = 0.2) -> DataFrame:
    """engine and the part of its whole error that its worst share of documents holds, at least one document."""
    rows = running(metrics.where("cer IS NOT NULL").select("engine", "cer", "doc_id"), "engine", "cer", F.desc("cer"), "doc_id")
    worst = F.sum(F.when(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * share)), F.col("cer")))
    return rows.groupBy("engine").agg(worst.alias("w"), F.sum("cer").alias("s")).where("s > 0").select("engine", (F.col("w") / F.col("s")).alias("share_of_worst_fifth"))


def pareto_front(points: DataFrame, key: str, *minimise: str) -> DataFrame:
    """Points that no other is at least as good as in everything and better in something; a small engine table."""
    a, b = points.alias("a"), points.alias("b")
    no_worse = better = None
    for c in minimise:
        le, lt = F.col(f"b.{c}") <= F.col(f"a.{c}"), F.col(f"b.{c}") < F.col(f"a.{c}")
        no_worse, better = (le, lt) if no_worse is None else (no_worse & le, better | lt)
    return a.join(F.broadcast(b), (F.col(f"a.{key}") != F.col(f"b.{key}")) & no_worse & better, "left_anti").select(*[F.col(f"a.{c}") for c in points.columns])


def correlation(rows: DataFrame, *names: str) -> DataFrame:
    """Pearson correlation of each pair of columns over rows that have both; 0 when one is constant or under two rows."""
    aggs = []
    for i, x in enumerate(names):
        for y in names[i:]:
            both = F.col(x).isNotNull() & F.col(y).isNotNull()
            a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
            flat = (F.coalesce(F.stddev_pop(a), F.lit(0.0)) == 0) | (F.coalesce(F.stddev_pop(b), F.lit(0.0)) == 0)
            aggs.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))).alias("r")))
    return rows.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("c")).select("c.x", "c.y", "c.r")


def robustness(curves: DataFrame, critical: float) -> DataFrame:
    """engine, mean_cer over all levels (engine, level, cer), the first level above critical, and position by mean."""
    rows = curves.groupBy("engine").agg(F.avg("cer").alias("mean_cer"), F.min(F.when(F.col("cer") > critical, F.col("level"))).alias("critical_level"))
    return rows.withColumn("position", F.row_number().over(Window.orderBy("mean_cer", "engine")))
