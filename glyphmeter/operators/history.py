"""Time series of engine scores: regressions, trends, change points, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import medians
from .ranks import running


def latest_regression(runs: DataFrame, threshold: float = 0.01) -> DataFrame:
    """engine, previous, latest, delta and whether the latest run is worse by more than threshold; one row an engine.

    The two latest runs come from a partial top-2, not from a window over the whole history.
    """
    run = F.struct(F.col("ts"), F.col("run_id"), F.col("cer"))
    last = runs.where("cer IS NOT NULL").groupBy("engine").agg(F.max(run).alias("last"))
    rest = runs.where("cer IS NOT NULL").join(F.broadcast(last), "engine").where(F.struct("ts", "run_id") < F.struct("last.ts", "last.run_id")).groupBy("engine").agg(F.max(run).alias("before"))
    delta = F.col("last.cer") - F.col("before.cer")
    return last.join(rest, "engine").select("engine", F.col("before.cer").alias("previous"), F.col("last.cer").alias("latest"), delta.alias("delta"), (delta > threshold).alias("is_regression"))


def linear_trend(runs: DataFrame) -> DataFrame:
    """Least-squares slope per day, intercept and R2 of each engine; R2 is 1 where the score never changes."""
    day = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / F.lit(86_400_000_000.0)
    r = runs.where("cer IS NOT NULL").select("engine", day.alias("x"), F.col("cer").alias("y")).groupBy("engine").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    slope = F.try_divide(F.col("xy"), F.col("xx"))
    return r.select("engine", "runs", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.when(F.col("yy") == 0, 1.0).otherwise(F.try_divide(F.col("xy") * F.col("xy"), F.col("xx") * F.col("yy"))).alias("r2"))


def change_point(runs: DataFrame, least_segment: int = 3) -> DataFrame:
    """The split of each engine's series with the largest change of mean; the first of equal ones."""
    s = running(runs.where("cer IS NOT NULL").select("engine", "ts", "run_id", "cer"), "engine", "cer", "ts", "run_id").withColumn("left", F.col("total") - F.col("cer"))
    before, after = F.col("left") / (F.col("k") - 1), (F.col("whole") - F.col("left")) / (F.col("n") - F.col("k") + 1)
    cut = s.where((F.col("k") > least_segment) & (F.col("n") - F.col("k") + 1 >= least_segment)).select("engine", "k", before.alias("before"), after.alias("after"))
    best = F.max(F.struct(F.abs(F.col("after") - F.col("before")).alias("size"), (-F.col("k")).alias("k"), "before", "after")).alias("b")
    return cut.groupBy("engine").agg(best).select("engine", (-F.col("b.k") - 1).cast("bigint").alias("runs_before"), F.col("b.before").alias("mean_before"), F.col("b.after").alias("mean_after"))


def baseline(runs: DataFrame, least_runs: int = 5, relative: float = 0.2) -> DataFrame:
    """The latest run of each engine against the mean and median of all earlier ones."""
    last = runs.where("cer IS NOT NULL").groupBy("engine").agg(F.max(F.struct("ts", "run_id", "cer")).alias("last"))
    earlier = runs.join(last, "engine").where(F.struct("ts", "run_id") < F.struct("last.ts", "last.run_id"))
    past = earlier.groupBy("engine").agg(F.avg("cer").alias("mean_cer"), F.count("cer").alias("runs"), F.max("last.cer").alias("latest")).where(F.col("runs") >= least_runs)
    past = past.join(medians(earlier, "cer", "engine").withColumnRenamed("median", "median_cer"), "engine")
    change = F.try_divide(F.col("latest") - F.col("mean_cer"), F.col("mean_cer"))
    return past.select("engine", "runs", "mean_cer", "median_cer", "latest", change.alias("relative_delta"), (F.abs(change) > relative).alias("off_baseline"))


def longitudinal(runs: DataFrame, least_runs: int = 3, least_change: float = 0.01) -> DataFrame:
    """engine, runs, first_cer, last_cer and delta of engines with enough runs whose score has moved."""
    at = F.struct("ts", "run_id")
    ends = runs.where("cer IS NOT NULL").groupBy("engine").agg(F.count(F.lit(1)).alias("runs"), F.min_by("cer", at).alias("first_cer"), F.max_by("cer", at).alias("last_cer"))
    return ends.withColumn("delta", F.col("last_cer") - F.col("first_cer")).where((F.col("runs") >= least_runs) & (F.abs("delta") >= least_change))


def latest_percentile(runs: DataFrame) -> DataFrame:
    """engine, latest score and the share of all scores, its own included, that are not above it."""
    scored = runs.where("cer IS NOT NULL")
    last = scored.groupBy("engine").agg(F.max_by("cer", F.struct("ts", "run_id")).alias("latest"))
    return scored.join(last, "engine").groupBy("engine", "latest").agg((F.count_if(F.col("cer") <= F.col("latest")) / F.count(F.lit(1))).alias("share"))
