"""Queries over document metrics: aggregates, rankings, top lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import report
from ..operators.quantiles import beside
from ..sources import derived
from ..sources.derived import LINES_SQL, METRICS_SQL
from .registry import register

_AGG = """
  CAST(sum(errors) AS DOUBLE) / sum(ref_chars) AS micro_cer, avg(cer) AS mean_cer, quantile_cont(cer, 0.5) AS median_cer, min(cer) AS min_cer, max(cer) AS max_cer,
  coalesce(stddev_samp(cer), CASE WHEN count(cer) > 0 THEN 0.0 END) AS stdev_cer, count(*) AS documents, count(*) FILTER (cer IS NULL) AS without_cer"""

_COLUMNS = [*derived.ENGINES, "ref_chars"]


@register(f"""WITH {METRICS_SQL}, a AS (SELECT engine, {_AGG} FROM m GROUP BY engine)
SELECT engine, micro_cer, documents, CAST(row_number() OVER (ORDER BY micro_cer NULLS LAST, engine) AS INTEGER) AS position FROM a""")
def ranking_micro_cer(spark, sf_dir):
    """Engines by micro-averaged character error rate."""
    return report.ranked(report.aggregate(derived.doc_metrics(spark, sf_dir), "engine", median=False)).select("engine", "micro_cer", "documents", "position")


@register(f"WITH {METRICS_SQL} SELECT engine, {_AGG} FROM m GROUP BY engine")
def engine_aggregate_stats(spark, sf_dir):
    return report.aggregate(derived.doc_metrics(spark, sf_dir), "engine")


@register(f"""WITH {METRICS_SQL}, a AS (SELECT stratum, engine, {_AGG} FROM m GROUP BY stratum, engine)
SELECT stratum, engine, micro_cer, mean_cer, documents, CAST(row_number() OVER (PARTITION BY stratum ORDER BY micro_cer NULLS LAST, engine) AS INTEGER) AS position FROM a""")
def stratified_ranking(spark, sf_dir):
    return report.ranked(report.aggregate(derived.doc_metrics(spark, sf_dir), "stratum", "engine", median=False), "stratum").select("stratum", "engine", "micro_cer", "mean_cer", "documents", "position")


@register(f"""WITH {METRICS_SQL}, a AS (SELECT engine, stratum, CAST(sum(errors) AS DOUBLE) / sum(ref_chars) AS r FROM m GROUP BY GROUPING SETS ((engine), (engine, stratum))),
l AS (SELECT engine FROM a WHERE stratum IS NULL ORDER BY r, engine LIMIT 1)
SELECT engine AS leader, count(*) AS strata, arg_min(stratum, r) AS best_stratum, arg_max(stratum, r) AS worst_stratum, max(r) - min(r) AS gap
FROM a JOIN l USING (engine) WHERE stratum IS NOT NULL GROUP BY engine""")
def corpus_homogeneity(spark, sf_dir):
    return report.homogeneity(derived.doc_metrics(spark, sf_dir))


@register(f"WITH {METRICS_SQL} SELECT engine, doc_id, errors, cer FROM m ORDER BY cer DESC NULLS LAST, engine, doc_id LIMIT 20")
def worst_docs_topk(spark, sf_dir):
    """A report of the twenty worst documents."""
    return derived.doc_metrics(spark, sf_dir).select("engine", "doc_id", "errors", "cer").orderBy(F.col("cer").desc_nulls_last(), "engine", "doc_id").limit(20)


@register(f"""WITH {METRICS_SQL}, w AS (SELECT engine, doc_id, line, gt_line, hyp_line, least(1.0, errors / length(gt_line)) AS line_cer FROM lines WHERE length(gt_line) > 0 AND errors > 0)
SELECT engine, doc_id, CAST(line AS INTEGER) AS line, gt_line, hyp_line, line_cer FROM w ORDER BY line_cer DESC, engine, doc_id, line LIMIT 25""")
def worst_lines_topk(spark, sf_dir):
    """A report of the 25 worst lines."""
    worst = derived.line_metrics(spark, sf_dir).where("ref_chars > 0 AND errors > 0").withColumn("line_cer", F.least(F.lit(1.0), F.col("errors") / F.col("ref_chars")))
    worst = worst.select("engine", "doc_id", "line", "texts", "line_cer").orderBy(F.desc("line_cer"), "engine", "doc_id", "line").limit(25)
    # the texts of 25 lines, from the documents they are in
    pairs = beside(derived.outputs(spark, sf_dir), F.broadcast(worst.select("engine", "doc_id").distinct()), "engine", "doc_id", how="left_semi")
    texts = derived.split_lines(pairs).withColumn("texts", F.xxhash64("gt_line", "hyp_line")).select("engine", "doc_id", "line", "texts", "gt_line", "hyp_line").distinct()
    return beside(texts, F.broadcast(worst), "engine", "doc_id", "line", "texts").drop("texts")


@register(f"""WITH {METRICS_SQL},
k AS (SELECT engine, row_number() OVER (PARTITION BY engine ORDER BY cer, doc_id) AS k, avg(cer) OVER (PARTITION BY engine ORDER BY cer, doc_id ROWS UNBOUNDED PRECEDING) AS mean_cer, count(*) OVER (PARTITION BY engine) AS n FROM m WHERE cer IS NOT NULL),
s AS (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS step)
SELECT engine, step, k AS documents, mean_cer FROM k, s WHERE k = greatest(1, step * n // 20)""")
def reliability_curve(spark, sf_dir):
    return report.reliability_curve(derived.doc_metrics(spark, sf_dir))


@register(f"""WITH {METRICS_SQL}, w AS (SELECT doc_id, {', '.join(f"max(cer) FILTER (WHERE engine = '{e}') AS {e}" for e in derived.ENGINES)}, max(ref_chars) AS ref_chars FROM m GROUP BY doc_id),
u AS ({' UNION ALL '.join(f"SELECT '{x}' AS x, '{y}' AS y, CASE WHEN (stddev_pop({x}) FILTER (WHERE {y} IS NOT NULL)) = 0 OR (stddev_pop({y}) FILTER (WHERE {x} IS NOT NULL)) = 0 THEN 0.0 ELSE corr({x}, {y}) END AS r FROM w" for i, x in enumerate(_COLUMNS) for y in _COLUMNS[i:])})
SELECT * FROM u""")
def correlation_matrix(spark, sf_dir):
    wide = derived.doc_metrics(spark, sf_dir).groupBy("doc_id").agg(*[F.max(F.when(F.col("engine") == e, F.col("cer"))).alias(e) for e in derived.ENGINES], F.max("ref_chars").alias("ref_chars"))
    return report.correlation(wide, *derived.ENGINES, "ref_chars")


@register(f"""WITH {METRICS_SQL}, b AS (SELECT doc_id, avg(cer) AS mean_cer, arg_min(engine, struct_pack(c := cer, e := engine)) AS best_engine, max(cer) - min(cer) AS spread FROM m WHERE cer IS NOT NULL GROUP BY doc_id)
SELECT doc_id, mean_cer, best_engine, spread FROM b""")
def document_best_engine(spark, sf_dir):
    return derived.doc_metrics(spark, sf_dir).where("cer IS NOT NULL").groupBy("doc_id").agg(F.avg("cer").alias("mean_cer"), F.min_by("engine", F.struct("cer", "engine")).alias("best_engine"), (F.max("cer") - F.min("cer")).alias("spread"))


@register(f"""WITH {METRICS_SQL} SELECT coalesce(stratum, '*') AS stratum, coalesce(engine, '*') AS engine, CAST(sum(errors) AS DOUBLE) / sum(ref_chars) AS micro_cer, count(*) AS documents FROM m GROUP BY ROLLUP (stratum, engine)""")
def stratum_rollup(spark, sf_dir):
    """Strata, engines and totals in one pass."""
    rolled = derived.doc_metrics(spark, sf_dir).rollup("stratum", "engine").agg(report.micro_cer().alias("micro_cer"), F.count(F.lit(1)).alias("documents"))
    return rolled.select(F.coalesce("stratum", F.lit("*")).alias("stratum"), F.coalesce("engine", F.lit("*")).alias("engine"), "micro_cer", "documents")


@register(f"""WITH {LINES_SQL}, c AS (SELECT engine, doc_id, line, least(1.0, errors / length(gt_line)) AS x FROM lines WHERE length(gt_line) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY engine, doc_id ORDER BY x, line) AS k FROM c),
d AS (SELECT engine, doc_id, count(*) AS n, avg(x) AS mean_line_cer, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.99) AS p99, avg(CAST(x > 0.3 AS INTEGER)) AS over_30,
      CASE WHEN sum(x) > 0 THEN 2 * sum(k * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) ELSE 0.0 END AS gini FROM r GROUP BY engine, doc_id)
SELECT engine, avg(mean_line_cer) AS mean_line_cer, avg(p50) AS p50, avg(p90) AS p90, avg(p99) AS p99, avg(over_30) AS over_30, avg(gini) AS gini, stddev_samp(gini) AS gini_stdev, CAST(sum(n) AS BIGINT) AS lines FROM d GROUP BY engine""")
def line_gini_percentiles(spark, sf_dir):
    """Distribution of line error rates within documents, averaged over each engine's documents."""
    x = derived.line_metrics(spark, sf_dir).where("ref_chars > 0").select("engine", "doc_id", "line", F.least(F.lit(1.0), F.col("errors") / F.col("ref_chars")).alias("x"))
    rows = x.withColumn("k", F.row_number().over(Window.partitionBy("engine", "doc_id").orderBy("x", "line")))
    n = F.count(F.lit(1))
    gini = F.when(F.sum("x") > 0, 2 * F.sum(F.col("k") * F.col("x")) / (n * F.sum("x")) - (n + 1) / n).otherwise(0.0)
    docs = rows.groupBy("engine", "doc_id").agg(n.alias("n"), F.avg("x").alias("m"), *[F.percentile("x", p).alias(a) for p, a in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))], F.avg((F.col("x") > 0.3).cast("int")).alias("over_30"), gini.alias("gini"))
    return docs.groupBy("engine").agg(F.avg("m").alias("mean_line_cer"), *[F.avg(c).alias(c) for c in ("p50", "p90", "p99", "over_30", "gini")], F.stddev_samp("gini").alias("gini_stdev"), F.sum("n").alias("lines"))


@register("""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, lang, source FROM documents)
SELECT source AS corpus, count(*) AS documents, avg(n) AS mean_chars, quantile_cont(n, 0.5) AS median_chars, CAST(min(n) AS INTEGER) AS min_chars, CAST(max(n) AS INTEGER) AS max_chars, count(DISTINCT lang) AS languages, avg(CAST(lang IS NOT NULL AS INTEGER)) AS language_coverage FROM d GROUP BY source""")
def corpus_stats(spark, sf_dir):
    d = derived.load(spark, sf_dir, "documents").select(F.length(F.coalesce("text", F.lit(""))).alias("n"), "lang", F.col("source").alias("corpus"))
    return d.groupBy("corpus").agg(F.count(F.lit(1)).alias("documents"), F.avg("n").alias("mean_chars"), F.percentile("n", 0.5).alias("median_chars"), F.min("n").alias("min_chars"), F.max("n").alias("max_chars"), F.countDistinct("lang").alias("languages"), F.avg(F.col("lang").isNotNull().cast("int")).alias("language_coverage"))


@register("""SELECT CASE WHEN l.doc_id IS NULL THEN 'documents only' WHEN d.doc_id IS NULL THEN 'labels only' ELSE 'both' END AS side, count(*) AS rows, count(l.quality) AS quality, count(l.toxic) AS toxic FROM documents d FULL JOIN labels l USING (doc_id) GROUP BY 1""")
def gt_coverage(spark, sf_dir):
    """Which documents have which ground truth, and orphans on either side."""
    d, g = derived.load(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("d")), derived.load(spark, sf_dir, "labels").withColumn("l", F.lit(1))
    side = F.when(F.col("l").isNull(), "documents only").when(F.col("d").isNull(), "labels only").otherwise("both")
    return d.join(g, "doc_id", "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("rows"), F.count("quality").alias("quality"), F.count("toxic").alias("toxic"))
