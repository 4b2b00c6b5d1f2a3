"""Queries on normalised texts, images, repeated runs and robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import normalise as N
from ..functions.distance import edit_distance
from ..operators import errors, report
from ..sources import derived
from ..sources.derived import METRICS_SQL
from . import errors as error_queries
from . import statistics
from .registry import register

_KNOWN = [p for p in N.PROFILES if p != "caseless"]


def _sql_text(profile: str) -> str:
    text = "nfc_normalize(coalesce(text, ''))"
    if profile in N.EXCLUDED:
        return f"""translate({text}, '{N.EXCLUDED[profile].replace("'", "''")}', '')"""
    if profile in N.TABLES:
        cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.TABLES[profile].items())
        pieces = "(?s)vv|." if "vv" in N.TABLES[profile] else "(?s)."
        return f"array_to_string(list_transform(regexp_extract_all({text}, '{pieces}'), lambda c: CASE c {cases} ELSE c END), '')"
    return text


@register(" UNION ALL ".join(f"SELECT doc_id, '{p}' AS profile, md5({_sql_text(p)}) AS text_md5 FROM documents" for p in _KNOWN))
def profiled_texts(spark, sf_dir):
    """Every text under every profile but the caseless one, whose folding DuckDB has not."""
    docs = derived.spread(derived.load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    made = F.array(*[F.struct(F.lit(p).alias("profile"), F.md5(N.profiled(F.col("text"), p)).alias("text_md5")) for p in _KNOWN])
    return docs.select("doc_id", F.inline(made))


_CHOSEN = ("u_eq_v", "vv_eq_w", "i_eq_j", "oe_ligature")


def _equivalent_sql() -> str:
    text = "coalesce(text, '')"
    for name, (sign, written) in N.EQUIVALENCES.items():
        if name in _CHOSEN:
            text = f"replace({text}, '{sign}', '{written}')"
    return text


@register(f"SELECT doc_id, md5({_equivalent_sql()}) AS text_md5 FROM documents")
def equivalent_texts(spark, sf_dir):
    """Every text under four chosen equivalences, one after another."""
    return derived.load(spark, sf_dir, "documents").select("doc_id", F.md5(N.equivalent(F.coalesce("text", F.lit("")), *_CHOSEN)).alias("text_md5"))


@register()
def profiled_error_rates(spark, sf_dir):
    """Error rates of an engine without diacritics and one that drops a letter, under every profile."""
    rows = derived.split_lines(derived.varied(spark, sf_dir).where("engine IN ('plain_letters', 'lower_case')")).select("engine", "gt_line", "hyp_line")
    made = F.array(*[F.struct(F.lit(p).alias("profile"), N.profiled(F.col("gt_line"), p).alias("g"), N.profiled(F.col("hyp_line"), p).alias("h")) for p in N.PROFILES])
    each = rows.select("engine", F.inline(made)).withColumn("errors", edit_distance(F.col("g"), F.col("h")))
    return each.groupBy("engine", "profile").agg(F.sum("errors").alias("errors"), F.sum(F.length("g")).cast("bigint").alias("ref_chars")).withColumn("cer", F.try_divide("errors", "ref_chars"))


def _images(spark, sf_dir):
    """The bytes of every text of 640 bytes or more as an image of 32 columns."""
    docs = derived.spread(derived.load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("corpus"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))).where(F.octet_length("b") >= 640)
    height = F.floor(F.octet_length("b") / 32).cast("int")
    return docs.select("doc_id", "corpus", height.alias("height"), F.lit(32).alias("width"), F.substring(F.col("b"), F.lit(1), height * 32).alias("pixels"))


def _scored(spark, sf_dir):
    rows = _images(spark, sf_dir).withColumn("s", I.image_scores("height", "width", "pixels"))
    return rows.withColumns({"quality": I.quality(F.col("s")), "complexity": I.complexity(F.col("s"))}).withColumn("tier", I.tier(F.col("quality")))


@register()
def image_quality_documents(spark, sf_dir):
    """Sharpness, noise, rotation, contrast, quality, tier and complexity of every image (here the bytes of the texts)."""
    return _scored(spark, sf_dir).select("doc_id", "s.*", "quality", "tier", "complexity")


@register()
def image_quality_report(spark, sf_dir):
    """Means by corpus, images by tier, and how alike the images of a corpus are: 1 less the mean deviation of the four scores."""
    scale = {"sharpness": 1.0, "noise": 1.0, "rotation": 10.0, "contrast": 1.0}
    apart = [F.least(F.lit(1.0), F.coalesce(F.stddev_samp(f"s.{c}"), F.lit(0.0)) / v) for c, v in scale.items()]
    return _scored(spark, sf_dir).groupBy("corpus").agg(
        F.count(F.lit(1)).alias("images"), *[F.avg(f"s.{c}").alias(c) for c in I.SCORES], F.avg("quality").alias("quality"), *[F.count_if(F.col("tier") == t).alias(t) for t in ("good", "medium", "poor")], (1 - sum(apart) / 4).alias("homogeneity")
    )


@register()
def image_robustness(spark, sf_dir):
    """Quality of the images as they are and after each degradation, and the degradation that costs most."""
    images = _images(spark, sf_dir)
    levels = {"noise": 20.0, "blur": 1.0, "rotation": 3.0, "resolution": 0.5, "binarisation": 1.0}
    out = None
    for kind, level in {"none": 0.0, **levels}.items():
        pixels = F.col("pixels") if kind == "none" else I.degraded_pixels(kind, level)("height", "width", "pixels")
        rows = images.select("height", "width", pixels.alias("pixels")).select(I.quality(I.image_scores("height", "width", "pixels")).alias("q"))
        row = rows.agg(F.avg("q").alias("quality"), F.count(F.lit(1)).alias("images")).select(F.lit(kind).alias("kind"), F.lit(level).alias("level"), "quality", "images")
        out = row if out is None else out.unionByName(row)
    return out


@register(f"""WITH {METRICS_SQL} SELECT doc_id, count(*) AS runs, avg(cer) AS cer_mean, stddev_samp(cer) AS cer_stdev, CASE WHEN avg(cer) > 0 THEN stddev_samp(cer) / avg(cer) END AS cer_cv FROM m WHERE cer IS NOT NULL GROUP BY doc_id""")
def run_spread(spark, sf_dir):
    """Mean, deviation and relative deviation of the error rates of a document's runs (here the engines)."""
    rows = derived.doc_metrics(spark, sf_dir).where("cer IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), F.avg("cer").alias("cer_mean"), F.stddev_samp("cer").alias("cer_stdev"))
    return rows.withColumn("cer_cv", F.when(F.col("cer_mean") > 0, F.col("cer_stdev") / F.col("cer_mean")))


@register(f"""WITH c AS (SELECT col0 AS engine, CAST(col1 AS DOUBLE) AS level, CAST(col2 AS DOUBLE) AS cer FROM (VALUES {statistics._CURVES}))
SELECT engine, avg(cer) AS mean_cer, min(level) FILTER (cer > 0.08) AS critical_level, CAST(row_number() OVER (ORDER BY avg(cer), engine) AS INTEGER) AS position FROM c GROUP BY engine""")
def robustness_summary(spark, sf_dir):
    """Mean error rate over all levels of a degradation, the first level above eight percent, and the order of the engines."""
    curves = spark.sql(f"SELECT engine, CAST(lo AS DOUBLE) AS level, CAST(c0 AS DOUBLE) AS cer FROM VALUES {statistics._CURVES} AS c(engine, lo, c0)")
    return report.robustness(curves, 0.08)


@register()
def taxonomy_comparison(spark, sf_dir):
    """Two engines' errors by class and by how far they can be undone, with the change from one to the other."""
    counts = errors.taxonomy(error_queries._lines(spark, sf_dir), "engine")
    return errors.comparison(counts, "plain_letters", "lower_case")


@register()
def scatter_points(spark, sf_dir):
    """What two plots show of each engine: inequality of lines by error rate, and ratio of lengths by anchor."""
    from .reports import line_gini_percentiles

    m = derived.doc_metrics(spark, sf_dir).groupBy("engine").agg(report.micro_cer().alias("micro_cer"))
    gini = line_gini_percentiles(spark, sf_dir).select("engine", "gini")
    return m.join(gini, "engine").join(error_queries.hallucination_report(spark, sf_dir).select("engine", "length_ratio", "anchor"), "engine")
