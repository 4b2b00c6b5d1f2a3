"""Corpora in folders: images and their ground truths and outputs, joined by the names they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Image suffixes, and the suffix of each level of ground truth.
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
LEVELS = {"gt": ".gt.txt", "ocr": ".ocr.txt", "alto": ".gt.alto.xml", "page": ".gt.page.xml", "entities": ".gt.entities.json", "reading_order": ".gt.reading_order.json"}


def _stem(suffix: str) -> Column:
    name = F.regexp_replace(F.col("_metadata.file_path"), r"^.*/", "")
    return F.regexp_replace(name, f"{suffix}$", "")


def level(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """doc_id and the whole text of every file of one level."""
    files = spark.read.option("pathGlobFilter", f"*{LEVELS[name]}").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return files.select(_stem(LEVELS[name].replace(".", r"\.")).alias("doc_id"), F.col("value").alias(name))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, image and one column a level; images without a ground truth are left out.

    Only the paths of images are read, never their bytes. Names must be unique within the folder.
    """
    paths = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(IMAGES)}}}").option("recursiveFileLookup", "true").load(folder)
    out = paths.select(F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]+$", "").alias("doc_id"), F.col("path").alias("image"))
    for name in LEVELS:
        out = out.join(level(spark, folder, name), "doc_id", "inner" if name == "gt" else "left")
    return out


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and side (image or gt) of images without a ground truth and the reverse."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(IMAGES)}}}").option("recursiveFileLookup", "true").load(folder)
    images = paths.select(F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]+$", "").alias("doc_id"), F.lit(1).alias("i"))
    texts = level(spark, folder, "gt").select("doc_id", F.lit(1).alias("g"))
    return images.join(texts, "doc_id", "full_outer").where("i IS NULL OR g IS NULL").select("doc_id", F.when(F.col("i").isNull(), "gt").otherwise("image").alias("side"))


def write_long(rows: DataFrame, path: str) -> None:
    """Metric rows (run, doc_id, pipeline, view, metric, value, status) as CSV, values to six places."""
    rows.withColumn("value", F.round("value", 6)).write.mode("errorifexists").option("header", "true").csv(path)


def append_history(runs: DataFrame, path: str) -> None:
    """Run summaries are only ever added; the latest row of a (run_id, engine) counts, see latest_history."""
    runs.withColumn("recorded", F.current_timestamp()).write.mode("append").parquet(path)


def latest_history(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in ("run_id", "engine", "recorded")]
    return rows.groupBy("run_id", "engine").agg(F.max_by(F.struct(*values), "recorded").alias("v")).select("run_id", "engine", "v.*")
