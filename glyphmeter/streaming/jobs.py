"""The log of job events as a stream: replay after an offset, progress by job, counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import fresh_folder

SOURCE = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """job_id, seq, kind, data_json, ts of a growing folder of events; a single file must be given as a pattern."""
    raw = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("props").alias("data_json"), "ts")


def replay(events: DataFrame, after: int) -> DataFrame:
    """Events later than an offset, each once, whatever the order of the files: no watermark, so none is too late; the state keeps every key."""
    return events.where(F.col("seq") > after).dropDuplicates(["job_id", "seq"])


def progress(events: DataFrame) -> DataFrame:
    """What a job's latest event says, and how many there are."""
    return events.groupBy("job_id").agg(F.count(F.lit(1)).alias("events"), F.max("seq").alias("last_seq"), F.max_by("kind", "seq").alias("last_kind"), F.count_if(F.col("kind") == "error").alias("errors"))


def windows(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events by window and kind, for update mode: no watermark, so every event counts in any order of the files."""
    counts = events.groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("events"))
    return counts.select(F.col("window.start").alias("start"), "kind", "events")


def drain(stream: DataFrame, name: str, *keys: str) -> DataFrame:
    """Process all there is and return it as a table; of rows with equal keys the last batch counts.

    Batches are written to folders of their own number, so a batch that is repeated after a failure replaces itself.
    """
    spark = stream.sparkSession
    out, state = fresh_folder(spark, name), fresh_folder(spark, f"{name}-state")
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    if not keys:
        return rows.drop("batch")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
