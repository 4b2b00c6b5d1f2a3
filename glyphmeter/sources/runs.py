"""Runs of a benchmark as folders and documents: writing, reading, resuming; stored artifacts; the job log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import checkpointed

# The tables of a run's folder.
TABLES = ("pipeline_results", "view_results", "artifacts_index")

BENCHMARK = (
    "corpus struct<name:string,documents:bigint>, run_date string, ranking array<struct<engine:string,mean_cer:double,position:int>>, "
    "engine_reports array<struct<engine:string,document_results:array<struct<doc_id:string,cer:double,wer:double,error:string>>>>"
)


def write_run(folder: str, manifest: DataFrame, **tables: DataFrame) -> None:
    """A run's manifest (one row) and its tables, as lines of JSON, each in a folder of its own."""
    for name, rows in {"manifest": manifest, **tables}.items():
        rows.write.mode("errorifexists").json(f"{folder}/{name}")


def read_run(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """One table of a run; lines that are no JSON are left out."""
    rows = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(f"{folder}/{name}").where("_corrupt IS NULL")
    return rows.drop("_corrupt")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """engine, doc_id, cer, wer, error, corpus, run_date of a benchmark document, or of a folder of them."""
    reports = spark.read.schema(BENCHMARK).option("multiLine", "true").json(path)
    each = reports.select(F.col("corpus.name").alias("corpus"), "run_date", F.explode("engine_reports").alias("e"))
    return each.select("e.engine", F.inline("e.document_results"), "corpus", "run_date")


def benchmark_reports(results: DataFrame, corpus: str, run_date: str) -> DataFrame:
    """One JSON line an engine (corpus, engine, run_date, documents, mean_cer, document_results) with its keys in order."""
    rows = results.groupBy("engine").agg(F.count(F.lit(1)).alias("documents"), F.avg("cer").alias("mean_cer"), F.array_sort(F.collect_list(F.struct("doc_id", "cer"))).alias("document_results"))
    named = rows.select(F.lit(corpus).alias("corpus"), "document_results", "documents", "engine", "mean_cer", F.lit(run_date).alias("run_date"))
    return named.select("engine", F.to_json(F.struct(*named.columns)).alias("json"))


# --- partial results: runs that go on where they stopped --------------------------------------------------------


def append_partial(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)


def load_partial(spark: SparkSession, folder: str, schema: str, *keys: str) -> DataFrame:
    """All partial results, corrupt lines left out, one row for equal keys (the largest, as rows of one key should agree)."""
    rows = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(folder).where("_corrupt IS NULL").drop("_corrupt")
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*values)).alias("v")).select(*keys, "v.*")


def remaining(documents: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """The documents that no partial result has yet."""
    return documents.join(done.select(*keys).distinct(), list(keys), "left_anti")


def resumed(done: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """What was loaded and what was added, new rows only for keys that were not there."""
    return done.unionByName(remaining(new, done, *keys))


# --- artifacts and keys -----------------------------------------------------------------------------------------


def content_key(*parts: Column) -> Column:
    """A key of 64 hex digits of any columns: equal values, equal key; null is a value of its own."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]), 256)


def store_artifacts(payloads: DataFrame, folder: str, *columns: str, stored: DataFrame | None = None) -> DataFrame:
    """Store payloads under their content keys, each once; returns payloads with their keys.

    stored (key) is what the folder has already: it is not written again, so a step that is repeated adds nothing.
    """
    keyed = checkpointed(payloads.withColumn("key", content_key(*[F.col(c) for c in columns])))
    new = keyed.select("key", *columns).dropDuplicates(["key"])
    if stored is not None:
        new = new.join(stored.select("key"), "key", "left_anti")
    new.write.mode("append").parquet(folder)
    return keyed


# --- the job log ------------------------------------------------------------------------------------------------

# Which states a job may go to from each.
STATES = {"pending": ("running", "cancelled", "interrupted"), "running": ("complete", "error", "cancelled", "interrupted"), "complete": (), "error": (), "cancelled": (), "interrupted": ()}


def numbered(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """events with seq: from 1 in the order of time within each job, going on after the largest that before (job_id, seq) has."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    rows = events.withColumn("seq", F.row_number().over(w).cast("bigint"))
    if before is None:
        return rows
    last = before.groupBy("job_id").agg(F.max("seq").alias("last"))
    return rows.join(last, "job_id", "left").withColumn("seq", F.col("seq") + F.coalesce("last", F.lit(0))).drop("last")


def job_list(jobs: DataFrame, status: str | None = None) -> DataFrame:
    """Jobs, the newest first, of one status or of all."""
    return (jobs.where(F.col("status") == status) if status else jobs).orderBy(F.desc("created"), "job_id")


def kept_jobs(jobs: DataFrame, events: DataFrame, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """What a purge leaves: jobs that are young enough, and the events of these."""
    young = jobs.where(F.col("created") >= now - F.make_dt_interval(F.lit(days)))
    return young, events.join(young.select("job_id"), "job_id", "left_semi")


def interrupted(jobs: DataFrame) -> DataFrame:
    """jobs after a restart: those that were pending or running are interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin("pending", "running"), "interrupted").otherwise(F.col("status")))


def broken_moves(events: DataFrame) -> DataFrame:
    """Changes of state (job_id, seq, state) that the states do not allow from the one before; the first must be pending."""
    before = F.lag("state", 1, "").over(Window.partitionBy("job_id").orderBy("seq"))
    allowed = (F.col("before") == "") & (F.col("state") == "pending")
    for source, targets in STATES.items():
        if targets:
            allowed = allowed | (F.col("before") == source) & F.col("state").isin(*targets)
    return events.withColumn("before", before).where(~allowed)
