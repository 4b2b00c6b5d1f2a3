"""Queries on views, jobs, history and stored artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, views
from ..sources import derived, formats, runs
from .registry import register
from .statistics import _RUNS_SQL, _runs

_DAYS = 7


def _events(spark, sf_dir):
    return derived.load(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", F.col("event_type").alias("kind"))


@register("SELECT user_id AS job_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def event_numbers(spark, sf_dir):
    """Every event's number within its job."""
    return runs.numbered(_events(spark, sf_dir)).select("job_id", "event_id", "seq")


def _jobs(spark, sf_dir):
    last = F.max_by("kind", F.struct("ts", "event_id"))
    status = F.when(last == "purchase", "complete").when(last == "error", "error").when(last == "click", "running").otherwise("pending")
    return _events(spark, sf_dir).groupBy("job_id").agg(F.min("ts").alias("created"), status.alias("status"))


_JOBS_SQL = """j AS (SELECT user_id AS job_id, min(ts) AS created, CASE arg_max(event_type, struct_pack(t := ts, e := event_id)) WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' WHEN 'click' THEN 'running' ELSE 'pending' END AS status FROM events GROUP BY user_id)"""


@register(f"WITH {_JOBS_SQL} SELECT job_id, created, status FROM j WHERE status = 'running' ORDER BY created DESC, job_id LIMIT 50")
def running_jobs(spark, sf_dir):
    """A report of the fifty newest running jobs."""
    return runs.job_list(_jobs(spark, sf_dir), "running").limit(50)


@register(f"WITH {_JOBS_SQL} SELECT CASE WHEN status IN ('pending', 'running') THEN 'interrupted' ELSE status END AS status, count(*) AS jobs FROM j GROUP BY 1")
def jobs_after_restart(spark, sf_dir):
    """Jobs by status once those that were at work are interrupted."""
    return runs.interrupted(_jobs(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


@register(f"WITH {_JOBS_SQL}, n AS (SELECT max(ts) AS now FROM events), y AS (SELECT job_id FROM j, n WHERE created >= now - INTERVAL {_DAYS} DAY) SELECT (SELECT count(*) FROM y) AS jobs, (SELECT count(*) FROM events WHERE user_id IN (SELECT job_id FROM y)) AS events")
def job_retention(spark, sf_dir):
    """Jobs and events that a purge of those older than a week leaves, counted from the latest event."""
    now = derived.load(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    young, events = runs.kept_jobs(_jobs(spark, sf_dir), _events(spark, sf_dir), F.lit(now), _DAYS)
    return young.agg(F.count(F.lit(1)).alias("jobs")).join(F.broadcast(events.agg(F.count(F.lit(1)).alias("events"))))


@register("SELECT sha256('=' || coalesce(text, '')) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def artifact_keys(spark, sf_dir):
    """Content keys of all texts: each is stored once, however many documents have it."""
    docs = derived.load(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.groupBy(runs.content_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@register("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def remaining_documents(spark, sf_dir):
    """Documents that a stopped run (here: of the labels) has still to do."""
    return runs.remaining(derived.load(spark, sf_dir, "documents").select("doc_id"), derived.load(spark, sf_dir, "labels"), "doc_id")


@register(f"WITH {_RUNS_SQL} SELECT engine, count(*) AS runs, count(DISTINCT date_trunc('day', ts)) AS days, min(ts) AS first_run, max(ts) AS last_run FROM runs GROUP BY engine")
def history_counts(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("engine").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct(F.date_trunc("day", "ts")).alias("days"), F.min("ts").alias("first_run"), F.max("ts").alias("last_run"))


@register(f"WITH {_RUNS_SQL} SELECT engine, run_id, ts, cer FROM runs WHERE cer IS NOT NULL ORDER BY ts, run_id LIMIT 1000")
def history_curve(spark, sf_dir):
    """A report of the first thousand scores in the order of time."""
    return _runs(spark, sf_dir).where("cer IS NOT NULL").orderBy("ts", "run_id").limit(1000)


@register(f"WITH {_RUNS_SQL}, s AS (SELECT engine, count(*) AS runs, arg_min(cer, struct_pack(t := ts, r := run_id)) AS first_cer, arg_max(cer, struct_pack(t := ts, r := run_id)) AS last_cer FROM runs WHERE cer IS NOT NULL GROUP BY engine) SELECT *, last_cer - first_cer AS delta FROM s WHERE runs >= 3 AND abs(last_cer - first_cer) >= 0.01")
def longitudinal_changes(spark, sf_dir):
    """Engines whose score has moved by a point or more from their first run to their last."""
    return history.longitudinal(_runs(spark, sf_dir))


@register(f"WITH {_RUNS_SQL}, d AS (SELECT engine, cer, cume_dist() OVER (PARTITION BY engine ORDER BY cer) AS share, row_number() OVER (PARTITION BY engine ORDER BY ts DESC, run_id DESC) AS k FROM runs) SELECT engine, cer AS latest, share FROM d WHERE k = 1")
def latest_percentile(spark, sf_dir):
    """The share of an engine's runs that are no worse than its latest."""
    return history.latest_percentile(_runs(spark, sf_dir))


def _artifacts(spark, sf_dir):
    """Every text as it is, as ALTO, and as a payload that cannot be read."""
    docs = derived.spread(derived.load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("gt")))
    kind = lambda name, payload: F.struct(F.lit(name).alias("kind"), payload.alias("payload"))
    kinds = F.array(kind("raw_text", F.translate("gt", "u", "v")), kind("alto_xml", formats.to_alto(F.col("gt"))), kind("page_xml", F.lit("<broken")), kind("image", F.lit("")))
    return docs.select("doc_id", "gt", F.explode(kinds).alias("a")).select("doc_id", "gt", "a.*")


_ELIGIBLE = " UNION ALL ".join(f"SELECT '{v}' AS view, '{k}' AS kind" for v, ks in views.VIEWS.items() for k in ks)


@register(f"WITH k AS (SELECT unnest(['raw_text', 'alto_xml', 'page_xml', 'image']) AS kind), v AS ({_ELIGIBLE}) SELECT view, kind, (SELECT count(*) FROM documents) AS artifacts FROM k JOIN v USING (kind)")
def view_eligibility(spark, sf_dir):
    """Which artifacts each view compares."""
    return views.eligible(_artifacts(spark, sf_dir).select("kind")).groupBy("view", "kind").agg(F.count(F.lit(1)).alias("artifacts"))


@register()
def view_report(spark, sf_dir):
    """Mean error rates by view over the artifacts that can be read, and what could not be scored."""
    rows = _artifacts(spark, sf_dir).where(F.col("kind").isin(*views.VIEWS["search"])).withColumn("view", F.lit("search"))
    read = rows.select(F.col("kind").alias("engine"), "view", "gt", views.projected(F.col("kind"), F.col("payload")).alias("hyp")).withColumn("hyp", F.when((F.col("engine") == "page_xml") & (F.col("hyp") == ""), None).otherwise(F.col("hyp")))
    norm = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return views.view_means(views.text_scores(read.withColumns({"gt": norm("gt"), "hyp": norm("hyp")})))


@register()
def alto_preservation(spark, sf_dir):
    """Words, lines and boxes that the ALTO form of every text keeps."""
    docs = derived.spread(derived.load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("a", formats.read_alto(formats.to_alto(F.col("text"))))
    rows = docs.select(views.preserved_words(F.col("text"), F.col("a")).alias("kept"), views.alto_structure(F.col("a"), F.col("a")).alias("s"))
    return rows.agg(F.avg("kept").alias("preserved"), F.min("kept").alias("least"), F.avg(F.col("s.valid").cast("int")).alias("valid"), F.avg("s.line_ratio").alias("line_ratio"), F.count(F.lit(1)).alias("documents"))
