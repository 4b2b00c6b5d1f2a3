"""Queries on formats, text variants and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import matches, with_edit_distance
from ..operators import bootstrap
from ..sources import derived, formats
from ..sources.derived import LINES_SQL, METRICS_SQL, OUTPUTS_SQL
from ..streaming import jobs
from .registry import register

_PRINTED = r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')), lambda ws: len(ws) > 0) AS ls FROM documents)
SELECT doc_id, CAST(len(ls) AS INTEGER) AS n_lines, md5(array_to_string(list_transform(ls, lambda ws: array_to_string(ws, ' ')), chr(10))) AS text_md5 FROM l"""


def _printed(spark, sf_dir, xml, read, lines):
    docs = derived.spread(derived.load(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", lines(read(xml(F.col("text")))).alias("ls"))
    return found.select("doc_id", F.coalesce(F.size("ls"), F.lit(0)).alias("n_lines"), F.md5(F.coalesce(F.array_join("ls", "\n"), F.lit(""))).alias("text_md5"))


@register(_PRINTED)
def alto_round_trip(spark, sf_dir):
    """Every text written as ALTO, read back and projected to text."""
    return _printed(spark, sf_dir, formats.to_alto, formats.read_alto, lambda x: F.when(F.size(formats.alto_lines(x)) > 0, formats.alto_lines(x)).otherwise(F.array()))


@register(_PRINTED)
def page_round_trip(spark, sf_dir):
    """Every text written as PAGE, read back and projected to text."""
    return _printed(spark, sf_dir, formats.to_page, formats.read_page, lambda x: F.when(F.size(formats.page_lines(x)) > 0, formats.page_lines(x)).otherwise(F.array()))


# Letters that the diplomatic profile takes as one; the pair is read before its letters.
_PAIR, _FROM, _TO = ("vv", "w"), "ujy", "vii"
_VARIANTS_SQL = f"""v AS (SELECT engine, doc_id, 'caseless' AS variant, lower(gt_line) AS g, lower(hyp_line) AS h FROM lines UNION ALL
SELECT engine, doc_id, 'diplomatic', translate(replace(lower(gt_line), '{_PAIR[0]}', '{_PAIR[1]}'), '{_FROM}', '{_TO}'), translate(replace(lower(hyp_line), '{_PAIR[0]}', '{_PAIR[1]}'), '{_FROM}', '{_TO}') FROM lines UNION ALL
SELECT engine, doc_id, 'no_punctuation', translate(gt_line, '.,;:!?', ''), translate(hyp_line, '.,;:!?', '') FROM lines)"""


@register(f"""WITH {LINES_SQL}, {_VARIANTS_SQL} SELECT engine, variant, CAST(sum(levenshtein(g, h)) AS BIGINT) AS errors, CAST(sum(length(g)) AS BIGINT) AS ref_chars, CAST(sum(levenshtein(g, h)) AS DOUBLE) / sum(length(g)) AS cer FROM v GROUP BY engine, variant""")
def cer_variants(spark, sf_dir):
    """Error rates after case folding, under the diplomatic profile, and without punctuation."""
    fold = lambda c: F.translate(F.replace(F.lower(c), F.lit(_PAIR[0]), F.lit(_PAIR[1])), _FROM, _TO)
    makers = {"caseless": F.lower, "diplomatic": fold, "no_punctuation": lambda c: F.translate(c, ".,;:!?", "")}
    made = F.array(*[F.struct(F.lit(n).alias("variant"), f(F.col("gt_line")).alias("g"), f(F.col("hyp_line")).alias("h")) for n, f in makers.items()])
    rows = derived.split_lines(derived.outputs(spark, sf_dir)).select("engine", F.explode(made).alias("v")).select("engine", "v.*").transform(with_edit_distance, "g", "h", "e")
    return rows.groupBy("engine", "variant").agg(F.sum("e").alias("errors"), F.sum(F.length("g")).cast("bigint").alias("ref_chars")).withColumn("cer", F.col("errors") / F.col("ref_chars"))


@register(f"""WITH {LINES_SQL} SELECT engine, count(*) AS lines, avg(CAST(errors = 0 AS INTEGER)) AS line_accuracy, avg(CAST(length(gt_line) - length(replace(gt_line, ' ', '')) = length(hyp_line) - length(replace(hyp_line, ' ', '')) AS INTEGER)) AS spacing_kept, CAST(sum(greatest(length(replace(hyp_line, ' ', '')) - length(replace(gt_line, ' ', '')), 0)) AS BIGINT) AS added_chars FROM lines GROUP BY engine""")
def structure_metrics(spark, sf_dir):
    """Lines read without error, lines whose spacing is kept, and characters added beyond a line's length."""
    bare = lambda c: F.length(F.replace(F.col(c), F.lit(" "), F.lit("")))
    spaces = lambda c: F.length(c) - bare(c)
    return derived.lines(derived.outputs(spark, sf_dir)).groupBy("engine").agg(F.count(F.lit(1)).alias("lines"), F.avg((F.col("errors") == 0).cast("int")).alias("line_accuracy"), F.avg((spaces("gt_line") == spaces("hyp_line")).cast("int")).alias("spacing_kept"), F.sum(F.greatest(bare("hyp_line") - bare("gt_line"), F.lit(0))).cast("bigint").alias("added_chars"))


# Patterns of the marks that philological scores count.
_MARKERS = {"diacritics": "[àâäáãåçéèêëíîïìñóôöòõúûüùÿ]", "ligatures": "[œæß]", "long_s": "ſ", "ampersand": "&", "digits": "[0-9]+", "capitals": "[A-Z]"}


@register("SELECT lang AS stratum, count(*) AS documents, " + ", ".join(f"CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{p}'))) AS BIGINT) AS {n}" for n, p in _MARKERS.items()) + " FROM documents GROUP BY lang")
def marker_counts(spark, sf_dir):
    """Philological marks of each language's texts."""
    docs = derived.spread(derived.load(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text")))
    return docs.groupBy(F.col("lang").alias("stratum")).agg(F.count(F.lit(1)).alias("documents"), *[F.sum(F.size(matches(F.col("text"), p))).cast("bigint").alias(n) for n, p in _MARKERS.items()])


@register(f"""WITH {OUTPUTS_SQL}, y AS (SELECT engine, doc_id, regexp_extract_all(gt, '\\b(?:1[0-9]{{3}}|20[0-2][0-9])\\b') AS g, regexp_extract_all(hyp, '\\b(?:1[0-9]{{3}}|20[0-2][0-9])\\b') AS h FROM outputs)
SELECT engine, count(*) AS documents, avg(len(list_filter(list_distinct(g), lambda x: list_contains(h, x))) / len(list_distinct(g))) AS recall FROM y WHERE len(g) > 0 GROUP BY engine""")
def distinct_year_recall(spark, sf_dir):
    """The share of a text's distinct years that its output keeps, however often each is there; year_preservation counts every one."""
    years = lambda c: F.array_distinct(matches(F.col(c), ("(?U)" if derived.is_as_written() else "") + r"\b(?:1[0-9]{3}|20[0-2][0-9])\b"))
    rows = derived.outputs(spark, sf_dir).select("engine", years("gt").alias("g"), years("hyp").alias("h")).where("size(g) > 0")
    return rows.groupBy("engine").agg(F.count(F.lit(1)).alias("documents"), F.avg(F.size(F.array_intersect("g", "h")) / F.size("g")).alias("recall"))


@register(f"""WITH {METRICS_SQL}, g AS (SELECT engine, sum(errors) / sum(ref_chars) AS whole FROM m GROUP BY engine), s AS (SELECT stratum, engine, count(*) AS documents, CAST(sum(errors) AS DOUBLE) / sum(ref_chars) AS local FROM m WHERE stratum IS NOT NULL GROUP BY stratum, engine),
r AS (SELECT s.*, whole, row_number() OVER (PARTITION BY stratum ORDER BY local, engine) AS k, lead(local) OVER (PARTITION BY stratum ORDER BY local, engine) AS next FROM s JOIN g USING (engine))
SELECT 'stratum_winner' AS fact, stratum, engine, local AS value FROM r WHERE k = 1 AND documents >= 3 AND local < 0.75 * next UNION ALL SELECT 'stratum_collapse', stratum, engine, local FROM r WHERE local > 2 * whole AND local - whole > 0.05""")
def stratum_facts(spark, sf_dir):
    """Engines that clearly win a stratum, and those that fail in one far beyond their whole."""
    return bootstrap.stratum_facts(derived.doc_metrics(spark, sf_dir))


@register()
def bootstrap_intervals(spark, sf_dir):
    """Mean error rate of every engine with a 95 % interval."""
    return bootstrap.intervals(derived.doc_metrics(spark, sf_dir).where("cer IS NOT NULL"), "engine", "doc_id", "cer")


@register()
def multinomial_intervals(spark, sf_dir):
    """The same from resamples of exactly as many documents as there are."""
    return bootstrap.multinomial_intervals(derived.doc_metrics(spark, sf_dir), "engine", "doc_id", "cer")


@register("SELECT user_id AS job_id, count(*) AS events, max(event_id) AS last_seq, arg_max(event_type, event_id) AS last_kind, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id")
def job_progress_stream(spark, sf_dir):
    return jobs.drain(jobs.progress(jobs.event_stream(spark, f"{sf_dir}/events*.parquet")), "progress", "job_id")


@register("SELECT user_id AS job_id, event_id AS seq, event_type AS kind FROM events WHERE event_id > 499")
def job_replay_stream(spark, sf_dir):
    """All events after an offset, as a client that comes back reads them."""
    return jobs.drain(jobs.replay(jobs.event_stream(spark, f"{sf_dir}/events*.parquet"), 499).select("job_id", "seq", "kind"), "replay")


@register("SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS events FROM events GROUP BY ALL")
def event_windows_stream(spark, sf_dir):
    return jobs.drain(jobs.windows(jobs.event_stream(spark, f"{sf_dir}/events*.parquet")), "windows", "start", "kind")
