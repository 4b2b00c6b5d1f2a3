"""Queries on statistics, history, cost, rules and order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.order import region_order
from ..operators import history, report, stats
from ..sources import derived
from ..sources.derived import METRICS_SQL
from .registry import register

_N = len(derived.ENGINES)


@register(f"""WITH {METRICS_SQL}, d AS (SELECT a.engine AS engine_a, b.engine AS engine_b, a.cer - b.cer AS d FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.engine < b.engine WHERE a.cer <> b.cer),
c AS (SELECT engine_a, engine_b, abs(d) AS s, count(*) FILTER (WHERE d > 0) AS p, count(*) FILTER (WHERE d < 0) AS q FROM d GROUP BY ALL),
r AS (SELECT *, coalesce(sum(p + q) OVER (PARTITION BY engine_a, engine_b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (p + q + 1) / 2 AS rank FROM c),
w AS (SELECT engine_a, engine_b, CAST(sum(p + q) AS DOUBLE) AS n, sum(rank * p) AS w_plus, sum(rank * q) AS w_minus, CAST(sum(CAST(p + q AS DOUBLE) ** 3 - (p + q)) AS DOUBLE) AS ties FROM r GROUP BY ALL)
SELECT engine_a, engine_b, CAST(n AS BIGINT) AS n, w_plus, w_minus, sign(w_plus - n * (n + 1) / 4) * greatest(abs(w_plus - n * (n + 1) / 4) - 0.5, 0) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w""")
def wilcoxon_pairs(spark, sf_dir):
    """Signed-rank statistics of every pair of engines."""
    return stats.wilcoxon_pairs(derived.doc_metrics(spark, sf_dir).select("doc_id", "engine", "cer"))


_FRIEDMAN = f"""WITH {METRICS_SQL}, f AS (SELECT doc_id, engine, cer, count(*) OVER (PARTITION BY doc_id) AS k FROM m WHERE cer IS NOT NULL),
r AS (SELECT doc_id, engine, rank() OVER (PARTITION BY doc_id ORDER BY cer) + (count(*) OVER (PARTITION BY doc_id, cer) - 1) / 2 AS rank, count(*) OVER (PARTITION BY doc_id, cer) AS t FROM f WHERE k = {_N}),
g AS (SELECT engine, avg(rank) AS mean_rank, count(*) AS documents, sum(t * t - 1) AS ties FROM r GROUP BY engine)"""


@register(f"{_FRIEDMAN} SELECT engine, mean_rank, documents, (12.0 * documents / ({_N} * ({_N} + 1)) * sum((mean_rank - ({_N} + 1) / 2) ** 2) OVER ()) / (1 - sum(ties) OVER () / (documents * ({_N}.0 ** 3 - {_N}))) AS chi_square FROM g")
def friedman_ranks(spark, sf_dir):
    return stats.friedman(derived.doc_metrics(spark, sf_dir), _N)


@register(f"{_FRIEDMAN} SELECT a.engine AS engine_a, b.engine AS engine_b, abs(a.mean_rank - b.mean_rank) AS rank_gap, {stats.NEMENYI_Q[_N]} * sqrt({_N} * ({_N} + 1) / (6.0 * a.documents)) AS critical_difference, abs(a.mean_rank - b.mean_rank) > {stats.NEMENYI_Q[_N]} * sqrt({_N} * ({_N} + 1) / (6.0 * a.documents)) AS significant FROM g a JOIN g b ON a.engine < b.engine")
def nemenyi_cd(spark, sf_dir):
    return stats.nemenyi(stats.friedman(derived.doc_metrics(spark, sf_dir), _N), _N)


@register("""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL),
t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(coalesce(sum(n) FILTER (WHERE a = b), 0) AS DOUBLE) AS same FROM c), x AS (SELECT a AS v, sum(n) AS n FROM c GROUP BY a), y AS (SELECT b AS v, sum(n) AS n FROM c GROUP BY b),
e AS (SELECT CAST(coalesce(sum(x.n * y.n), 0) AS DOUBLE) AS chance FROM x JOIN y USING (v))
SELECT CAST(n AS BIGINT) AS n, same / n AS observed, chance / (n * n) AS expected, (same / n - chance / (n * n)) / (1 - chance / (n * n)) AS kappa FROM t, e""")
def cohen_kappa(spark, sf_dir):
    """Chance-corrected agreement of the two label columns."""
    return stats.cohen_kappa(derived.load(spark, sf_dir, "labels"), "quality", "toxic")


@register("""WITH u AS (SELECT doc_id, quality AS v FROM labels UNION ALL SELECT doc_id, toxic FROM labels), p AS (SELECT doc_id, v, count(*) AS n FROM u WHERE v IS NOT NULL GROUP BY ALL),
m AS (SELECT doc_id, sum(n) AS m, sum(n * n) AS s FROM p GROUP BY doc_id HAVING sum(n) > 1), o AS (SELECT CAST(sum(m) AS DOUBLE) AS n, sum((m * m - s) / (m - 1)) AS apart FROM m),
t AS (SELECT CAST(sum(n * n) AS DOUBLE) AS s FROM (SELECT v, sum(n) AS n FROM p SEMI JOIN m USING (doc_id) GROUP BY v))
SELECT CAST(n AS BIGINT) AS pairable, apart / n AS observed, (n * n - s) / (n * (n - 1)) AS expected, 1 - (apart / n) / ((n * n - s) / (n * (n - 1))) AS alpha FROM o, t""")
def krippendorff_alpha(spark, sf_dir):
    labels = derived.load(spark, sf_dir, "labels")
    return stats.krippendorff_alpha(labels.select("doc_id", F.explode(F.array("quality", "toxic")).alias("v")), "doc_id", "v")


@register(f"""WITH {METRICS_SQL}, b AS (SELECT doc_id, {' || '.join(f"max(CASE WHEN engine = '{e}' AND cer > 0.05 THEN '1' ELSE '0' END)" for e in sorted(derived.ENGINES))} AS mask FROM m GROUP BY doc_id) SELECT mask, count(*) AS documents FROM b GROUP BY mask""")
def venn_masks(spark, sf_dir):
    """Documents by the set of engines that fail on them (CER above 5 percent)."""
    bits = [F.max(F.when((F.col("engine") == e) & (F.col("cer") > 0.05), "1").otherwise("0")) for e in sorted(derived.ENGINES)]
    return derived.doc_metrics(spark, sf_dir).groupBy("doc_id").agg(F.concat(*bits).alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("documents"))


# Pipeline runs of the slot study: preprocessing, recogniser, corrector and score (a fixture).
_RUNS = "('none', 'a', 'x', 0.12), ('clean', 'a', 'x', 0.10), ('none', 'b', 'x', 0.20), ('clean', 'b', 'x', 0.15), ('none', 'a', 'y', 0.11), ('clean', 'a', 'y', 0.11)"


@register(f"""WITH r(pre, ocr, fix, score) AS (VALUES {_RUNS}), k AS (SELECT *, rank() OVER (PARTITION BY ocr, fix ORDER BY score) + (count(*) OVER (PARTITION BY ocr, fix, score) - 1) / 2 AS rank, count(*) OVER (PARTITION BY ocr, fix) AS n FROM r)
SELECT pre AS value, avg(CAST(score AS DOUBLE)) AS mean_score, coalesce(stddev_samp(CAST(score AS DOUBLE)), 0.0) AS stdev_score, avg(rank) AS mean_rank, count(*) AS runs FROM k WHERE n > 1 GROUP BY pre""")
def slot_effect(spark, sf_dir):
    """The effect of one slot of a pipeline, all others held fixed."""
    runs = spark.sql(f"SELECT pre, ocr, fix, CAST(score AS DOUBLE) AS score FROM VALUES {_RUNS} AS r(pre, ocr, fix, score)")
    k = runs.select("pre", "score", stats.mid_rank("score", "ocr", "fix").alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("ocr", "fix")).alias("n")).where("n > 1")
    return k.groupBy(F.col("pre").alias("value")).agg(F.avg("score").alias("mean_score"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("stdev_score"), F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("runs"))


_RUNS_SQL = "runs AS (SELECT event_type AS engine, event_id AS run_id, ts, value / 500 AS cer FROM events)"


def _runs(spark, sf_dir):
    return derived.load(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.col("event_id").alias("run_id"), "ts", (F.col("value") / 500).alias("cer"))


@register(f"WITH {_RUNS_SQL}, k AS (SELECT engine, cer, lag(cer) OVER (PARTITION BY engine ORDER BY ts, run_id) AS previous, row_number() OVER (PARTITION BY engine ORDER BY ts DESC, run_id DESC) AS k FROM runs) SELECT engine, previous, cer AS latest, cer - previous AS delta, cer - previous > 0.01 AS is_regression FROM k WHERE k = 1")
def history_regression(spark, sf_dir):
    return history.latest_regression(_runs(spark, sf_dir))


@register(f"WITH {_RUNS_SQL}, x AS (SELECT engine, epoch_us(ts) / 86400000000.0 AS x, cer AS y FROM runs) SELECT engine, count(*) AS runs, covar_pop(x, y) / var_pop(x) AS slope, avg(y) - covar_pop(x, y) / var_pop(x) * avg(x) AS intercept, covar_pop(x, y) ** 2 / (var_pop(x) * var_pop(y)) AS r2 FROM x GROUP BY engine")
def linear_trend(spark, sf_dir):
    return history.linear_trend(_runs(spark, sf_dir))


@register(f"""WITH {_RUNS_SQL}, s AS (SELECT engine, row_number() OVER w AS k, sum(cer) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, sum(cer) OVER (PARTITION BY engine) AS a, count(*) OVER (PARTITION BY engine) AS n FROM runs WINDOW w AS (PARTITION BY engine ORDER BY ts, run_id)),
c AS (SELECT engine, k, l / (k - 1) AS b, (a - l) / (n - k + 1) AS f FROM s WHERE k > 3 AND n - k + 1 >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY abs(f - b) DESC, k) AS q FROM c)
SELECT engine, k - 1 AS runs_before, b AS mean_before, f AS mean_after FROM r WHERE q = 1""")
def change_point(spark, sf_dir):
    return history.change_point(_runs(spark, sf_dir))


@register(f"WITH {_RUNS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY ts DESC, run_id DESC) AS k FROM runs), p AS (SELECT engine, count(*) AS runs, avg(cer) AS mean_cer, quantile_cont(cer, 0.5) AS median_cer FROM k WHERE k > 1 GROUP BY engine) SELECT engine, runs, mean_cer, median_cer, cer AS latest, (cer - mean_cer) / mean_cer AS relative_delta, abs((cer - mean_cer) / mean_cer) > 0.2 AS off_baseline FROM p JOIN k USING (engine) WHERE k = 1")
def baseline_delta(spark, sf_dir):
    return history.baseline(_runs(spark, sf_dir))


@register(f"""WITH {METRICS_SQL}, v AS (SELECT doc_id, var_pop(cer) AS v FROM m WHERE cer IS NOT NULL GROUP BY doc_id), d AS (SELECT doc_id, length(regexp_replace(gt, '[a-zA-Z0-9 \\n.,;]', '', 'g')) / length(gt) AS density FROM gt WHERE length(gt) > 0),
s AS (SELECT doc_id, 0.4 * least(1.0, v / 0.25) + 0.25 * least(1.0, 3 * density) AS score FROM v JOIN d USING (doc_id))
SELECT doc_id, score, CASE WHEN score < 0.25 THEN 'easy' WHEN score < 0.5 THEN 'medium' WHEN score < 0.75 THEN 'hard' ELSE 'very hard' END AS label FROM s""")
def difficulty_score(spark, sf_dir):
    """How hard a document is: disagreement of the engines and density of special characters (no image quality here)."""
    v = derived.doc_metrics(spark, sf_dir).where("cer IS NOT NULL").groupBy("doc_id").agg(F.var_pop("cer").alias("v"))
    d = derived.ground_truth(spark, sf_dir).where("length(gt) > 0").select("doc_id", (F.length(F.regexp_replace("gt", r"[a-zA-Z0-9 \n.,;]", "")) / F.length("gt")).alias("density"))
    score = 0.4 * F.least(F.lit(1.0), F.col("v") / 0.25) + 0.25 * F.least(F.lit(1.0), 3 * F.col("density"))
    return v.join(d, "doc_id").select("doc_id", score.alias("score")).withColumn("label", F.when(F.col("score") < 0.25, "easy").when(F.col("score") < 0.5, "medium").when(F.col("score") < 0.75, "hard").otherwise("very hard"))


# Pricing fixture: engine, kind, price of 1000 pages, seconds a page, hourly rate, kWh of 1000 pages.
_PRICES = "('drops_u', 'local', 0.0, 2.0, 0.5, 1.2), ('e_as_c', 'api', 1.5, 0.0, 0.0, 0.4), ('merges_pairs', 'local', 0.0, 18.0, 2.0, 9.0), ('adds_words', 'api', 10.0, 0.0, 0.0, 2.5)"
_COST_SQL = f"p(engine, kind, api, seconds, rate, kwh) AS (SELECT col0, col1, CAST(col2 AS DOUBLE), CAST(col3 AS DOUBLE), CAST(col4 AS DOUBLE), CAST(col5 AS DOUBLE) FROM (VALUES {_PRICES})), cost AS (SELECT engine, CASE WHEN kind = 'api' THEN api ELSE seconds / 3600 * rate * 1000 END AS cost_1k, kwh * 0.06 AS co2_1k, seconds FROM p)"


def _costs(spark):
    p = spark.sql(f"SELECT engine, kind, CAST(api AS DOUBLE) api, CAST(seconds AS DOUBLE) seconds, CAST(rate AS DOUBLE) rate, CAST(kwh AS DOUBLE) kwh FROM VALUES {_PRICES} AS p(engine, kind, api, seconds, rate, kwh)")
    return p.select("engine", F.when(F.col("kind") == "api", F.col("api")).otherwise(F.col("seconds") / 3600 * F.col("rate") * 1000).alias("cost_1k"), (F.col("kwh") * 0.06).alias("co2_1k"), "seconds")


_ENGINE_SQL = f"WITH {METRICS_SQL}, {_COST_SQL}, e AS (SELECT engine, sum(errors) AS errors, count(*) AS docs, CAST(sum(errors) AS DOUBLE) / sum(ref_chars) AS micro_cer FROM m GROUP BY engine), x AS (SELECT * FROM e JOIN cost USING (engine))"


def _engines(spark, sf_dir):
    e = derived.doc_metrics(spark, sf_dir).groupBy("engine").agg(F.sum("errors").alias("errors"), F.count(F.lit(1)).alias("docs"), report.micro_cer().alias("micro_cer"))
    return e.join(F.broadcast(_costs(spark)), "engine")


@register(f"{_ENGINE_SQL} SELECT engine, cost_1k, co2_1k, cost_1k * docs / 1000 AS corpus_cost, cost_1k * 100 AS cost_100k_pages, cost_1k - min(cost_1k) OVER () AS gap_to_cheapest FROM x")
def cost_model(spark, sf_dir):
    """Cost and CO2 of 1000 pages, of the corpus and projected, and the gap to the cheapest."""
    x = _engines(spark, sf_dir)
    return x.select("engine", "cost_1k", "co2_1k", (F.col("cost_1k") * F.col("docs") / 1000).alias("corpus_cost"), (F.col("cost_1k") * 100).alias("cost_100k_pages"), (F.col("cost_1k") - F.min("cost_1k").over(Window.partitionBy())).alias("gap_to_cheapest"))


@register(f"{_ENGINE_SQL} SELECT engine, docs / (seconds * docs + 5.0 * errors) * 3600 AS effective_pages_per_hour FROM x WHERE seconds * docs + 5.0 * errors > 0")
def effective_throughput(spark, sf_dir):
    """Pages an hour with five seconds of correction for each error."""
    total = F.col("seconds") * F.col("docs") + 5.0 * F.col("errors")
    return _engines(spark, sf_dir).where(total > 0).select("engine", (F.col("docs") / total * 3600).alias("effective_pages_per_hour"))


@register(f"{_ENGINE_SQL} SELECT a.engine AS engine_from, b.engine AS engine_to, (b.cost_1k - a.cost_1k) * a.docs / 1000 / (a.errors - b.errors) AS cost_per_avoided_error FROM x a JOIN x b ON b.errors < a.errors AND b.cost_1k > a.cost_1k")
def marginal_cost(spark, sf_dir):
    """What each avoided error costs on the way from a cheaper engine to a better one."""
    a = _engines(spark, sf_dir)
    b = a.select(*[F.col(c).alias(f"to_{c}") for c in a.columns])
    return a.join(F.broadcast(b), (F.col("to_errors") < F.col("errors")) & (F.col("to_cost_1k") > F.col("cost_1k"))).select(F.col("engine").alias("engine_from"), F.col("to_engine").alias("engine_to"), ((F.col("to_cost_1k") - F.col("cost_1k")) * F.col("docs") / 1000 / (F.col("errors") - F.col("to_errors"))).alias("cost_per_avoided_error"))


@register(f"{_ENGINE_SQL} SELECT engine, micro_cer, cost_1k, co2_1k FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.engine <> a.engine AND b.micro_cer <= a.micro_cer AND b.cost_1k <= a.cost_1k AND (b.micro_cer < a.micro_cer OR b.cost_1k < a.cost_1k))")
def pareto_front(spark, sf_dir):
    """Engines that no other beats on error rate and cost together."""
    return report.pareto_front(_engines(spark, sf_dir).select("engine", "micro_cer", "cost_1k", "co2_1k"), "engine", "micro_cer", "cost_1k")


# Degradation curves (fixture): engine, level, CER.
_CURVES = "('drops_u', 0.0, 0.02), ('drops_u', 0.5, 0.10), ('drops_u', 1.0, 0.40), ('e_as_c', 0.0, 0.05), ('e_as_c', 0.5, 0.07), ('e_as_c', 1.0, 0.12)"


@register(f"""WITH c AS (SELECT col0 AS engine, CAST(col1 AS DOUBLE) AS lo, CAST(col2 AS DOUBLE) AS c0 FROM (VALUES {_CURVES})), s AS (SELECT *, lead(lo) OVER w AS hi, lead(c0) OVER w AS c1 FROM c WINDOW w AS (PARTITION BY engine ORDER BY lo)),
q AS (SELECT doc_id, least(1.0, (doc_id % 97) / 96.0) AS level FROM documents), p AS (SELECT engine, c0 + (c1 - c0) * (level - lo) / (hi - lo) AS cer FROM q JOIN s ON hi IS NOT NULL AND level >= lo AND (level < hi OR (hi = 1.0 AND level = 1.0)))
SELECT engine, avg(cer) AS projected_cer, max(cer) AS worst_cer, count(*) AS documents FROM p GROUP BY engine""")
def robustness_projection(spark, sf_dir):
    """Expected CER when every document degrades to its own level, by piecewise linear curves."""
    w = Window.partitionBy("engine").orderBy("lo")
    s = spark.sql(f"SELECT engine, CAST(lo AS DOUBLE) lo, CAST(c0 AS DOUBLE) c0 FROM VALUES {_CURVES} AS c(engine, lo, c0)").withColumns({"hi": F.lead("lo").over(w), "c1": F.lead("c0").over(w)}).where("hi IS NOT NULL")
    q = derived.load(spark, sf_dir, "documents").select(F.least(F.lit(1.0), (F.col("doc_id") % 97) / F.lit(96.0)).alias("level"))
    within = (F.col("level") >= F.col("lo")) & ((F.col("level") < F.col("hi")) | ((F.col("hi") == 1.0) & (F.col("level") == 1.0)))
    p = q.join(F.broadcast(s), within).select("engine", (F.col("c0") + (F.col("c1") - F.col("c0")) * (F.col("level") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("cer"))
    return p.groupBy("engine").agg(F.avg("cer").alias("projected_cer"), F.max("cer").alias("worst_cer"), F.count(F.lit(1)).alias("documents"))


@register(f"""WITH {METRICS_SQL}, a AS (SELECT engine, avg(cer) AS cer FROM m WHERE stratum = 'en' AND engine <> 'adds_words' GROUP BY engine), b AS (SELECT engine, avg(cer) AS cer FROM m WHERE stratum = 'fr' AND engine <> 'drops_u' GROUP BY engine)
SELECT engine, CASE WHEN a.cer IS NULL THEN 'only_b' WHEN b.cer IS NULL THEN 'only_a' ELSE 'common' END AS side, a.cer AS cer_a, b.cer AS cer_b, b.cer - a.cer AS delta FROM a FULL JOIN b USING (engine)""")
def run_comparison_full_outer(spark, sf_dir):
    """Two runs side by side: common engines with their change, and those of one run alone."""
    m = derived.doc_metrics(spark, sf_dir)
    a = m.where("stratum = 'en' AND engine <> 'adds_words'").groupBy("engine").agg(F.avg("cer").alias("cer_a"))
    b = m.where("stratum = 'fr' AND engine <> 'drops_u'").groupBy("engine").agg(F.avg("cer").alias("cer_b"))
    side = F.when(F.col("cer_a").isNull(), "only_b").when(F.col("cer_b").isNull(), "only_a").otherwise("common")
    return a.join(b, "engine", "full_outer").select("engine", side.alias("side"), "cer_a", "cer_b", (F.col("cer_b") - F.col("cer_a")).alias("delta"))


@register("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(coalesce(text, '')), turn) AS place FROM conversations),
p AS (SELECT a.conv_id, count(*) AS pairs, count(*) FILTER (WHERE a.place < b.place) AS kept FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY a.conv_id)
SELECT conv_id, pairs, CAST(kept AS DOUBLE) / pairs AS order_f1 FROM p""")
def reading_order_f1(spark, sf_dir):
    """Share of ordered pairs of regions (here turns) that a predicted order (here by length) keeps; both orders hold the same regions."""
    n = F.length(F.coalesce("text", F.lit("")))
    turns = derived.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda t: t.turn).alias(a) for a, by in (("ref", ["turn"]), ("hyp", [n.alias("n"), "turn"]))])
    counts = turns.select("conv_id", region_order("ref", "hyp").alias("o")).where("o.ref_pairs > 0")
    return counts.select("conv_id", F.col("o.ref_pairs").alias("pairs"), (F.col("o.common") / F.col("o.ref_pairs")).alias("order_f1"))


@register("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(coalesce(text, '')), turn) AS place FROM conversations WHERE turn % 5 <> 3),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (turn % 5 <> 3) AS m FROM conversations GROUP BY conv_id),
p AS (SELECT a.conv_id, count(*) FILTER (WHERE a.place < b.place) AS common FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY a.conv_id),
s AS (SELECT conv_id, n * (n - 1) // 2 AS ref_pairs, (m + 1) * m // 2 AS hyp_pairs, coalesce(common, 0) AS common FROM n LEFT JOIN p USING (conv_id))
SELECT conv_id, ref_pairs, hyp_pairs, common, CASE WHEN ref_pairs + hyp_pairs > 0 THEN 2.0 * common / (ref_pairs + hyp_pairs) ELSE 1.0 END AS f1 FROM s""")
def region_order_scores(spark, sf_dir):
    """F1 of ordered pairs where a predicted order (by length) misses some regions (turns) and has one that is none."""
    n = F.length(F.coalesce("text", F.lit("")))
    seen = F.when(F.col("turn") % 5 != 3, F.struct(n.alias("n"), "turn"))
    turns = derived.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("ref"), F.concat(F.transform(F.array_sort(F.collect_list(seen)), lambda t: t.turn), F.array(F.lit(-1))).alias("hyp"))
    counts = turns.select("conv_id", region_order("ref", "hyp").alias("o")).select("conv_id", "o.*")
    return counts.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("common"), F.col("ref_pairs") + F.col("hyp_pairs")), F.lit(1.0)))


@register(f"""WITH {METRICS_SQL}, e AS (SELECT engine, avg(cer) AS mean_cer, quantile_cont(cer, 0.5) AS median_cer FROM m GROUP BY engine), r AS (SELECT *, row_number() OVER (ORDER BY mean_cer, engine) AS k FROM e),
s AS (SELECT stratum, engine, avg(cer) AS cer, count(*) AS n FROM m GROUP BY ALL), sw AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY cer, engine) AS k, lead(cer) OVER (PARTITION BY stratum ORDER BY cer, engine) AS second FROM s),
f AS (SELECT 'global_leader' AS fact, 3 AS importance, engine, '' AS stratum, mean_cer AS value FROM r WHERE k = 1
 UNION ALL SELECT 'median_mean_gap', CASE WHEN abs(mean_cer - median_cer) / median_cer >= 1 THEN 3 ELSE 2 END, engine, '', abs(mean_cer - median_cer) / median_cer FROM e WHERE median_cer > 0 AND abs(mean_cer - median_cer) / median_cer >= 0.3
 UNION ALL SELECT 'stratum_winner', 2, engine, stratum, cer FROM sw WHERE k = 1 AND n >= 3 AND cer < 0.75 * second
 UNION ALL SELECT 'stratum_collapse', 3, s.engine, s.stratum, s.cer - e.mean_cer FROM s JOIN e USING (engine) WHERE s.cer > 2 * e.mean_cer AND s.cer - e.mean_cer > 0.05)
SELECT * FROM f ORDER BY importance DESC, fact, engine, stratum LIMIT 5""")
def facts_top5(spark, sf_dir):
    """The five weightiest findings of the rules: leader, skewed engines, winners and collapses by stratum."""
    m = derived.doc_metrics(spark, sf_dir).select("engine", "stratum", "cer").groupBy("engine", "stratum").agg(F.avg("cer").alias("cer"), F.count(F.lit(1)).alias("n"))
    e = report.aggregate(derived.doc_metrics(spark, sf_dir), "engine").select("engine", "mean_cer", "median_cer")
    fact = lambda df, name, importance, stratum, value: df.select(F.lit(name).alias("fact"), importance.alias("importance"), "engine", stratum.alias("stratum"), value.alias("value"))
    gap = F.abs(F.col("mean_cer") - F.col("median_cer")) / F.col("median_cer")
    leader = fact(e.orderBy("mean_cer", "engine").limit(1), "global_leader", F.lit(3), F.lit(""), F.col("mean_cer"))
    skewed = fact(e.where("median_cer > 0").where(gap >= 0.3), "median_mean_gap", F.when(gap >= 1, 3).otherwise(2), F.lit(""), gap)
    w = Window.partitionBy("stratum").orderBy("cer", "engine")
    winners = fact(m.withColumns({"k": F.row_number().over(w), "second": F.lead("cer").over(w)}).where("k = 1 AND n >= 3 AND cer < 0.75 * second"), "stratum_winner", F.lit(2), F.col("stratum"), F.col("cer"))
    collapse = fact(m.join(F.broadcast(e), "engine").where("cer > 2 * mean_cer AND cer - mean_cer > 0.05"), "stratum_collapse", F.lit(3), F.col("stratum"), F.col("cer") - F.col("mean_cer"))
    return leader.union(skewed).union(winners).union(collapse).orderBy(F.desc("importance"), "fact", "engine", "stratum").limit(5)


@register(f"""WITH {METRICS_SQL}, k AS (SELECT engine, cer, row_number() OVER (PARTITION BY engine ORDER BY cer DESC, doc_id) AS k, count(*) OVER (PARTITION BY engine) AS n FROM m WHERE cer IS NOT NULL)
SELECT engine, sum(cer) FILTER (WHERE k <= greatest(1, n // 5)) / sum(cer) AS share_of_worst_fifth FROM k GROUP BY engine HAVING sum(cer) > 0""")
def lever_concentration(spark, sf_dir):
    """The share of all error that the worst fifth of the documents holds."""
    return report.worst_share(derived.doc_metrics(spark, sf_dir))
