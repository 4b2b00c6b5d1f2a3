"""Queries on error classes, corrections, fuzzy search, invented text, entities and layout.

Their kernels choose edit scripts or match greedily, which SQL has not; tests compare them with plain versions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.errors import fuzzy_recall
from ..functions.matching import REGION, SPAN, entity_counts, region_counts
from ..operators import errors, stats
from ..sources import derived
from ..sources.shared import checkpointed
from .registry import register


def _lines(spark, sf_dir):
    """Lines of the engines that err in many ways; their distance is not measured, as nothing asks for it."""
    return derived.split_lines(derived.varied(spark, sf_dir))


@register()
def error_taxonomy(spark, sf_dir):
    """Errors of every engine in nine classes."""
    return errors.taxonomy(_lines(spark, sf_dir), "engine")


@register()
def document_error_taxonomy(spark, sf_dir):
    return errors.taxonomy(_lines(spark, sf_dir), "engine", "doc_id")


@register()
def error_recoverability(spark, sf_dir):
    """Errors of every engine by how far rules can undo them."""
    return errors.recoverability(errors.taxonomy(_lines(spark, sf_dir), "engine"), "engine")


@register()
def error_heat_map(spark, sf_dir):
    """Error classes by their place in the text."""
    return errors.heat_map(_lines(spark, sf_dir), "engine")


@register()
def error_clusters(spark, sf_dir):
    """A report of the commonest patterns of character errors, all others as one."""
    return errors.clusters(_lines(spark, sf_dir), "engine")


@register()
def error_class_kl(spark, sf_dir):
    """Kullback-Leibler divergence of the engines' error classes."""
    return stats.kl_divergence(checkpointed(errors.taxonomy(_lines(spark, sf_dir), "engine").select("engine", "class", "n")), "engine", "class", "n")


def _corrected(spark, sf_dir):
    """What an engine reads, and what two correction steps make of it."""
    rows = derived.load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("gt"))
    rows = derived.spread(rows).withColumn("before", F.translate("gt", "v", "u"))
    steps = F.array(F.struct(F.lit("lower_case").alias("engine"), F.lower("before").alias("after")), F.struct(F.lit("plain_letters").alias("engine"), F.translate("before", derived.ACCENTED, derived.PLAIN).alias("after")))
    parts = rows.select("doc_id", "gt", "before", F.explode(steps).alias("s")).select("doc_id", "gt", "before", "s.*")
    z = F.arrays_zip(F.split("gt", "\n").alias("gt"), F.split("before", "\n").alias("before"), F.split("after", "\n").alias("after"))
    return parts.select("engine", "doc_id", F.explode(z).alias("z")).select("engine", "doc_id", "z.*")


@register()
def over_normalisation(spark, sf_dir):
    """Words that a correction step spoils though they were read right."""
    return errors.over_normalisation(_corrected(spark, sf_dir), "engine")


@register()
def document_over_normalisation(spark, sf_dir):
    return errors.over_normalisation(_corrected(spark, sf_dir), "engine", "doc_id")


@register()
def lexical_modernisation(spark, sf_dir):
    """Every word that an engine ever changes, how often and into what."""
    return errors.modernisation(_lines(spark, sf_dir), "engine").withColumn("variants", F.to_json("variants"))


@register()
def top_modernised_words(spark, sf_dir):
    """A report of the twenty words of each engine that are changed most often, of those seen three times or more."""
    return errors.top_modernised(errors.modernisation(_lines(spark, sf_dir), "engine"), "engine", least=3).select("engine", "position", "token", "total", "changed", "rate")


def _fuzzy(spark, sf_dir):
    return derived.varied(spark, sf_dir).select("engine", "doc_id", fuzzy_recall()("gt", "hyp").alias("f")).select("engine", "doc_id", "f.*")


@register()
def fuzzy_search_recall(spark, sf_dir):
    """Share of ground-truth words that a search within two edits finds, over all documents of an engine."""
    return _fuzzy(spark, sf_dir).groupBy("engine").agg(F.sum("words").alias("words"), F.sum("found").alias("found")).withColumn("recall", F.try_divide("found", "words"))


@register()
def document_fuzzy_recall(spark, sf_dir):
    """The same by document, with the words that are missed; null without a word."""
    return _fuzzy(spark, sf_dir).select("engine", "doc_id", "words", "found", F.try_divide("found", "words").alias("recall"), F.array_join("missed", " ").alias("missed"))


_TRIPLES = "CASE WHEN len({0}) >= 3 THEN list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1] || ' ' || {0}[i + 2]) WHEN len({0}) > 0 THEN [array_to_string({0}, ' ')] ELSE [] END"
_WORDS = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> '')"
_BARE = r"length(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
_INVENTED_SQL = f"""WITH {derived.OUTPUTS_SQL.replace(derived.MASKED_SQL, derived.WHOLE_SQL)},
w AS (SELECT engine, doc_id, {_WORDS.format("gt")} AS g, {_WORDS.format("hyp")} AS h, {_BARE.format("gt")} AS a, {_BARE.format("hyp")} AS b FROM outputs),
t AS (SELECT *, list_distinct(g) AS known, list_distinct({_TRIPLES.format("g")}) AS own, {_TRIPLES.format("h")} AS triples FROM w),
p AS MATERIALIZED (SELECT *, list_filter(range(1, len(h) + 1), lambda i: NOT list_contains(known, h[i])) AS pos, len(list_filter(triples, lambda x: list_contains(own, x))) AS held FROM t),
e AS (SELECT *, list_filter(range(1, len(pos) + 1), lambda i: i = 1 OR pos[i] - pos[i - 1] > 3) AS s, list_filter(range(1, len(pos) + 1), lambda i: i = len(pos) OR pos[i + 1] - pos[i] > 3) AS l FROM p),
k AS (SELECT *, list_filter([CASE WHEN i = len(s) AND len(h) - pos[l[i]] < 3 THEN len(h) ELSE pos[l[i]] END - pos[s[i]] + 1 for i in range(1, len(s) + 1)], lambda n: n >= 4) AS runs FROM e),
d AS (SELECT engine, doc_id, len(g) AS gt_words, len(h) AS hyp_words, len(pos) AS unknown, CASE WHEN len(h) > 0 THEN len(pos) / len(h) ELSE 0.0 END AS net_insertion,
  CASE WHEN len(triples) > 0 AND len(own) > 0 THEN held / len(triples) WHEN len(triples) = 0 AND len(own) = 0 THEN 1.0 ELSE 0.0 END AS anchor,
  least(9.99, CASE WHEN a > 0 THEN b / a WHEN b > 0 THEN 9.99 ELSE 1.0 END) AS length_ratio, len(runs) AS blocks, CAST(coalesce(list_sum(runs), 0) AS BIGINT) AS block_words FROM k)"""


@register(f"{_INVENTED_SQL} SELECT *, anchor < 0.5 OR length_ratio > 1.2 AS flagged FROM d")
def hallucination_documents(spark, sf_dir):
    """Invented text in every output, empty ones and outputs of empty texts included."""
    return errors.hallucination(derived.as_written(derived.outputs, "outputs")(spark, sf_dir))


@register(f"""{_INVENTED_SQL} SELECT engine, avg(net_insertion) AS net_insertion, avg(anchor) AS anchor, avg(length_ratio) AS length_ratio, min(anchor) AS min_anchor, avg(CAST(anchor < 0.5 OR length_ratio > 1.2 AS INTEGER)) AS flagged, CAST(sum(blocks) AS BIGINT) AS blocks, count(*) AS documents FROM d GROUP BY engine""")
def hallucination_report(spark, sf_dir):
    return errors.hallucination_report(hallucination_documents(spark, sf_dir))


def _spans(spark, sf_dir):
    """Entities: every line's extent under one of three labels; found ones are moved, some are lost and some added."""
    docs = derived.spread(derived.load(spark, sf_dir, "documents")).select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x).cast("bigint")).alias("n"))
    at = F.transform(F.sequence(F.lit(1), F.size("n")), lambda i: F.aggregate(F.slice("n", F.lit(1), i - 1), F.lit(0).cast("bigint"), lambda s, x: s + x + 1))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip("n", at.alias("at")))).select("doc_id", F.col("pos").alias("i"), "col.n", "col.at").where("n > 0")
    label = F.element_at(F.array(F.lit("person"), F.lit("Place"), F.lit("date")), (F.col("i") % 3 + 1).cast("int"))
    move = (F.col("n") * ((F.col("doc_id") + F.col("i")) % 5) / 8).cast("bigint")
    ref = F.struct(label.alias("label"), F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"))
    hyp = F.struct(F.upper(label).alias("label"), (F.col("at") + move).alias("start"), (F.col("at") + move + F.col("n")).alias("end"))
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(ref)).alias("refs"), F.sort_array(F.collect_list(F.when((F.col("doc_id") + F.col("i")) % 7 != 0, hyp))).alias("hyps"))


def _scores(rows, label):
    """Precision, recall and F1 of each label and of all."""
    sums = rows.select(F.inline("c")).rollup("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, a + b), F.lit(0.0))
    out = sums.select(F.coalesce("label", F.lit("*")).alias(label), "tp", "fp", "fn", share(F.col("tp"), F.col("fp")).alias("precision"), share(F.col("tp"), F.col("fn")).alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


@register()
def entity_scores(spark, sf_dir):
    """Precision, recall and F1 of entities by label, matched one to one by overlap."""
    spans = _spans(spark, sf_dir).select(F.col("refs").cast(SPAN).alias("refs"), F.col("hyps").cast(SPAN).alias("hyps"))
    return _scores(spans.select(entity_counts()("refs", "hyps").alias("c")), "label")


@register()
def layout_scores(spark, sf_dir):
    """The same for regions of a page: one for every line, moved down or lost."""
    box = lambda s, down: F.struct(F.lower(s.label).alias("type"), F.lit(0.0).alias("x"), (s.start + down).cast("double").alias("y"), F.lit(100.0).alias("w"), (s.end - s.start).cast("double").alias("h"))
    pages = _spans(spark, sf_dir).select(F.transform("refs", lambda s: box(s, 0)).cast(REGION).alias("refs"), F.transform("hyps", lambda s: box(s, 1)).cast(REGION).alias("hyps"))
    return _scores(pages.select(region_counts()("refs", "hyps").alias("c")), "type")
