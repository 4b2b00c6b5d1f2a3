"""Reports on classes of errors: counts, heat map, roll-up by recoverability, clusters, over-normalisation, word variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import character_confusions
from ..functions.errors import CLASSES, RECOVERABILITY, error_places, error_taxonomy, invented, over_normalised, word_variants


def taxonomy(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, class, n and its share of the key's errors; classes without errors have no row."""
    wrong = lines.where(F.col("gt_line") != F.col("hyp_line")).select(*keys, error_taxonomy("gt_line", "hyp_line").alias("t"))
    sums = wrong.groupBy(*keys).agg(*[F.sum(f"t.{c}").alias(c) for c in CLASSES])
    rows = sums.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in CLASSES]))).where("n > 0")
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 4))


def recoverability(counts: DataFrame, key: str) -> DataFrame:
    """key, level, n, share: errors by how far rules can undo them; counts has key, class and n."""
    level = F.create_map(*[F.lit(x) for kv in RECOVERABILITY.items() for x in kv])
    sums = counts.groupBy(key, F.coalesce(F.try_element_at(level, F.col("class")), F.lit("partial")).alias("level")).agg(F.sum("n").alias("n"))
    return sums.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def heat_map(lines: DataFrame, key: str, bins: int = 10) -> DataFrame:
    """key, class, bin, n: errors by their place in the text, in equal parts of its words."""
    places = lines.where(F.col("gt_line") != F.col("hyp_line")).select(key, F.inline(error_places("gt_line", "hyp_line")))
    return places.groupBy(key, "class", F.least(F.floor(F.col("place") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def clusters(lines: DataFrame, key: str, most: int = 8) -> DataFrame:
    """key, label, n: character errors by pattern; the commonest labels, and all other errors as one.

    Patterns are tried in order: case, marks, digits, white space and punctuation; other single errors are their own pair.
    """
    differ = lines.where(F.col("gt_line") != F.col("hyp_line")).select(key, F.explode(character_confusions("gt_line", "hyp_line")).alias("p"))
    g, o = F.col("p.g"), F.col("p.o")
    label = (
        F.when(F.lower(g) == F.lower(o), "case").when((g == "") | (o == ""), F.when(g == "", "added").otherwise("lost")).when(F.regexp_like(g, F.lit(r"\p{Nd}")) | F.regexp_like(o, F.lit(r"\p{Nd}")), "digit")
        .when(F.regexp_like(g, F.lit(r"\p{P}")) | F.regexp_like(o, F.lit(r"\p{P}")), "punctuation").otherwise(F.concat(g, F.lit("→"), o))
    )
    counts = differ.groupBy(key, label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "label")
    return counts.withColumn("k", F.row_number().over(w)).groupBy(key, F.when(F.col("k") < most, F.col("label")).otherwise("other").alias("label")).agg(F.sum("n").alias("n"))


def over_normalisation(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, right, spoilt, score from texts with gt, before and after: sums over sums; null without a right word."""
    found = texts.select(*keys, over_normalised("gt", "before", "after").alias("o"))
    sums = found.groupBy(*keys).agg(F.sum("o.right").alias("right"), F.sum("o.spoilt").alias("spoilt"))
    return sums.withColumn("score", F.try_divide("spoilt", "right"))


def modernisation(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, token, total, changed, rate, variants: every word that is ever changed and what stands for it."""
    words = lines.select(*keys, F.inline(word_variants("gt_line", "hyp_line")))
    each = words.groupBy(*keys, "token", "variant").agg(F.count(F.lit(1)).alias("n"))
    rows = each.groupBy(*keys, "token").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("variant").isNotNull(), F.col("n"))), F.lit(0)).alias("changed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("variant").isNotNull(), F.struct("variant", "n"))))).alias("variants"),
    )
    return rows.where("changed > 0").withColumn("rate", F.col("changed") / F.col("total"))


def top_modernised(rows: DataFrame, key: str, each: int = 20, least: int = 1) -> DataFrame:
    """The words of each key that are changed most often; rarer ones than least are left out."""
    w = Window.partitionBy(key).orderBy(F.desc("rate"), F.desc("total"), "token")
    return rows.where(F.col("total") >= least).withColumn("position", F.row_number().over(w)).where(F.col("position") <= each)


def hallucination(pairs: DataFrame) -> DataFrame:
    """engine, doc_id, gt_words, hyp_words, unknown, net_insertion, anchor, length_ratio, blocks, block_words, flagged of every pair."""
    rows = pairs.select("engine", "doc_id", invented("gt", "hyp").alias("i")).select("engine", "doc_id", "i.*")
    inside = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda s, b: s + b["last"] - b["first"] + 1)
    return rows.select("engine", "doc_id", "gt_words", "hyp_words", "unknown", F.coalesce(F.try_divide("unknown", "hyp_words"), F.lit(0.0)).alias("net_insertion"), "anchor", "length_ratio", F.size("blocks").cast("bigint").alias("blocks"), inside.alias("block_words"), "flagged")


def hallucination_report(rows: DataFrame) -> DataFrame:
    """By engine: means, the smallest anchor, the share of flagged documents and all blocks."""
    mean: list[Column] = [F.avg(c).alias(c) for c in ("net_insertion", "anchor", "length_ratio")]
    return rows.groupBy("engine").agg(*mean, F.min("anchor").alias("min_anchor"), F.avg(F.col("flagged").cast("int")).alias("flagged"), F.sum("blocks").alias("blocks"), F.count(F.lit(1)).alias("documents"))


def comparison(counts: DataFrame, a: str, b: str) -> DataFrame:
    """class, level, n_a, n_b, share_a, share_b, delta of two engines' classes (engine, class, n); a class that one lacks counts 0."""
    side = lambda e, x: counts.where(F.col("engine") == e).select("class", F.col("n").alias(f"n_{x}"), (F.col("n") / F.sum("n").over(Window.partitionBy("engine"))).alias(f"share_{x}"))
    both = side(a, "a").join(side(b, "b"), "class", "full_outer").na.fill(0)
    level = F.create_map(*[F.lit(x) for kv in RECOVERABILITY.items() for x in kv])
    return both.select("class", F.coalesce(F.try_element_at(level, F.col("class")), F.lit("partial")).alias("level"), "n_a", "n_b", "share_a", "share_b", (F.col("share_b") - F.col("share_a")).alias("delta"))
