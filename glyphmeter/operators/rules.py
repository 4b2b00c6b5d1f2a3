"""Facts and levers: rules over small report tables, each a filter that gives rows (fact, importance, engines, stratum, value).

The report tables have a row for each engine, pair, stratum or error class; nothing here reads documents. importance is
1 (low), 2 (medium) or 3 (high).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

FACT = "fact string, importance int, engines array<string>, stratum string, value double"

# The order of facts of equal importance, and pairs of facts that may name the same engines.
ORDER = (
    "global_leader", "statistical_tie", "significant_gap", "stratum_winner", "stratification_recommended", "stratum_collapse", "error_profile_outlier", "hallucination", "robustness_fragile", "pareto_alternative",
    "speed_winner", "cost_outlier", "confidence_warning", "ensemble_opportunity", "median_mean_gap", "off_baseline", "unstable", "history_regression", "importer_fallback", "pricing_stale",
)
COMPLEMENTARY = {
    frozenset(p)
    for p in (
        ("global_leader", "significant_gap"), ("global_leader", "speed_winner"), ("global_leader", "confidence_warning"), ("statistical_tie", "speed_winner"), ("global_leader", "median_mean_gap"),
        ("global_leader", "stratification_recommended"), ("global_leader", "unstable"), ("global_leader", "history_regression"), ("off_baseline", "history_regression"),
    )
}


def fact(rows: DataFrame, name: str, importance: int | Column, value: Column, *engines: str, stratum: Column | None = None) -> DataFrame:
    level = importance if isinstance(importance, Column) else F.lit(importance)
    who = F.array(*[F.col(e) for e in engines]) if engines else F.array().cast("array<string>")
    return rows.select(F.lit(name).alias("fact"), level.cast("int").alias("importance"), F.array_sort(who).alias("engines"), (F.lit(None) if stratum is None else stratum).cast("string").alias("stratum"), value.cast("double").alias("value"))


def high_from(value: Column, bound: float) -> Column:
    return F.when(value >= bound, 3).otherwise(2)


def _top_two(engines: DataFrame) -> DataFrame:
    """leader, second and both scores, from engine and mean_cer; second is null if there is none."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("mean_cer", "engine"))), 1, 2)
    two = engines.where("mean_cer IS NOT NULL").agg(first.alias("t"))
    at = lambda k, c: F.try_element_at("t", F.lit(k))[c]
    return two.select(at(1, "engine").alias("leader"), at(1, "mean_cer").alias("leader_cer"), at(2, "engine").alias("second"), at(2, "mean_cer").alias("second_cer")).where("leader IS NOT NULL")


def global_leader(engines: DataFrame) -> DataFrame:
    return fact(_top_two(engines), "global_leader", 3, F.col("leader_cer"), "leader")


def statistical_ties(groups: DataFrame) -> DataFrame:
    """From tied groups (engines, holds_best): groups of two or more; high if the best engine is in it."""
    tied = groups.where(F.size("engines") >= 2)
    return tied.select(F.lit("statistical_tie").alias("fact"), F.when(F.col("holds_best"), 3).otherwise(2).alias("importance"), F.array_sort("engines").alias("engines"), F.lit(None).cast("string").alias("stratum"), F.size("engines").cast("double").alias("value"))


def significant_gap(engines: DataFrame, tests: DataFrame, level: float = 0.05) -> DataFrame:
    """From pairs (engine_a, engine_b, p_value): the two best engines if they differ."""
    two = _top_two(engines)
    same = (F.least("leader", "second") == F.least("engine_a", "engine_b")) & (F.greatest("leader", "second") == F.greatest("engine_a", "engine_b"))
    return fact(two.join(tests, same).where(F.col("p_value") < level), "significant_gap", 3, F.col("second_cer") - F.col("leader_cer"), "leader", "second")


def speed_winner(engines: DataFrame, groups: DataFrame) -> DataFrame:
    """From engine, mean_cer and seconds: an engine three times as fast as the median and nearly as good as the leader, or tied with it."""
    two = _top_two(engines)
    median = engines.where("seconds IS NOT NULL").agg(F.percentile("seconds", 0.5).alias("median"))
    tied = groups.where("holds_best").select(F.explode("engines").alias("engine")).distinct().withColumn("tied", F.lit(True))
    good = (F.col("mean_cer") <= F.greatest(F.lit(0.01), 1.1 * F.col("leader_cer"))) | F.coalesce("tied", F.lit(False))
    fast = engines.join(tied, "engine", "left").join(two).join(median).where((3 * F.col("seconds") <= F.col("median")) & good)
    return fact(fast.orderBy("seconds", "engine").limit(1), "speed_winner", 2, F.col("seconds"), "engine")


def median_mean_gap(engines: DataFrame, least: float = 0.30) -> DataFrame:
    gap = F.abs(F.col("mean_cer") - F.col("median_cer")) / F.col("median_cer")
    return fact(engines.where("median_cer > 0").where(gap >= least), "median_mean_gap", high_from(gap, 1.0), gap, "engine")


def stratum_rules(strata: DataFrame, engines: DataFrame, least: int = 3) -> DataFrame:
    """From stratum, engine, mean_cer, documents: engines that win a stratum by a quarter, and those that fail in one alone."""
    enough = strata.where((F.col("documents") >= least) & F.col("stratum").isNotNull())
    w = Window.partitionBy("stratum").orderBy("mean_cer", "engine")
    ranked = enough.withColumns({"k": F.row_number().over(w), "next": F.lead("mean_cer").over(w)})
    won = fact(ranked.where((F.col("k") == 1) & (F.col("mean_cer") < 0.75 * F.col("next"))), "stratum_winner", 3, F.col("mean_cer"), "engine", stratum=F.col("stratum"))
    whole = engines.where("mean_cer > 0").select("engine", F.col("mean_cer").alias("whole"))
    fell = enough.join(whole, "engine").where((F.col("mean_cer") > 2 * F.col("whole")) & (F.col("mean_cer") - F.col("whole") > 0.05))
    return won.union(fact(fell, "stratum_collapse", 3, F.col("mean_cer"), "engine", stratum=F.col("stratum")))


def stratification(strata: DataFrame, engines: DataFrame) -> DataFrame:
    """The leader's medians (stratum, engine, median_cer) lie five points apart or more."""
    own = strata.join(_top_two(engines).select(F.col("leader").alias("engine")), "engine")
    gap = own.groupBy("engine").agg((F.max("median_cer") - F.min("median_cer")).alias("gap"))
    return fact(gap.where("gap >= 0.05"), "stratification_recommended", high_from(F.col("gap"), 0.10), F.col("gap"), "engine")


def error_profile(classes: DataFrame) -> DataFrame:
    """From engine, class, share: a class of 15 percent or more that is twice the median over engines; absent classes are 0."""
    engines, names = classes.select("engine").distinct(), classes.select("class").distinct()
    full = engines.join(names).join(classes, ["engine", "class"], "left").select("engine", "class", F.coalesce("share", F.lit(0.0)).alias("share"))
    both = full.join(full.groupBy("class").agg(F.percentile("share", 0.5).alias("median"), F.count(F.lit(1)).alias("n")), "class")
    out = both.where("n >= 2 AND median > 0 AND share >= 0.15 AND share >= 2 * median")
    return fact(out, "error_profile_outlier", 3, F.col("share"), "engine", stratum=F.col("class"))


def hallucination_flags(report: DataFrame) -> DataFrame:
    """From engine, is_model, flagged, anchor, length_ratio: language models whose output is not anchored in the text."""
    bad = (F.col("flagged") > 0.30) | (F.col("anchor") < 0.60) | (F.col("length_ratio") > 1.30)
    return fact(report.where(F.col("is_model") & bad), "hallucination", 3, F.col("flagged"), "engine")


def fragile(curves: DataFrame) -> DataFrame:
    """From engine, type, level, cer: curves that end three times as high as they begin, and above 15 percent."""
    ends = curves.groupBy("engine", "type").agg(F.min_by("cer", "level").alias("first"), F.max_by("cer", "level").alias("last"))
    return fact(ends.where("first > 0.01 AND last >= 3 * first AND last > 0.15"), "robustness_fragile", 3, F.col("last"), "engine", stratum=F.col("type"))


def confidence(engines: DataFrame) -> DataFrame:
    """From engine, mean_cer, low, high: of the two best the first whose interval is wide against their gap, or above five points."""
    two = _top_two(engines).where("second IS NOT NULL")
    gap = F.abs(F.col("second_cer") - F.col("leader_cer"))
    wide = engines.join(two, F.col("engine").isin(F.col("leader"), F.col("second"))).where("low IS NOT NULL AND high IS NOT NULL").withColumn("width", F.col("high") - F.col("low"))
    wide = wide.where(((gap > 0) & (F.col("width") > 3 * gap)) | (F.col("width") > 0.05))
    return fact(wide.orderBy((F.col("engine") != F.col("leader")).cast("int")).limit(1), "confidence_warning", 2, F.col("width"), "engine")


def cost_rules(engines: DataFrame, front: DataFrame) -> DataFrame:
    """From engine, mean_cer, cost and the front's engines: a cheaper member of the front than the leader, and costs of five times the median off it."""
    two = _top_two(engines)
    leader = engines.join(two, F.col("engine") == F.col("leader")).select("leader", F.col("cost").alias("leader_cost"))
    cheap = engines.join(front.select("engine"), "engine").join(leader, F.col("engine") != F.col("leader")).where("cost < leader_cost").orderBy("cost", "engine").limit(1)
    median = engines.where("cost IS NOT NULL").agg(F.percentile("cost", 0.5).alias("median"), F.count(F.lit(1)).alias("n")).where("n >= 3 AND median > 0")
    dear = engines.join(front.select("engine"), "engine", "left_anti").join(median).where("cost >= 5 * median")
    return fact(cheap, "pareto_alternative", 2, F.col("cost"), "engine").union(fact(dear, "cost_outlier", 2, F.col("cost"), "engine"))


def pricing_stale(prices: DataFrame, today: Column) -> DataFrame:
    """From valid_until: one fact if any price is out of date on the day given."""
    late = prices.agg(F.min("valid_until").alias("valid_until")).where(today > F.col("valid_until"))
    return fact(late, "pricing_stale", 2, F.datediff(today, F.col("valid_until")))


def ensemble_opportunity(gaps: DataFrame) -> DataFrame:
    """From best_engine and relative_gap."""
    return fact(gaps.where("relative_gap >= 0.25"), "ensemble_opportunity", high_from(F.col("relative_gap"), 0.5), F.col("relative_gap"), "best_engine")


def off_baseline(baselines: DataFrame) -> DataFrame:
    """From engine, relative_delta, off_baseline."""
    return fact(baselines.where("off_baseline AND relative_delta IS NOT NULL"), "off_baseline", high_from(F.abs("relative_delta"), 0.5), F.col("relative_delta"), "engine")


def unstable(runs: DataFrame) -> DataFrame:
    """From engine, runs, cer_cv, identical_rate: repeated runs that differ."""
    return fact(runs.where("runs >= 2 AND (cer_cv > 0.10 OR identical_rate < 0.50)"), "unstable", 3, F.col("cer_cv"), "engine")


def history_regressions(trends: DataFrame) -> DataFrame:
    """From engine, runs, slope (a day), change, delta: three runs or more that get worse by a point a year or at a change."""
    worse = trends.where("runs >= 3").where((F.col("slope") > 0.01 / 365) | (F.col("change") > 0.01))
    return fact(worse, "history_regression", high_from(F.abs("delta"), 0.05), F.col("delta"), "engine")


def importer_fallbacks(events: DataFrame) -> DataFrame:
    """From importer, operation: an incident each; high for an importer with two or more."""
    n = F.count(F.lit(1)).over(Window.partitionBy("importer"))
    rows = events.select(F.coalesce("importer", F.lit("unknown")).alias("importer"), "operation").withColumn("n", n)
    return fact(rows, "importer_fallback", F.when(F.col("n") >= 2, 3).otherwise(2), F.col("n"), stratum=F.concat_ws(":", "importer", "operation"))


# --- levers -----------------------------------------------------------------------------------------------------


def recoverable_share(levels: DataFrame) -> DataFrame:
    """From engine, level, share: 30 percent or more of the errors can be undone by rules."""
    rows = levels.where("level = 'recoverable' AND share >= 0.30")
    return fact(rows, "recoverable_class", high_from(F.col("share"), 0.50), F.col("share"), "engine")


def concentration(shares: DataFrame, engines: DataFrame) -> DataFrame:
    """From engine and share_of_worst_fifth: half of the leader's error or more lies in a fifth of its documents."""
    own = shares.join(_top_two(engines).select(F.col("leader").alias("engine")), "engine").where("share_of_worst_fifth >= 0.50")
    return fact(own, "pareto_concentration", high_from(F.col("share_of_worst_fifth"), 0.75), F.col("share_of_worst_fifth"), "engine")


def complementarity(gaps: DataFrame) -> DataFrame:
    return fact(gaps.where("relative_gap >= 0.20"), "complementarity", high_from(F.col("relative_gap"), 0.5), F.col("relative_gap"), "best_engine")


def modernised_words(words: DataFrame, each: int = 3) -> DataFrame:
    """From engine, token, total, rate: an engine's words that are changed half of the time or more, the top ones as one lever."""
    w = Window.partitionBy("engine").orderBy(F.desc("rate"), F.desc("total"), "token")
    top = words.where("total >= 3 AND rate >= 0.50").withColumn("k", F.row_number().over(w)).where(F.col("k") <= each)
    rows = top.groupBy("engine").agg(F.max("rate").alias("rate"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda x: x.token), " ").alias("tokens"))
    return fact(rows, "lexical_modernisation", high_from(F.col("rate"), 0.90), F.col("rate"), "engine", stratum=F.col("tokens"))


def projected_deficit(deficits: DataFrame) -> DataFrame:
    """From engine and deficit (over all degradations): two points of error or more."""
    return fact(deficits.where("deficit >= 0.02"), "projected_deficit", high_from(F.col("deficit"), 0.05), F.col("deficit"), "engine")


# --- selection --------------------------------------------------------------------------------------------------


def union(*facts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, facts)


def without_contradictions(facts: DataFrame) -> DataFrame:
    """Without significant gaps between engines that a tie holds together."""
    ties = facts.where("fact = 'statistical_tie'").select(F.col("engines").alias("tied"))
    inside = (F.col("fact") == "significant_gap") & (F.size(F.array_except("engines", "tied")) == 0)
    return facts.join(ties, inside, "left_anti")


def _says_again(new: str, old: str) -> Column:
    """Whether a fact repeats another one of the same engines: a like fact of one stratum, or any that does not complement it."""
    n, o = (lambda c: F.col(f"{new}.{c}")), (lambda c: F.col(f"{old}.{c}"))
    pair = F.array_join(F.array_sort(F.array(n("fact"), o("fact"))), "+")
    complements = pair.isin(["+".join(sorted(p)) for p in COMPLEMENTARY])
    return (n("who") == o("who")) & ((n("fact") == o("fact")) & n("stratum").eqNullSafe(o("stratum")) | ~complements)


def selected(facts: DataFrame, most: int = 5, least: int = 2) -> DataFrame:
    """The weightiest facts, in order (position from 1), none repeating what one before it says of the same engines.

    Each round takes the first fact that is left and drops those that repeat it; facts of other engines never meet.
    """
    order = F.create_map(*[F.lit(x) for k, name in enumerate(ORDER) for x in (name, k)])
    kept = without_contradictions(facts.where(F.col("importance") >= least))
    w = Window.orderBy(F.desc("importance"), F.coalesce(F.try_element_at(order, F.col("fact")), F.lit(len(ORDER))), "engines", F.coalesce("stratum", F.lit("")), "value")
    names = [c.split()[0] for c in FACT.split(", ")]
    left = checkpointed(kept.withColumn("place", F.row_number().over(w)).withColumn("who", F.array_sort(F.array_distinct("engines"))))
    chosen = None
    for _ in range(most):
        first = left.orderBy("place").limit(1)
        chosen = first if chosen is None else chosen.unionByName(first)
        rest = left.alias("n").join(first.alias("o"), (F.col("n.place") == F.col("o.place")) | _says_again("n", "o"), "left_anti")
        left = checkpointed(rest)
    return chosen.select(*names, F.row_number().over(Window.orderBy("place")).alias("position"))
