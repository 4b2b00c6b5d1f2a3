"""Chances of rank tests, tied groups, and the firing of every rule, against known values and plain versions."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from glyphmeter.functions import tails
from glyphmeter.operators import rules, stats
from glyphmeter.plans import registry

SF_DIR = "/root/testdata/sf0.001"
registry.load_all()


def test_tails_against_known_values(spark):
    assert tails.gamma_tail(0.5, 3.841458821 / 2) == pytest.approx(0.05, rel=1e-8)
    assert tails.gamma_tail(5, 18.307038053 / 2) == pytest.approx(0.05, rel=1e-8)
    for df, x in itertools.product((2, 4, 10), (0.1, 1.0, 5.0, 40.0)):  # even degrees have a closed form
        want = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))
        assert tails.gamma_tail(df / 2, x / 2) == pytest.approx(want, rel=1e-10)
    # F with 2 and d degrees: (1 + 2 f / d) ** (-d / 2)
    for d, f in itertools.product((1, 5, 30, 3000), (0.2, 1.0, 4.0)):
        assert tails.beta_share(d / 2, 1, d / (d + 2 * f)) == pytest.approx((1 + 2 * f / d) ** (-d / 2), rel=1e-9)
    assert tails.beta_share(5, 1.5, 10 / (10 + 3 * 3.708265)) == pytest.approx(0.05, rel=1e-5)
    z = spark.range(1).select(tails.normal_tail(F.lit(1.959963985)).alias("a"), tails.normal_tail(F.lit(-1.0)).alias("b")).first()
    assert z.a == pytest.approx(0.025, abs=1e-7) and z.b == pytest.approx(0.8413447, abs=1e-6)


def test_exact_signed_ranks():
    for n in (1, 4, 7):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert tails.signed_rank_tail(n, w) == min(1.0, 2 * sum(s <= w for s in sums) / 2**n)


def scores(spark, table):
    rows = [(d, e, float(v)) for e, values in table.items() for d, v in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id int, engine string, cer double")


def test_wilcoxon_tests(spark):
    few = {"a": [1, 2, 3, 4, 5, 6], "b": [2, 4, 6, 8, 10, 12], "c": [1, 2, 3, 4, 5, 6]}
    got = {(r.engine_a, r.engine_b): r for r in stats.wilcoxon_tests(scores(spark, few)).collect()}
    assert ("a", "c") not in got  # no difference at all
    assert got["a", "b"].exact and got["a", "b"].p_value == pytest.approx(2 / 64) and got["a", "b"].statistic == 0 and got["a", "b"].significant
    many = {"a": [k % 7 for k in range(40)], "b": [(k * 3) % 7 + (k % 3 == 0) for k in range(40)]}
    r = stats.wilcoxon_tests(scores(spark, many)).first()
    d = [a - b for a, b in zip(many["a"], many["b"], strict=True) if a != b]
    order = sorted(map(abs, d))
    rank = lambda x: order.index(x) + (order.count(x) + 1) / 2
    w = min(sum(rank(abs(x)) for x in d if x > 0), sum(rank(abs(x)) for x in d if x < 0))
    n, ties = len(d), sum(order.count(x) ** 3 - order.count(x) for x in set(order))
    z = max(0, abs(w - n * (n + 1) / 4) - 0.5) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    assert not r.exact and (r.n, r.statistic) == (n, w) and r.p_value == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


def test_friedman_and_groups(spark):
    table = {"a": [1, 1, 2, 1, 1], "b": [2, 2, 1, 2, 2], "c": [3, 3, 3, 3, 3], "d": [4, 4, 4, 4, 4]}
    ranks = stats.friedman(scores(spark, table), 4)
    r = stats.friedman_test(ranks, 4).first()
    q = 12 / (5 * 4 * 5) * sum(x * x for x in (6, 9, 15, 20)) - 3 * 5 * 5
    assert r.chi_square == pytest.approx(q) and r.f == pytest.approx(4 * q / (15 - q)) and r.significant
    assert r.p_value == pytest.approx(tails.gamma_tail(1.5, q / 2))
    groups = [tuple(x) for x in stats.tied_groups(ranks, 4).orderBy("place").collect()]
    assert groups == [(1, ["a", "b", "c"], True), (2, ["d"], False)]
    assert stats.nemenyi_q(22) == pytest.approx(3.544 + 0.4 * (3.658 - 3.544)) and stats.nemenyi_q(60) == pytest.approx(3.945 + 0.087) and stats.nemenyi_q(4) == 2.569
    nothing = stats.friedman(scores(spark, {"a": [], "b": []}), 2)
    assert stats.tied_groups(nothing, 2).count() == 0 and stats.friedman_test(nothing, 2).count() == 0


def test_kl(spark):
    counts = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 2), ("b", "y", 2), ("c", "z", 1)], "e string, k string, n int")
    got = {(r.e_a, r.e_b): r.kl for r in stats.kl_divergence(counts, "e", "k", "n").collect()}
    assert got["a", "b"] == pytest.approx(0.25 * math.log2(0.5) + 0.75 * math.log2(1.5)) and len(got) == 6 and got["a", "c"] > 20


ENGINES = "engine string, mean_cer double, median_cer double, seconds double, cost double, low double, high double"


@pytest.fixture(scope="module")
def engines(spark):
    rows = [("a", 0.050, 0.03, 10.0, 9.0, 0.049, 0.051), ("b", 0.051, 0.05, 1.0, 1.0, 0.02, 0.09), ("c", 0.2, 0.19, 12.0, 50.0, 0.19, 0.21), ("d", 0.3, 0.0, 11.0, 2.0, None, None), ("e", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ENGINES)


def found(frame):
    return [(r.fact, r.importance, tuple(r.engines), r.stratum) for r in frame.collect()]


def test_rules_on_engines(spark, engines):
    groups = spark.createDataFrame([(["a", "b"], True), (["c"], False), (["d", "x"], False)], "engines array<string>, holds_best boolean")
    assert found(rules.global_leader(engines)) == [("global_leader", 3, ("a",), None)]
    assert found(rules.statistical_ties(groups)) == [("statistical_tie", 3, ("a", "b"), None), ("statistical_tie", 2, ("d", "x"), None)]
    tests = spark.createDataFrame([("b", "a", 0.01), ("a", "c", 0.2)], "engine_a string, engine_b string, p_value double")
    assert found(rules.significant_gap(engines, tests)) == [("significant_gap", 3, ("a", "b"), None)]
    assert found(rules.significant_gap(engines, tests.where("p_value > 0.1"))) == []
    assert found(rules.speed_winner(engines, groups)) == [("speed_winner", 2, ("b",), None)]
    assert found(rules.median_mean_gap(engines)) == [("median_mean_gap", 2, ("a",), None)]
    assert found(rules.confidence(engines)) == [("confidence_warning", 2, ("b",), None)]
    front = spark.createDataFrame([("a",), ("b",)], "engine string")
    assert found(rules.cost_rules(engines, front)) == [("pareto_alternative", 2, ("b",), None), ("cost_outlier", 2, ("c",), None)]
    nobody = engines.limit(0)
    for rule in (rules.global_leader, rules.median_mean_gap, rules.confidence):
        assert found(rule(nobody)) == []


def test_rules_on_strata_and_classes(spark, engines):
    rows = [("fr", "a", 0.04, 0.01, 5), ("fr", "b", 0.06, 0.05, 5), ("de", "a", 0.16, 0.12, 5), ("de", "b", 0.01, 0.01, 2), (None, "a", 0.9, 0.9, 9)]
    strata = spark.createDataFrame(rows, "stratum string, engine string, mean_cer double, median_cer double, documents int")
    assert sorted(found(rules.stratum_rules(strata, engines))) == [("stratum_collapse", 3, ("a",), "de"), ("stratum_winner", 3, ("a",), "fr")]
    assert found(rules.stratification(strata.where("stratum IS NOT NULL"), engines)) == [("stratification_recommended", 3, ("a",), None)]
    shares = spark.createDataFrame([("a", "case", 0.6), ("a", "hapax", 0.4), ("b", "case", 0.2), ("b", "hapax", 0.8), ("c", "case", 0.2), ("c", "hapax", 0.8)], "engine string, class string, share double")
    assert found(rules.error_profile(shares)) == [("error_profile_outlier", 3, ("a",), "case")]
    curves = spark.createDataFrame([("a", "noise", 0.0, 0.05), ("a", "noise", 1.0, 0.2), ("b", "noise", 0.0, 0.005), ("b", "noise", 1.0, 0.9)], "engine string, type string, level double, cer double")
    assert found(rules.fragile(curves)) == [("robustness_fragile", 3, ("a",), "noise")]
    report = spark.createDataFrame([("m", True, 0.4, 0.9, 1.0), ("n", True, 0.1, 0.9, 1.0), ("o", False, 0.9, 0.1, 3.0)], "engine string, is_model boolean, flagged double, anchor double, length_ratio double")
    assert found(rules.hallucination_flags(report)) == [("hallucination", 3, ("m",), None)]


def test_rules_on_history_and_levers(spark, engines):
    gaps = spark.createDataFrame([("a", 0.3)], "best_engine string, relative_gap double")
    assert found(rules.ensemble_opportunity(gaps)) == [("ensemble_opportunity", 2, ("a",), None)] and found(rules.complementarity(gaps)) == [("complementarity", 2, ("a",), None)]
    base = spark.createDataFrame([("a", -0.6, True), ("b", 0.1, False)], "engine string, relative_delta double, off_baseline boolean")
    assert found(rules.off_baseline(base)) == [("off_baseline", 3, ("a",), None)]
    runs = spark.createDataFrame([("a", 3, 0.2, 0.9), ("b", 3, 0.0, 0.4), ("c", 1, 0.9, 0.0)], "engine string, runs int, cer_cv double, identical_rate double")
    assert sorted(found(rules.unstable(runs))) == [("unstable", 3, ("a",), None), ("unstable", 3, ("b",), None)]
    trends = spark.createDataFrame([("a", 9, 0.1, 0.0, 0.06), ("b", 9, 0.0, 0.02, 0.01), ("c", 2, 0.1, 0.1, 0.1), ("d", 9, 0.0, None, 0.0)], "engine string, runs int, slope double, change double, delta double")
    assert sorted(found(rules.history_regressions(trends))) == [("history_regression", 2, ("b",), None), ("history_regression", 3, ("a",), None)]
    falls = spark.createDataFrame([("iiif", "get"), ("iiif", "parse"), (None, "x")], "importer string, operation string")
    assert sorted(found(rules.importer_fallbacks(falls))) == [("importer_fallback", 2, (), "unknown:x"), ("importer_fallback", 3, (), "iiif:get"), ("importer_fallback", 3, (), "iiif:parse")]
    prices = spark.sql("SELECT DATE'2026-01-01' AS valid_until")
    assert len(found(rules.pricing_stale(prices, F.lit("2026-02-01").cast("date")))) == 1 and found(rules.pricing_stale(prices, F.lit("2025-02-01").cast("date"))) == []
    levels = spark.createDataFrame([("a", "recoverable", 0.55), ("b", "recoverable", 0.2)], "engine string, level string, share double")
    assert found(rules.recoverable_share(levels)) == [("recoverable_class", 3, ("a",), None)]
    shares = spark.createDataFrame([("a", 0.6), ("c", 0.9)], "engine string, share_of_worst_fifth double")
    assert found(rules.concentration(shares, engines)) == [("pareto_concentration", 2, ("a",), None)]
    words = spark.createDataFrame([("a", "x", 3, 0.6), ("a", "y", 9, 0.6), ("a", "z", 2, 1.0), ("b", "w", 5, 0.4)], "engine string, token string, total int, rate double")
    assert found(rules.modernised_words(words)) == [("lexical_modernisation", 2, ("a",), "y x")]
    assert found(rules.projected_deficit(spark.createDataFrame([("a", 0.05), ("b", 0.01)], "engine string, deficit double"))) == [("projected_deficit", 3, ("a",), None)]


def test_selection(spark):
    rows = [
        ("global_leader", 3, ["a"], None), ("significant_gap", 3, ["a", "b"], None), ("statistical_tie", 3, ["a", "b", "c"], None), ("stratum_winner", 3, ["a"], "fr"), ("speed_winner", 2, ["a"], None),
        ("median_mean_gap", 2, ["b"], None), ("median_mean_gap", 2, ["b"], None), ("cost_outlier", 1, ["c"], None), ("unstable", 3, ["a"], None),
    ]
    facts = spark.createDataFrame([(*r, 1.0) for r in rows], rules.FACT)
    got = [(r.position, r.fact, tuple(r.engines)) for r in rules.selected(facts).orderBy("position").collect()]
    # the gap lies within the tie; winner of a stratum repeats the leader; speed and instability complement it, but not each other
    assert got == [(1, "global_leader", ("a",)), (2, "statistical_tie", ("a", "b", "c")), (3, "unstable", ("a",)), (4, "median_mean_gap", ("b",))]
    assert rules.selected(facts.limit(0)).count() == 0 and rules.selected(facts, 1).count() == 1


def test_registered_facts(spark):
    facts = {r.fact for r in registry.QUERIES["all_facts"](spark, SF_DIR).collect()}
    assert "global_leader" in facts and len(facts) >= 4
    assert 1 <= registry.QUERIES["selected_facts"](spark, SF_DIR).count() <= 5
    assert registry.QUERIES["all_levers"](spark, SF_DIR).count() >= 1
