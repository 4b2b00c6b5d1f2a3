"""Medians, orders, look-ups, stored outputs and views against plain versions."""

import json
import random
import time
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmeter.functions import order
from glyphmeter.functions import text as T
from glyphmeter.operators import bootstrap, documents, lookup, quantiles, views
from glyphmeter.plans import registry
from glyphmeter.sources import derived, outputs
from glyphmeter.streaming import jobs, log

SF_DIR = "/root/testdata/sf0.001"
registry.load_all()


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_medians_are_exact(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    rows = [("ties", rng.choice([0.0, 0.5, 1.0])) for _ in range(501)] + [("many", rng.random()) for _ in range(3000)] + [(None, rng.random()) for _ in range(8)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None), ("many", None), ("low", 0.0), ("low", 0.0), ("low", 5.0)]
    got = {r.k: r.median for r in quantiles.medians(spark.createDataFrame(rows, "k string, x double").repartition(5), "x", "k").collect()}
    wanted = {k: median([x for key, x in rows if key == k and x is not None]) for k in {k for k, _ in rows} - {"none"}}
    assert got == pytest.approx(wanted)


def test_medians_of_many_distinct_values(spark):
    rows = spark.range(400_000).select(F.lit("engine").alias("k"), ((F.col("id") * 7919) % 400_000 / 3).alias("x"))
    assert quantiles.medians(rows, "x", "k").first().median == pytest.approx(399_999 / 6)


def test_inversions_and_orders():
    rng = random.Random(3)
    for n in (0, 1, 2, 63, 64, 65, 200, 1000):
        p = np.array(rng.sample(range(n), n), np.int64)
        assert order.inversions(p) == sum(int((p[k + 1 :] < p[k]).sum()) for k in range(n))
    for _ in range(200):
        ref, hyp = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        pairs = [{(a, b) for k, a in enumerate(x) for b in x[k + 1 :]} for x in (list(dict.fromkeys(ref)), list(dict.fromkeys(hyp)))]
        assert order.order_counts(ref, hyp) == (len(pairs[0]), len(pairs[1]), len(pairs[0] & pairs[1]))
    began = time.process_time()
    assert order.order_counts(list(range(100_000)), list(range(99_999, -1, -1)))[2] == 0
    assert time.process_time() - began < 5


def test_longest_keys_equal_a_loop(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randrange(n)))
    names, keys = [word(12) for _ in range(300)] + ["", None, "aa"], [word(5) for _ in range(60)] + ["", None, "aaaaaaaaaaaaaaaaaa", "aa"]
    got = {r.name: r.key for r in lookup.longest_key(spark.createDataFrame([(n,) for n in names], "name string"), "name", spark.createDataFrame([(k,) for k in keys], "key string"), "key").collect()}
    wanted = {n: min((k for k in keys if k and k in n), key=lambda k: (-len(k), k.encode()), default=None) for n in names if n is not None}
    assert got == wanted
    assert [r.key for r in lookup.longest_key(spark.createDataFrame([("a",)], "name string"), "name", spark.createDataFrame([], "key string"), "key").collect()] == [None]


def test_pages_and_display(spark):
    rows = [("1-3,7", 5), ("all", 3), ("", 2), ("ALL", 0), ("9", 4), ("2,1-2", 4), (None, 2)]
    got = [r.p for r in spark.createDataFrame(rows, "s string, n int").select(T.page_selection(F.col("s"), F.col("n")).alias("p")).collect()]
    assert got == [[1, 2, 3], [1, 2, 3], [1, 2], [], [], [1, 2], [1, 2]]
    shown = spark.createDataFrame([(None,), (0.123456,)], "x double").select(T.shown(F.col("x")).alias("x")).collect()
    assert [r.x for r in shown] == [0.0, 0.1235]


def test_stored_outputs_and_their_choice(spark, tmp_path):
    rows = [("a", 1, "raw_text", 2, "late"), ("a", 1, "raw_text", 1, "raw"), ("a", 1, "corrected_text", 3, "fixed"), ("a", 2, "raw_text", 1, None), ("b", 1, "image", 0, "x"), ("b", 3, "corrected_text", 1, "only")]
    outputs.write_outputs(spark.createDataFrame(rows, "engine string, doc_id bigint, kind string, place int, text string"), str(tmp_path / "o"))
    got = {(r.engine, r.doc_id): (r.text, r.kind, r.intermediate) for r in outputs.chosen_texts(outputs.read_outputs(spark, str(tmp_path / "o"))).collect()}
    assert got == {("a", 1): ("fixed", "corrected_text", "raw"), ("a", 2): ("", "raw_text", None), ("b", 1): ("", "none", None), ("b", 3): ("only", "corrected_text", None)}
    one = outputs.read_outputs(spark, str(tmp_path / "o"), "b")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(engine" in one._jdf.queryExecution().toString()
    truths = spark.createDataFrame([(1, "raw_text", "g"), (3, "image", "h")], "doc_id bigint, kind string, gt string")
    joined = outputs.with_truth(outputs.read_outputs(spark, str(tmp_path / "o")), truths)
    assert sorted((r.engine, r.doc_id, r.kind, r.gt) for r in joined.collect()) == [("a", 1, "corrected_text", "g"), ("a", 1, "raw_text", "g"), ("a", 1, "raw_text", "g")]


def test_ranking_from_stored_outputs_equals_that_of_the_same_texts(spark):
    got = {r.engine: r.micro_cer for r in registry.QUERIES["precomputed_ranking"](spark, SF_DIR).collect()}
    same = derived.shifted(spark, SF_DIR).withColumn("hyp", F.when(F.col("doc_id") % 3 == 0, F.trim("hyp")).otherwise(F.col("hyp")))
    assert got == pytest.approx({r.engine: r.micro_cer for r in documents.ranking(documents.error_rates(same)).collect()})


def test_view_rates(spark):
    rows = [("k", "text", "a b", "a b"), ("k", "text", "a b", "a c"), ("k", "text", "a", None), ("k", "text", "", "x"), ("k", "text", " ", None), ("k", "text", "ab", "")]
    got = views.view_rates(spark.createDataFrame(rows, "engine string, view string, gt string, hyp string")).first()
    assert (got.artifacts, got.unreadable, got.no_reference, got.scored) == (6, 2, 1, 3)
    assert got.mean_cer == pytest.approx((0 + 1 / 3 + 1) / 3) and got.mean_wer == pytest.approx((0 + 1 / 2 + 1) / 3) and got.mean_wil == pytest.approx((0 + 3 / 4 + 1) / 3)
    found = {(r.view, r.engine): r for r in registry.QUERIES["view_metrics"](spark, SF_DIR).collect()}
    assert set(v for v, _ in found) == set(views.VIEWS) and found["text", "page_xml"].unreadable == found["text", "page_xml"].artifacts
    assert found["text", "raw_text"].mean_cer == pytest.approx(found["search", "raw_text"].mean_cer) and 0 < found["text", "raw_text"].mean_cer < 0.2


def test_fuzzy_view_and_history_lines(spark):
    rows = {(r.engine, r.doc_id): r.recall for r in registry.QUERIES["document_fuzzy_recall"](spark, SF_DIR).collect()}
    found = {(r.engine, r.doc_id): r.recall for r in registry.QUERIES["fuzzy_view_recall"](spark, SF_DIR).collect()}
    assert found == {k: v or 0.0 for k, v in rows.items()}
    for r in registry.QUERIES["history_json"](spark, SF_DIR).take(5):
        line = json.loads(r.json)
        assert list(line) == sorted(line) and line["engine"] == r.engine


def test_resamples_draw_exactly_as_many_in_any_partitions(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("a", k, rng.gauss(5, 2)) for k in range(700)] + [("b", k, 1.0 + k) for k in range(90)] + [("b", 5, None), ("one", 1, 3.0)]
    docs = spark.createDataFrame(rows, "e string, doc bigint, x double")
    for leaf in (4096, 50):
        monkeypatch.setattr(bootstrap, "LEAF_UNITS", leaf)
        sums = [sorted(map(tuple, bootstrap.resampled_sums(docs.repartition(n), "e", "doc", "x", 300).collect())) for n in (1, 7)]
        assert sums[0] == sums[1] and len(sums[0]) == 900
        assert {(e, n) for e, _, _, n in sums[0]} == {("a", 700), ("b", 90), ("one", 1)}
        means = np.array([t / n for e, _, t, n in sums[0] if e == "a"])
        values = np.array([x for e, _, x in rows if e == "a"])
        assert abs(means.mean() - values.mean()) < 0.03 and means.std() == pytest.approx(values.std() / 700**0.5, rel=0.15)
        assert all(t == 3.0 for e, _, t, _ in sums[0] if e == "one")


def test_intervals_cover_the_mean(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "LEAF_UNITS", 40)
    chance = np.random.default_rng(1)
    rows = [(f"e{k}", i, float(x)) for k in range(120) for i, x in enumerate(chance.exponential(1.0, 150))]
    found = bootstrap.multinomial_intervals(spark.createDataFrame(rows, "e string, doc bigint, x double"), "e", "doc", "x", 200).collect()
    assert len(found) == 120 and all(r.units == 150 and r.low < r.mean < r.high for r in found)
    assert 0.87 <= sum(r.low <= 1.0 <= r.high for r in found) / 120 <= 1.0


def test_job_log_is_the_same_in_any_order_and_cutting(spark, tmp_path):
    rng = random.Random(2)
    states = ["pending", "running", "complete", "error"]
    rows = [(j, s, rng.choice(states), f"2024-01-{1 + s:02d}") for j in range(12) for s in range(1, 1 + rng.randrange(1, 20))]
    before = {(j, s): x for j, s, x, _ in rows}
    wanted = sorted((j, s, x, before.get((j, s - 1), ""), log.is_allowed(before.get((j, s - 1), ""), x)) for j, s, x, _ in rows)
    assert any(w[-1] for w in wanted) and not all(w[-1] for w in wanted)
    for cut in (1, 4):
        mixed = rows + rng.sample(rows, 20) + [(None, 1, "pending", None), (1, None, "pending", None)]
        rng.shuffle(mixed)
        folder = str(tmp_path / f"log{cut}")
        for k in range(6):
            spark.createDataFrame(mixed[k::6], "job_id bigint, seq bigint, state string, day string").selectExpr("job_id", "seq", "state", "CAST(day AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("job_id bigint, seq bigint, state string, ts timestamp").option("maxFilesPerTrigger", cut).parquet(folder)
        entries = jobs.drain(log.in_order(stream), f"test-log-{cut}")
        assert sorted((r.job_id, r.seq, r.state, r.before, r.allowed) for r in entries.collect()) == wanted
        assert all(r.ts.day == 1 + r.seq for r in entries.collect())


def test_last_events_need_no_order_and_no_python(spark, tmp_path):
    rng = random.Random(3)
    rows = [(j, s, rng.choice(["pending", "running", "complete"]), f"2024-01-{1 + s:02d}") for j in range(15) for s in range(1, 1 + rng.randrange(1, 20))]
    mixed = rows + rng.sample(rows, 20) + [(None, 1, "pending", "2025-01-01"), (1, None, "pending", "2025-01-01")]
    rng.shuffle(mixed)
    for k in range(5):
        spark.createDataFrame(mixed[k::5], "job_id bigint, seq bigint, state string, day string").selectExpr("job_id", "seq", "state", "CAST(day AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = log.last_events(spark.readStream.schema("job_id bigint, seq bigint, state string, ts timestamp").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "log")))
    assert "InPandas" not in stream._jdf.queryExecution().logical().toString()
    last = jobs.drain(stream, "test-last", "job_id")
    wanted = {j: max((s, x) for i, s, x, _ in rows if i == j) for j in range(15)}
    assert {r.job_id: (r.seq, r.state) for r in last.collect()} == wanted
    latest = max(s for s, _ in wanted.values())
    assert {r.job_id for r in log.orphans(last).collect()} == {j for j, (s, x) in wanted.items() if x != "complete" and s < latest - 1}
