"""Formats, corpora in folders, history, resampling and the event stream on small cases."""

import os

import pytest
from pyspark.sql import functions as F

from glyphmeter.operators import bootstrap
from glyphmeter.sources import corpus, formats
from glyphmeter.streaming import jobs


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_alto_hyphenation_entities_and_refusals(spark):
    xml = """<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page><PrintSpace>
    <TextBlock><TextLine><String CONTENT="a&amp;b"/><String CONTENT="exam" SUBS_TYPE="HypPart1" SUBS_CONTENT="example"/></TextLine>
    <TextLine><String CONTENT="ple" SUBS_TYPE="HypPart2" SUBS_CONTENT="example"/><String CONTENT="end"/></TextLine></TextBlock>
    <TextBlock><TextLine><String CONTENT="z"/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>"""
    lines = lambda c: formats.alto_lines(formats.read_alto(c))
    assert one(spark, xml, lines) == ["a&b example", "end", "z"]
    assert one(spark, "<!DOCTYPE x><alto/>", lines) is None
    assert one(spark, None, lines) is None


def test_round_trips_of_edge_texts(spark):
    for text, want in (('q "<&>" é', ['q "<&>" é']), ("a\n\n b  c \x01", ["a", "b c"])):
        assert [x.strip() for x in one(spark, text, lambda c: formats.alto_lines(formats.read_alto(formats.to_alto(c))))] == want
        assert [x.strip() for x in one(spark, text, lambda c: formats.page_lines(formats.read_page(formats.to_page(c))))] == want


def test_json_levels(spark):
    assert [e["label"] for e in one(spark, '{"entities":[{"label":"P","start":0,"end":2,"text":"ab"},{"label":"X","start":3,"end":1,"text":""}]}', formats.read_entities)] == ["P"]
    assert one(spark, '["b","a"]', formats.read_order) == ["b", "a"] == one(spark, '{"region_order":["b","a"]}', formats.read_order)
    assert one(spark, '{"markdown":"m","plain":"p"}', formats.canonical_text) == "m"


def test_corpus_folder(spark, tmp_path):
    for name, text in (("a.png", "-"), ("a.gt.txt", "x\ny"), ("a.ocr.txt", "x"), ("b.jpg", "-"), ("c.gt.txt", "z"), ("a.gt.entities.json", "[]")):
        (tmp_path / name).write_text(text)
    (row,) = corpus.corpus(spark, str(tmp_path)).collect()
    assert (row["doc_id"], row["gt"], row["ocr"], row["alto"], row["entities"]) == ("a", "x\ny", "x", None, "[]")
    assert {(r["doc_id"], r["side"]) for r in corpus.orphans(spark, str(tmp_path)).collect()} == {("b", "image"), ("c", "gt")}


def test_history_keeps_the_latest(spark, tmp_path):
    for cer in (0.2, 0.1):
        corpus.append_history(spark.createDataFrame([("r", "e", cer)], "run_id string, engine string, cer double"), str(tmp_path / "h"))
    assert [r["cer"] for r in corpus.latest_history(spark, str(tmp_path / "h")).collect()] == [0.1]


def test_bootstrap_interval(spark):
    rows = spark.range(2000).select(F.lit("e").alias("engine"), F.col("id").alias("doc_id"), (F.col("id") % 100 / 100.0).alias("cer"))
    first, again = (bootstrap.intervals(rows.repartition(n), "engine", "doc_id", "cer").first() for n in (2, 5))
    assert first["mean"] == pytest.approx(0.495) and first["units"] == 2000
    # the normal interval has a half width of 1.96 * 0.2887 / sqrt(2000)
    assert first["high"] - first["low"] == pytest.approx(2 * 0.01265, rel=0.15)
    assert first["low"] == pytest.approx(again["low"]) and first["high"] == pytest.approx(again["high"])
    assert bootstrap.intervals(rows.limit(0), "engine", "doc_id", "cer").collect() == []


def test_replay_drops_repeated_deliveries(spark, tmp_path):
    made = spark.range(6).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    made.union(made).repartition(3).write.parquet(str(tmp_path / "log"))
    events = jobs.event_stream(spark, str(tmp_path / "log"), files_per_trigger=1)
    assert sorted(r["seq"] for r in jobs.drain(jobs.replay(events, 2), "t").collect()) == [3, 4, 5]
    got = {r["job_id"]: r["last_seq"] for r in jobs.drain(jobs.progress(events), "p", "job_id").collect()}
    assert got == {0: 4, 1: 5}


def test_late_files_count(spark, tmp_path):
    """One file a trigger, the newest first: five events four weeks apart from the next file's, the first file delivered again at the end."""
    for k, week in enumerate((8, 4, 0, 8)):
        rows = spark.range(week * 10, week * 10 + 5).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(week * 7 * 86400)).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
        rows.coalesce(1).write.parquet(str(tmp_path / "log" / str(k)))
        for f in (tmp_path / "log" / str(k)).glob("part-*"):
            os.utime(f, (1_000_000 + k * 100,) * 2)  # the stream takes the oldest file first
    events = jobs.event_stream(spark, str(tmp_path / "log" / "*"), files_per_trigger=1)
    assert sorted(r["events"] for r in jobs.drain(jobs.windows(events), "w", "start", "kind").collect()) == [5, 5, 10]
    assert sorted(r["seq"] for r in jobs.drain(jobs.replay(events, -1), "r").collect()) == [*range(5), *range(40, 45), *range(80, 85)]
