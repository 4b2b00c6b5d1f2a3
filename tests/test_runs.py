"""Imports, runs, resumed work, stored artifacts, the job log and views."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphmeter.functions.text import markdown_text, page_selection
from glyphmeter.operators import views
from glyphmeter.sources import corpus, formats, imports, runs


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_archives(spark, tmp_path, monkeypatch):
    good = archive({"set/p1.png": b"x", "set/p1.gt.txt": "été", "set/p1.gt.alto.xml": "<alto/>", "p2.JPG": b"y", "p3.gt.txt": "z", "../evil.gt.txt": "no", ".hidden.gt.txt": "no", "notes.md": "n", "a/": ""})
    (tmp_path / "good.zip").write_bytes(good)
    (tmp_path / "bad.zip").write_bytes(b"PK broken")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))
    rows = {r.doc_id: r for r in imports.archive_corpus(files).collect()}
    assert set(rows) == {"p1", "p2", "p3"} and rows["p1"].gt == "été" and rows["p1"].alto == "<alto/>" and rows["p1"].has_image and rows["p2"].gt is None
    assert tuple(imports.pairing(imports.archive_corpus(files)).first()) == (1, 1, 1)
    errors = imports.archive_members(files).where("error IS NOT NULL").collect()
    assert len(errors) == 1 and errors[0].archive.endswith("bad.zip")
    monkeypatch.setattr(imports, "MAX_MEMBERS", 2)
    assert {r.error for r in imports.archive_members(files).select("error").collect()} >= {"too large"}


def test_kinds_and_versions(spark):
    names = {"a.gt.txt": "gt", "x/a.gt.alto.xml": "alto", "a.tiff": "image", "a.xml": "other", "a.gt.entities.json": "entities"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", imports.file_kind(F.col("n")).alias("k"), imports.file_stem(F.col("n")).alias("s")).collect()
    assert {r.n: r.k for r in got} == names and {r.s for r in got} == {"a", "a.xml"}
    xml = {'<?xml version="1.0"?>\n<!-- c --><alto xmlns="http://www.loc.gov/standards/alto/ns-v3#"/>': ("alto", 3), "<alto/>": ("alto", 0), "<p:PcGts/>": ("page", None), "<html/>": (None, None), "no": (None, None)}
    rows = spark.createDataFrame([(x,) for x in xml], "x string").select("x", imports.xml_level(F.col("x")).alias("level"), imports.alto_version(F.col("x")).alias("v")).collect()
    assert {r.x: (r.level, r.v) for r in rows} == xml


def test_confidences_and_pages(spark):
    side = json.dumps([{"token": "a", "confidence": 0.5}, {"token": "b", "confidence": 80}, {"token": " ", "confidence": 0.9}, {"token": "c", "confidence": None}, {"token": "d", "confidence": -1}])
    row = spark.createDataFrame([(side,), ("broken",)], "j string").select(imports.confidences(F.col("j")).alias("c")).collect()
    assert [tuple(x) for x in row[0].c] == [("a", 0.5), ("b", 0.8)]
    old = json.dumps({"sequences": [{"canvases": [{"@id": "c1", "label": "1r", "width": 10, "height": 20, "images": [{"resource": {"@id": "i1"}}]}]}]})
    new = json.dumps({"items": [{"id": "c2", "label": "1v", "width": 1, "height": 2, "items": [{"items": [{"body": {"id": "i2"}}]}]}]})
    got = spark.createDataFrame([(old,), (new,), ("{}",)], "m string").select(imports.canvases(F.col("m")).alias("c")).collect()
    assert [[tuple(x) for x in r.c] if r.c else None for r in got] == [[("c1", "1r", 10, 20, "i1")], [("c2", "1v", 1, 2, "i2")], None]
    pages = spark.createDataFrame([("1-3,7", 9), ("2, 2-3", 9), ("8-12", 9)], "s string, n int").select(page_selection(F.col("s"), F.col("n"))).collect()
    assert [r[0] for r in pages] == [[1, 2, 3, 7], [2, 3], [8, 9]]


def test_catalogue(spark):
    rows = [("1", "Parish registers", "births", "A B", "18th", "CC", ["fr", "la"], ["Latn"]), ("2", "Letters", None, "C", "19th", "CC", ["FR"], ["Latn", "Cyrl"]), ("3", "Poems", "of birth", "D", None, None, [], None)]
    entries = spark.createDataFrame(rows, "id string, title string, description string, authors string, period string, licence string, languages array<string>, scripts array<string>")
    ids = lambda f: sorted(r.id for r in f.collect())
    assert ids(imports.search_catalogue(entries, "BIRTH")) == ["1", "3"] and ids(imports.search_catalogue(entries, "cc 18th")) == ["1"]
    assert ids(imports.search_catalogue(entries, language="fr")) == ["1", "2"] and ids(imports.search_catalogue(entries, "letters", "fr", "cyrl")) == ["2"]
    assert {r.value: r.entries for r in imports.catalogue_values(entries, "languages").collect()} == {"fr": 1, "la": 1, "FR": 1}
    more = spark.createDataFrame([("2", "other"), ("9", "new"), ("9", "new")], "id string, title string")
    assert sorted((r.id, r.title) for r in imports.merged_datasets(entries.select("id", "title"), more).collect()) == [("1", "Parish registers"), ("2", "Letters"), ("3", "Poems"), ("9", "new")]


def test_runs_round_trip_and_resume(spark, tmp_path):
    results = spark.createDataFrame([("e", "d1", 0.1), ("e", "d2", None), ("f", "d1", 0.3)], "engine string, doc_id string, cer double")
    manifest = spark.createDataFrame([("run1", "corpus")], "run_id string, corpus string")
    folder = f"file://{tmp_path}/run"
    runs.write_run(folder, manifest, pipeline_results=results)
    (tmp_path / "run" / "pipeline_results" / "part-bad.json").write_text('{"engine": "e", "doc_id"\n')
    back = runs.read_run(spark, folder, "pipeline_results", "engine string, doc_id string, cer double")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, results.collect()), key=str)
    assert runs.read_run(spark, folder, "manifest", "run_id string, corpus string").first().run_id == "run1"
    reports = {r.engine: json.loads(r.json) for r in runs.benchmark_reports(results, "c", "2024-01-01").collect()}
    assert list(reports["e"]) == sorted(reports["e"]) and reports["e"]["documents"] == 2 and reports["e"]["mean_cer"] == 0.1
    document = {"corpus": {"name": "c", "documents": 1}, "run_date": "d", "ranking": [], "engine_reports": [{"engine": "e", "document_results": [{"doc_id": "x", "cer": 0.5, "wer": 1.0, "error": None}]}]}
    (tmp_path / "bench.json").write_text(json.dumps(document, indent=1))
    assert [tuple(r) for r in runs.read_benchmark(spark, str(tmp_path / "bench.json")).collect()] == [("e", "x", 0.5, 1.0, None, "c", "d")]

    partial = f"file://{tmp_path}/partial"
    runs.append_partial(results.where("engine = 'e' AND doc_id = 'd1'"), partial)
    runs.append_partial(results.where("engine = 'e' AND doc_id = 'd1'"), partial)
    (tmp_path / "partial" / "part-x.json").write_text("{ broken\n")
    done = runs.load_partial(spark, partial, "engine string, doc_id string, cer double", "engine", "doc_id")
    assert [tuple(r) for r in done.collect()] == [("e", "d1", 0.1)]
    assert runs.remaining(results, done, "engine", "doc_id").count() == 2
    assert sorted(r.cer is None for r in runs.resumed(done, results, "engine", "doc_id").collect()) == [False, False, True]


def test_artifacts(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")], "id int, text string")
    keyed = runs.store_artifacts(rows, folder, "text")
    keys = {r.id: r.key for r in keyed.collect()}
    assert keys[1] == keys[2] and len(set(keys.values())) == 4 and spark.read.parquet(folder).count() == 4
    runs.store_artifacts(rows.union(spark.createDataFrame([(6, "c")], rows.schema)), folder, "text", stored=spark.read.parquet(folder).select("key"))
    assert spark.read.parquet(folder).count() == 5


def test_job_log(spark):
    events = spark.createDataFrame([("j", 5, 2.0), ("j", 4, 1.0), ("k", 6, 1.0)], "job_id string, event_id int, ts double")
    assert {(r.job_id, r.event_id): r.seq for r in runs.numbered(events).collect()} == {("j", 4): 1, ("j", 5): 2, ("k", 6): 1}
    before = spark.createDataFrame([("j", 1), ("j", 7)], "job_id string, seq bigint")
    assert {(r.job_id, r.event_id): r.seq for r in runs.numbered(events, before).collect()} == {("j", 4): 8, ("j", 5): 9, ("k", 6): 1}
    moves = spark.createDataFrame([("j", 1, "pending"), ("j", 2, "running"), ("j", 3, "complete"), ("j", 4, "running"), ("k", 1, "running")], "job_id string, seq int, state string")
    assert sorted((r.job_id, r.seq) for r in runs.broken_moves(moves).collect()) == [("j", 4), ("k", 1)]


def test_views(spark):
    rows = [("raw_text", "abc"), ("alto_xml", "<alto><Layout><Page><PrintSpace><TextBlock><TextLine><String CONTENT='x'/></TextLine></TextBlock></PrintSpace></Page></Layout></alto>"), ("page_xml", "<!DOCTYPE a><PcGts/>"), ("image", "")]
    artifacts = spark.createDataFrame(rows, "kind string, payload string")
    assert sorted((r.view, r.kind) for r in views.eligible(artifacts).collect()) == sorted((v, k) for v, ks in views.VIEWS.items() for k in ks if k in dict(rows))
    text = {r.kind: r.t for r in artifacts.where("kind <> 'image'").select("kind", views.projected(F.col("kind"), F.col("payload")).alias("t")).collect()}
    assert text == {"raw_text": "abc", "alto_xml": "x", "page_xml": None}
    report = {r.kind: (r.artifacts, r.unreadable) for r in views.projection_report(artifacts).collect()}
    assert report["page_xml"] == (1, 1) and report["raw_text"] == (1, 0)
    pairs = spark.createDataFrame([("e", "text", "abc", "abd"), ("e", "text", "", "x"), ("e", "text", "abc", None)], "engine string, view string, gt string, hyp string")
    row = views.view_means(views.text_scores(pairs)).first()
    assert (row.documents, row.scored, row.unreadable, row.no_reference) == (3, 1, 1, 1) and row.mean_cer == pytest.approx(1 / 3)
    alto = spark.createDataFrame([("One two two",)], "t string").select(views.preserved_words(F.lit("one TWO three"), formats.read_alto(formats.to_alto(F.col("t")))).alias("p"))
    assert alto.first().p == pytest.approx(2 / 3)


def test_long_rows(spark, tmp_path):
    rows = spark.createDataFrame([("r", "d", "p", "v", "cer", 0.123456789, "ok")], "run string, doc_id string, pipeline string, view string, metric string, value double, status string")
    corpus.write_long(rows, str(tmp_path / "long"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "long")).first().value == "0.123457"


def test_markdown(spark):
    text = "# Title\n\n> quote **bold** and _it_ `code`\n- item [link](http://x) ![alt](y)\n1. one\n---\n```py\nx\n```"
    got = spark.createDataFrame([(text,)], "t string").select(markdown_text(F.col("t"))).first()[0]
    assert got.split() == ["Title", "quote", "bold", "and", "it", "code", "item", "link", "alt", "one", "x"]


def test_divided_words_and_blocks(spark):
    string = lambda c, t="", s="": f"<String CONTENT='{c}'" + (f" SUBS_TYPE='{t}'" if t else "") + (f" SUBS_CONTENT='{s}'" if s else "") + "/>"
    line = lambda *s: "<TextLine>" + "".join(s) + "</TextLine>"
    block = lambda *x: "<TextBlock>" + "".join(x) + "</TextBlock>"
    body = block(line(string("a"), string("exam-", "HypPart1")), line(string("ple", "HypPart2"), string("b"))) + block(line(string("who-", "HypPart1", "whole")), line(string("le", "HypPart2", "whole"), string("c"))) + block(line(string("ple", "HypPart2"), string("d")))
    xml = f"<alto><Layout><Page><PrintSpace>{body}</PrintSpace></Page></Layout></alto>"
    got = spark.createDataFrame([(xml,)], "x string").select(formats.alto_text(formats.read_alto(F.col("x")))).first()[0]
    assert got == "a example\nb\n\nwhole\nc\n\nple d"


def test_running_places_equal_a_window(spark):
    from pyspark.sql import Window

    from glyphmeter.operators.ranks import running

    rows = spark.range(500).select((F.col("id") % 3).alias("key"), (F.col("id") * 7919 % 101).cast("double").alias("v"), "id")
    got = sorted((r.key, r.id, r.k, r.total, r.n, r.whole) for r in running(rows, "key", "v", "v", "id").collect())
    w = Window.partitionBy("key").orderBy("v", "id")
    plain = rows.select("key", "id", F.row_number().over(w).alias("k"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("t"), F.count("*").over(Window.partitionBy("key")).alias("n"), F.sum("v").over(Window.partitionBy("key")).alias("s"))
    assert got == sorted(map(tuple, plain.collect()))
    assert running(rows.limit(0), "key", "v", "v", "id").count() == 0
