"""The corpus pipeline: every stage decides, keeps columns and works on what its predecessor kept."""

import random
import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
from glyphmeter.llm import decontaminate, jaccard_join, language


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[0] > seen[-1] > 0.6 * seen[0]
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    identified = {r.doc_id for r in language.keep_identified(whole).collect()}
    first = spark.read.parquet(str(tmp_path / "language"))
    copies = {r.doc_id for r in jaccard_join.similar_components(first).where("doc_id <> component_id").collect()}
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    leaked = {r.doc_id for r in decontaminate.find_items(whole, items).collect()}
    assert kept == identified - copies - leaked
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept
    assert docs.where("n_chars <> length(text)").count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)} if words else set()


def odd_rows(spark):
    """The documents with null, empty, repeated, copied and very long texts, null ids and columns named like those of the stages."""
    rng = random.Random(3)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    long = " ".join(str(rng.randrange(5000)) for _ in range(60_000))
    rows += [rows[0], rows[0], (90_001, None, "en", "s", 0), (90_002, "", None, None, None), (90_003, long, "en", "s", None), (90_004, long + " end", "en", "s", 7), (90_005, long[:4000] + " " + item + " " + long[4000:9000], "en", "s", 1), (None, "a b c d e f g", "en", "s", 1), (None, None, None, None, None)]
    frame = spark.createDataFrame([(*r, k % 7, "x", "y") for k, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id int, key string, spans string")
    return frame, rows


def test_copies_and_leaks_of_odd_rows_equal_plain_searches(spark):
    frame, rows = odd_rows(spark)
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    ids = sorted(i for i in sets if sets[i])
    links = {i: {i} for i in sets}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                group = links[a] | links[b]
                for x in group:
                    links[x] = group
    out = corpus_pipeline.drop_near_duplicates(spark, frame, "/root/testdata/sf0.001")
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == frame.columns and sorted(i for i in kept if i is not None) == sorted(i for i in sets if i == min(links[i])) and kept.count(None) == 2
    assert 90_003 in kept and 90_004 not in kept

    items = [shingles(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    leaks = lambda t: any(x and 100 * len(x & shingles(t)) >= 75 * len(x) for x in items)
    out = corpus_pipeline.drop_benchmark_leaks(spark, frame, "/root/testdata/sf0.001")
    kept = Counter(r.doc_id for r in out.collect())
    assert out.columns == frame.columns and kept == Counter(i for i, t, *_ in rows if not leaks(t)) and 90_005 not in kept


def test_other_stages_take_odd_rows(spark):
    frame, rows = odd_rows(spark)
    named = corpus_pipeline.identify_language(spark, frame, "")
    kept = {r.doc_id for r in named.collect()}
    assert named.columns == frame.columns and not kept & {90_001, 90_002} and len(kept) > 0.6 * len(rows)
    clean = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, frame, "").where("doc_id >= 90001").collect()}
    assert clean[90_001].text is None and clean[90_001].n_chars == 0 and clean[90_002].n_chars == 0 and clean[90_003].n_chars == len(clean[90_003].text)
    packed = corpus_pipeline.pack_sequences(spark, frame, "")
    assert packed.where("doc_id = 90001").first().length == 1 and packed.where("doc_id = 90003").agg({"length": "sum"}).first()[0] > 60_000
    assert packed.where("piece = 0").count() == len(rows)


def test_empty_tables_pass_through(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0


def test_every_number_has_a_query():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
