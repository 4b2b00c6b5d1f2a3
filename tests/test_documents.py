"""Whole-text distances, aligned lines, error rates and structure against plain versions."""

import random
import re
import unicodedata
from functools import cache
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmeter.functions import align, distance, lines, rates
from glyphmeter.operators import documents
from glyphmeter.plans import registry
from glyphmeter.sources import derived

SF_DIR = "/root/testdata/sf0.001"
registry.load_all()


def plain_distance(a, b):
    """The table itself, row by row."""
    b = np.frombuffer(b.encode("utf-32-le"), "<u4")
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for x in a:
        best = row + 1
        np.minimum(best[1:], row[:-1] + (b != ord(x)), out=best[1:])
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


def plain_common(a, b):
    row = np.zeros(len(b) + 1, int)
    b = np.array(b, object)
    for x in a:
        got = row.copy()
        np.maximum(got[1:], row[:-1] + (b == x), out=got[1:])
        row = np.maximum.accumulate(got)
    return int(row[-1])


def changed(rng, a, letters, rate):
    return "".join(rng.choice(letters) if rng.random() < rate else c + (rng.choice(letters) if rng.random() < rate / 2 else "") for c in a if rng.random() > rate / 2)


@pytest.mark.parametrize("window", [1, 3, 64])
def test_distance_and_common_length_equal_a_plain_table(monkeypatch, window):
    monkeypatch.setattr(distance, "FIRST_WINDOW", window)
    rng = random.Random(window)
    for _ in range(1500):
        letters = "abéﬁ𝔸 "[: rng.choice([1, 2, 6])]
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        b = changed(rng, a, letters, rng.choice([0.02, 0.2, 0.9])) if rng.random() < 0.8 else "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert distance.levenshtein(a, b) == plain_distance(a, b)
        assert distance.common_length(a, b) == plain_common(list(a), list(b))


def test_distance_of_a_long_line():
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefgh   é") for _ in range(33_000))
    b = changed(rng, a, "xyz", 0.03)
    b = b[:9000] + b[10_500:] + "new end" * 40
    assert distance.levenshtein(a, b) == plain_distance(a, b)


def test_edit_distance_column_in_every_branch(spark):
    rows = [("", ""), ("abc", "abc"), ("abc", "axc"), ("é" * 300, "e" * 299), (None, "a"), ("a", None), ("", "x" * 5000), ("ab" * 400, "ba" * 400)]
    got = spark.createDataFrame(rows, "a string, b string").withColumn("d", distance.edit_distance(F.col("a"), F.col("b"))).collect()
    for r in got:
        assert r.d == (None if r.a is None or r.b is None else plain_distance(r.a, r.b))


def test_operation_counts_are_those_of_the_shortest_script_with_most_hits():
    rng = random.Random(4)
    for _ in range(1500):
        a, b = ([rng.randrange(rng.choice([2, 5])) for _ in range(rng.randrange(12))] for _ in range(2))

        @cache
        def best(i, j, a=tuple(a), b=tuple(b)):
            if not i or not j:
                return i + j, 0
            e, h = best(i - 1, j - 1)
            options = [(e, h - 1) if a[i - 1] == b[j - 1] else (e + 1, h)]
            return min([*options, *((e + 1, h) for e, h in (best(i - 1, j), best(i, j - 1)))])

        hits, subs, dels, ins = align.operation_counts(a, b)
        assert (subs + dels + ins, -hits) == best(len(a), len(b)) and hits + subs + dels == len(a) and hits + subs + ins == len(b)


def cost(a, b, pairs):
    partner = dict(pairs)
    assert list(partner) == sorted(partner) and list(partner.values()) == sorted(set(partner.values()))
    alone = [x for k, x in enumerate(a) if k not in partner] + [x for k, x in enumerate(b) if k not in partner.values()]
    return sum(plain_distance(a[i], b[j]) for i, j in pairs) + sum(len(x) + 1 for x in alone)


def plain_cost(a, b):
    @cache
    def f(i, j):
        if not i or not j:
            return sum(len(x) + 1 for x in (*a[:i], *b[:j]))
        return min(f(i - 1, j - 1) + plain_distance(a[i - 1], b[j - 1]), f(i - 1, j) + len(a[i - 1]) + 1, f(i, j - 1) + len(b[j - 1]) + 1)

    return f(len(a), len(b))


def test_aligned_lines_cost_the_least():
    rng = random.Random(7)
    for _ in range(400):
        a = ["".join(rng.choice("abc ") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(9))]
        b = [changed(rng, x, "abc", 0.2) for x in a if rng.random() > 0.2]
        if rng.random() < 0.4:
            b.insert(rng.randrange(len(b) + 1), "zz" * rng.randrange(4))
        if rng.random() < 0.3 and len(b) > 1:
            b[:2] = [b[0] + b[1]]
        assert cost(a, b, lines.align(a, b)) == plain_cost(a, b)


def test_a_lost_line_costs_one_line_in_tables_of_any_size(monkeypatch):
    rng = random.Random(2)
    a = [f"{k} " + "".join(rng.choice("abcdefghi jklmnop") for _ in range(rng.randrange(20, 90))) for k in range(120)]
    b = [x.replace("e", "c") for k, x in enumerate(a) if k % 9 != 4]
    b.insert(50, "a line of another page")
    wanted = [(k, k - (k + 4) // 9 + (k - (k + 4) // 9 >= 50)) for k in range(120) if k % 9 != 4]
    assert lines.align(a, b) == wanted
    monkeypatch.setattr(lines, "CELLS", 400)
    assert lines.align(a, b) == wanted
    monkeypatch.setattr(lines, "_anchors", lambda a, b: [])
    got = lines.align(a, b)
    assert cost(a, b, got) <= 1.1 * cost(a, b, wanted)
    assert lines.align([], ["x"]) == [] and lines.align(["x"], []) == [] and lines.align([""], [""]) == [(0, 0)]


def test_rates_of_blank_texts_and_forms(spark):
    rows = [(1, "", ""), (2, " \n", None), (3, "", "x"), (4, "ab", " "), (5, "E\u0301\nfin ", "\u00c9 fin"), (6, "the  quick\nfox", "the quick fox jumps"), (7, "Straße", "STRASSE")]
    got = {r.k: r for r in documents.error_rates(spark.createDataFrame(rows, "k int, gt string, hyp string")).collect()}
    for k, value in ((1, 0.0), (2, 0.0), (3, 1.0), (4, 1.0)):
        assert all(got[k][r] == value for r in documents.RATES) and all(got[k][c] is None for c in documents.COUNTS)
    assert (got[5].cer, got[5].cer_nfc, got[5].wer, got[5].wer_normalized) == (pytest.approx(3 / 6), pytest.approx(1 / 5), 2.0, 0.5)
    # "quick\nfox" is one word where only a line end parts it
    assert (got[6].wer, got[6].wer_normalized) == (pytest.approx(3 / 2), pytest.approx(1 / 3)) and got[6].wil == pytest.approx(1 - 1 / 8)
    assert got[7].cer_caseless == 0.0 and got[7].cer > 0


def outputs(spark):
    return derived.shifted(spark, SF_DIR).select("engine", "doc_id", "gt", "hyp").collect()


def test_rates_of_all_outputs_equal_plain_tables(spark):
    got = {(r.engine, r.doc_id): r for r in registry.QUERIES["document_error_rates"](spark, SF_DIR).collect()}
    seen = 0
    for r in outputs(spark):
        g, h, row = r.gt.strip(), r.hyp.strip(), got[r.engine, r.doc_id]
        if not g or not h or len(g) > 5000:
            continue
        seen += 1
        assert row.errors == plain_distance(g, h) and row.ref_chars == len(g) and row.cer == pytest.approx(row.errors / len(g))
        words = [[w for w in re.sub(r"\s\s+", " ", t).strip().split(" ") if w] for t in (g, h)]
        codes = {w: chr(k + 1) for k, w in enumerate({*words[0], *words[1]})}
        assert row.word_errors == plain_distance(*("".join(codes[w] for w in ws) for ws in words)) and row.ref_words == len(words[0])
        assert row.wer == pytest.approx(row.word_errors / len(words[0]))
        nfc = [unicodedata.normalize("NFC", t).strip() for t in (r.gt, r.hyp)]
        assert row.cer_nfc == pytest.approx(plain_distance(*nfc) / len(nfc[0]) if nfc != [g, h] else row.cer)
    assert seen > 500
    assert {r.engine for r in registry.QUERIES["whole_text_ranking"](spark, SF_DIR).collect()} == set(derived.SHIFTED)


def test_aligned_line_reports_equal_plain_ones(spark):
    pairs = outputs(spark)
    rows = {}
    for r in registry.QUERIES["aligned_line_documents"](spark, SF_DIR).collect():
        rows[r.engine, r.doc_id] = r
    heat = {e: [[] for _ in range(10)] for e in derived.SHIFTED}
    for r in pairs:
        a, b = r.gt.split("\n"), r.hyp.split("\n")
        partner = dict(lines.align(a, b))
        if len(a) * len(b) <= 150:
            assert cost(a, b, list(partner.items())) == plain_cost(a, b)
        errors = [len(x) if k not in partner else plain_distance(x, b[partner[k]]) if len(x) < 400 else distance.levenshtein(x, b[partner[k]]) for k, x in enumerate(a)]
        cer = [min(1, e / len(x)) if x else float(e > 0) for x, e in zip(a, errors, strict=True)]
        row, order = rows[r.engine, r.doc_id], np.sort(cer)
        assert row.lines == len(a) and row.lost == len(a) - len(partner) and row.mean_cer == pytest.approx(mean(cer))
        assert [row[f"p{p}"] for p in documents.PERCENTILES] == pytest.approx(list(np.percentile(order, documents.PERCENTILES)))
        assert [row[f"over_{t}"] for t in documents.THRESHOLDS] == pytest.approx([np.mean(order > t / 100) for t in documents.THRESHOLDS])
        n = len(a)
        for k in range(10):
            part = cer[k * n // 10 : (k + 1) * n // 10]
            heat[r.engine][k].append(mean(part) if part else 0.0)
    found = {(r.engine, r.bin): r.cer for r in registry.QUERIES["aligned_line_heat_map"](spark, SF_DIR).collect()}
    assert found == pytest.approx({(e, k): mean(v) for e, bins in heat.items() for k, v in enumerate(bins)})
    worst = registry.QUERIES["worst_aligned_lines_topk"](spark, SF_DIR).collect()
    assert len(worst) == 25 and worst[0].line_cer == 1.0


def test_structure_equals_plain_counts(spark):
    found = {(r.engine, r.doc_id): r for r in registry.QUERIES["structure_documents"](spark, SF_DIR).collect()}
    for r in outputs(spark):
        row, words = found[r.engine, r.doc_id], (r.gt.split(), r.hyp.split())
        if all(words):
            assert row.reading_order == pytest.approx(2 * plain_common(*words) / (len(words[0]) + len(words[1])))
        a, b = ([x for x in t.splitlines() if x.strip()] for t in (r.gt, r.hyp))
        assert (row.gt_lines, row.hyp_lines) == (len(a), len(b))
        if a and b:
            assert row.fused - row.split == len(a) - len(b)
    assert rates.line_changes(list("abcd"), list("ad")) == (2, 0) and rates.line_changes(list("ab"), list("axyb")) == (0, 2) and rates.line_changes(list("ab"), list("xy")) == (0, 0)
    one = documents.structure(spark.createDataFrame([("e", 1, "a\n\nb\n\nc", "a\n\nb c"), ("e", 2, "", "x"), ("e", 3, None, None)], "engine string, doc_id int, gt string, hyp string")).orderBy("doc_id").collect()
    assert one[0].paragraphs == pytest.approx(2 / 3) and one[0].reading_order == 1.0 and (one[1].line_accuracy, one[2].line_accuracy) == (0.0, 1.0)
