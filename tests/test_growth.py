"""What must not grow faster than the input: batches, shuffles, tasks and tables."""

import random
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmeter.functions import align, distance, errors, rates, text
from glyphmeter.operators import tokens, views
from glyphmeter.plans import registry
from glyphmeter.plans.registry import QUERIES
from glyphmeter.sources import derived, formats


def _noisy(rng, text, rate, letters="abcdé"):
    out = []
    for c in text:
        x = rng.random()
        out += [] if x < rate / 3 else [rng.choice(letters)] if x < 2 * rate / 3 else [c, rng.choice(letters)] if x < rate else [c]
    return out


def test_words_go_back_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_AT_ONCE", 50)
    texts = [" ".join(f"w{k % 40}" for k in range(i, i + 40)) for i in range(30)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(32)), pa.array(texts), pa.array([[t, "w0 w0 x"] for t in texts])], ["doc_id", "gt", "hyps"])
    out = list(tokens.count_batches(iter([batch, batch])))
    assert max(b.num_rows for b in out) <= 50 and len(out) > 50
    rows = [r for b in out for r in b.to_pylist()]
    assert len(rows) == 2 * (30 * 41 + 2 * 2)
    assert {"doc_id": 0, "token": "w0", "g": 1, "h": [1, 2]} in rows and {"doc_id": 30, "token": "x", "g": 0, "h": [0, 1]} in rows


@pytest.mark.parametrize("name", ["complementarity_gap", "error_absorption", "pairwise_disagreement", "hallucination_metrics"])
def test_words_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^\n]*(token|doc_id|\bt)#", plan)


def _plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("few", [1, 24])
def test_distances_of_batches_are_those_of_the_table(monkeypatch, few):
    rng = random.Random(few)
    monkeypatch.setattr(distance, "FEW_PAIRS", few)
    monkeypatch.setattr(distance, "SIGNS_AT_ONCE", 5_000)
    left = ["".join(rng.choice("abcdef gé\U0001f600"[: rng.choice([2, 9])]) for _ in range(rng.choice([0, 1, 5, 30, 90]))) for _ in range(300)]
    right = ["".join(_noisy(rng, x, rng.choice([0, 0.1, 0.6]))) if k % 9 else "zzz" for k, x in enumerate(left)]
    assert distance.distances(left, right).tolist() == [_plain_distance(x, y) for x, y in zip(left, right, strict=True)]


def test_lines_with_few_errors_need_no_table_of_their_own(monkeypatch):
    monkeypatch.setattr(distance, "levenshtein", None)
    lines = [f"the quick brown fox {k} jumps over the lazy dog and returns in the evening" for k in range(100)]
    for change in (lambda x: x.replace("e", "c"), lambda x: x.replace("u", ""), lambda x: x + " et", lambda x: x.replace("rn", "m").replace("th", "h")):
        assert (distance.distances(lines, [change(x) for x in lines]) > 0).all()


def test_scripts_that_reading_tells_are_those_of_the_table(monkeypatch):
    rng, known = random.Random(4), []
    for _ in range(400):
        a = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 25))]
        known.append((a, rng.choice([[x for x in a if rng.random() < 0.8], [x if rng.random() < 0.8 else x.upper() for x in a], _noisy(rng, a, 0.3), list("abcabcabc")])))
    quick = [align.script(a, b) for a, b in known]
    counts = [align.operation_counts(a, b) for a, b in known]
    monkeypatch.setattr(align, "NARROW", 0)
    monkeypatch.setattr(align, "_plainly", lambda a, b: None)
    assert quick == [align.script(a, b) for a, b in known]
    for pairs, (a, b), found in zip(quick, known, counts, strict=True):
        hits = sum(i >= 0 and j >= 0 and a[i] == b[j] for i, j in pairs)
        assert found == (hits, sum(i >= 0 and j >= 0 for i, j in pairs) - hits, sum(j < 0 for _, j in pairs), sum(i < 0 for i, _ in pairs))
    monkeypatch.undo()
    monkeypatch.setattr(align, "_rows", None)
    words = "a b c d e f g h".split()
    assert align.script(words, ["A" if w == "c" else w for w in words]) == [(k, k) for k in range(8)]


def test_documents_are_dealt_to_more_tasks_the_more_there_are(spark, monkeypatch):
    monkeypatch.setattr(derived, "ROWS_A_TASK", 5)
    rows = derived.load(spark, "/root/testdata/sf0.001", "documents")
    assert derived.spread(rows).rdd.getNumPartitions() >= rows.count() // 5


def test_documents_of_many_large_files_are_dealt_out_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(derived, "ROWS_A_TASK", 5)
    derived.load(spark, "/root/testdata/sf0.001", "documents").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    rows = derived.load(spark, str(tmp_path), "documents")
    assert len(rows.inputFiles()) >= spark.sparkContext.defaultParallelism
    assert derived.spread(rows).rdd.getNumPartitions() >= rows.count() // 5 and derived.spread(rows).exceptAll(rows).count() == 0


def test_lines_that_lose_and_change_signs_need_no_table(monkeypatch):
    rng = random.Random(6)
    words = ["the", "thorn", "eth", "urn", "born", "de", "ion", "ththnt", "œuvre", "straße", "\U0001f600"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40]))) for _ in range(60)]
    changes = [lambda x: x.replace("rn", "m").replace("th", "h"), lambda x: x.replace(" de ", " "), lambda x: x.replace("œ", "oe").replace("ß", "ss"), lambda x: x.replace("ion", " ion")]
    wanted = [[_plain_distance(x, f(x)) for x in lines] for f in changes]
    monkeypatch.setattr(distance, "levenshtein", None)
    monkeypatch.setattr(distance, "_in_words", None)
    assert [distance.distances(lines, [f(x) for x in lines]).tolist() for f in changes] == wanted


def test_surplus_of_letters_never_claims_too_little():
    rng = random.Random(9)
    for _ in range(3_000):
        a = "".join(rng.choice("aA!bé") for _ in range(rng.randrange(12)))
        b = "".join(_noisy(rng, a, rng.choice([0.1, 0.6]), "aA!bc\u0141"))
        more = [0] * distance.LETTER_CLASSES
        for text, sign in ((a, 1), (b, -1)):
            for c in text:
                more[ord(c) % distance.LETTER_CLASSES] += sign
        least = max(sum(x for x in more if x > 0), -sum(x for x in more if x < 0))
        assert not distance.is_made_of(a, b, more, least) or least == _plain_distance(a, b)


def test_lines_are_measured_by_text(spark):
    texts = [("a\nbc", "a\nbd\nx"), ("", ""), (None, "a"), ("a", None), ("\n\n", "x"), ("é\n", "e\n")]
    pairs = spark.createDataFrame([("e", k, "s", "c", *t) for k, t in enumerate(texts)], "engine string, doc_id int, stratum string, corpus string, gt string, hyp string")
    found = [(r.doc_id, r.line, r.gt_line, r.hyp_line, r.errors) for r in derived.lines(pairs).orderBy("doc_id", "line").collect()]
    assert found == [(0, 0, "a", "a", 0), (0, 1, "bc", "bd", 1), (0, 2, "", "x", 1), (1, 0, "", "", 0), (4, 0, "", "x", 1), (4, 1, "", "", 0), (4, 2, "", "", 0), (5, 0, "é", "e", 1), (5, 1, "", "", 0)]


@pytest.mark.parametrize("written", [formats.to_alto, formats.to_page])
def test_texts_are_escaped_once_and_not_word_by_word(spark, written):
    rows = spark.createDataFrame([("a&b\x0b<c>\x01 \x02\n\x0c\n\"d\"",), (None,)], "text string").select(written(F.col("text")).alias("xml"))
    assert not re.search(r"replace\((lambda|array_join)", rows._jdf.queryExecution().analyzed().toString())
    first, second = (r.xml for r in rows.collect())
    assert "a&amp;b" in first and "&lt;c&gt;" in first and "b&lt;" not in first and "&quot;d&quot;" in first and not re.search("[\x01\x02\x0b\x0c]", first)
    assert first.count("<TextLine>") == 2 and "<TextLine>" not in second


def test_fuzzy_search_weighs_short_words_together(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(errors, "few_edits", None)  # which measures one pair
    monkeypatch.setattr(errors, "PAIRS_AT_ONCE", 100)
    word = lambda n: "".join(rng.choices("abcdeé\U0001f600", k=n))
    hyp = [word(rng.randrange(1, 12)) for _ in range(300)]
    gt = ["".join(_noisy(rng, w, 0.3)) or "a" for w in hyp for _ in range(1 + (len(w) < 3))]
    used, wanted = [False] * len(hyp), []
    for w in gt:
        best = min(((d, k) for k, h in enumerate(hyp) if not used[k] and (d := _plain_distance(w, h)) <= 2), default=None)
        if best:
            used[best[1]] = True
        wanted.append(best is not None)
    assert 0 < sum(wanted) < len(gt) and errors.fuzzy_found(gt, hyp, 2) == wanted


def _untold(*_):
    raise AssertionError("a table was filled")


def test_joined_lines_and_lost_letters_need_no_table(monkeypatch):
    monkeypatch.setattr(distance, "levenshtein", _untold)
    rng = random.Random(2)
    gt = "\n".join(" ".join(rng.choice(["peu", "un beau", "jour", "le", "5", "eau  vu"]) for _ in range(12)) for _ in range(60))
    lines = gt.split("\n")
    joined = "".join(x + (" " if i % 3 == 0 else "\n") for i, x in enumerate(lines))[:-1].replace("u", "")
    assert distance.distances([gt], [joined]).tolist() == [gt.count("u") + 20]
    rows = [(gt, joined), (gt, gt.replace("e", "c")), (gt, "\n".join(f"folio\n{x}" for x in lines))]
    monkeypatch.setattr(rates, "levenshtein", _untold)
    got = rates.text_counts.func(*(pd.Series(c) for c in zip(*rows, strict=True)), *(pd.Series(c) for c in zip(*rows, strict=True)))
    assert got["errors"].tolist() == [gt.count("u") + 20, gt.count("e"), 6 * 60] and got["profile_errors"].tolist() == got["errors"].tolist()
    assert got["plain_word_errors"].tolist()[1:] == [sum("e" in w for w in gt.split()), 60]


def test_a_bound_opens_the_window_once(monkeypatch):
    rng = random.Random(4)
    gt = "".join(rng.choices("abcdefgh", k=4_000))
    hyp = "".join(x.replace("e", "c") for i in range(0, 4_000, 50) if (x := gt[i : i + 50]) and i % 200 != 50)
    windows, measured = [], distance._windowed
    monkeypatch.setattr(distance, "_windowed", lambda *a: windows.append(a[3]) or measured(*a))
    found = distance.distances([gt], [hyp]).tolist()
    assert len(windows) == 1 and 2 * windows[0] < len(gt) // 4
    monkeypatch.setattr(distance, "FIRST_WINDOW", 5_000)
    assert found == [distance.levenshtein(gt, hyp)]


def test_words_are_looked_for_in_a_text_that_is_made_once(spark):
    rows = [("one Two stone", "ONE two milestone x"), ("a b", ""), ("", "x"), (None, "x"), ("a b", None)]
    alto = F.when(F.col("y").isNotNull(), formats.read_alto(formats.to_alto(F.col("y"))))
    found = spark.createDataFrame(rows, "x string, y string").select(views.preserved_words(F.col("x"), alto).alias("p"))
    assert "contains(lower(" not in found._jdf.queryExecution().analyzed().toString().lower()
    assert [r.p for r in found.collect()] == [1.0, 0.0, None, None, 0.0]


@pytest.mark.parametrize("name", ["error_taxonomy", "error_heat_map", "error_clusters", "error_class_kl", "lexical_modernisation", "top_confused_characters", "word_error_rates", "profiled_error_rates"])
def test_distances_that_nothing_asks_for_are_not_measured(spark, monkeypatch, name):
    registry.load_all()
    monkeypatch.setattr(derived, "line_distances", _untold)
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "line_distances" not in plan


def test_plain_words_are_classed_without_their_forms(monkeypatch):
    monkeypatch.setattr(errors, "bare", _untold)
    monkeypatch.setattr(errors, "LIGATURES", None)
    pairs = [("presence", "prcscncc"), ("Word", "word"), ("morn", "mom"), ("tables", "xyz"), ("been", "bean")]
    assert [errors.word_class.__wrapped__(*p) for p in pairs] == ["visual_confusion", "case_error", "visual_confusion", "hapax", "hapax"]


@pytest.mark.parametrize("whole", [False, True])
def test_reading_ease_counts_in_the_text_and_not_word_by_word(spark, whole):
    texts = ["Tsk tsk, the rhythm b c. Queue!", "été œuvre n'y Straße ça", "123 ...", "", None, "a-b c\nxyz aeiou É"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.flesch(F.col("t"), as_written=whole).alias("f"))
    assert "regexp_extract_all(namedlambdavariable" not in rows._jdf.queryExecution().optimizedPlan().toString() and "aggregate(" not in rows._jdf.queryExecution().analyzed().toString()
    vowels = "aeiouyàâäáãåéèêëíîïóôöòõøúûüùÿœæ" if whole else "aeiouy"
    for r, t in zip(rows.collect(), texts, strict=True):
        found = re.findall(r"[^\W\d_]+" if whole else "[a-z]+", (t or "").lower())
        syllables = sum(max(1, len(re.findall(f"[{vowels}]+", w))) for w in found)
        assert r.f == (pytest.approx(206.835 - 1.015 * len(found) / max(1, len(re.findall("[.!?]+", t))) - 84.6 * syllables / len(found)) if found else None)
