"""Error classes, corrections, fuzzy search, invented text and matching against plain versions."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from glyphmeter.functions import blocks
from glyphmeter.functions import errors as E
from glyphmeter.functions import matching as M
from glyphmeter.functions.text import with_edit_distance
from glyphmeter.operators import errors as reports
from glyphmeter.plans import registry
from glyphmeter.sources import derived

SF_DIR = "/root/testdata/sf0.001"
registry.load_all()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_in_every_band(spark):
    rng = random.Random(2)
    base = "".join(rng.choices("abcé 𝒳", k=900))
    rows = [("", ""), ("", "abc"), (base, base), (base, ""), (base[:40], base[40:90]), ("e" * 300, "c" * 300)]
    for share in (0.01, 0.1, 0.5, 1.0):
        rows.append((base, "".join(rng.choice("xyz") if rng.random() < share else c for c in base)))
        rows.append((base, "".join(c for c in base if rng.random() > share / 2)))
    got = spark.createDataFrame(rows, "a string, b string").transform(with_edit_distance, "a", "b", "d").collect()
    assert [r.d for r in got] == [levenshtein(a, b) for a, b in rows]


@pytest.mark.parametrize(
    ("gt", "hyp", "wanted"),
    [
        ("Bonjour Monde", "bonjour monde", {"case_error": 2}),
        ("le dit roy", "ledit roy", {"segmentation_error": 1}),
        ("œuvre", "oeuvre", {"ligature_error": 1}),
        ("ꝑmet", "xmet", {"abbreviation_error": 1}),
        ("été", "ete", {"diacritic_error": 1}),
        ("corn", "com", {"visual_confusion": 1}),
        ("abc", "ab§", {"oov_character": 1}),
        ("abc", "xyz", {"hapax": 1}),
        ("a b c", "a c", {"lacuna": 1}),
        ("a c", "a zz c", {"hapax": 1}),
        ("a c", "a §§ c", {"oov_character": 1}),
        ("", "", {}),
        (None, "word", {"hapax": 1}),
    ],
)
def test_each_class(spark, gt, hyp, wanted):
    got = E.classify(gt or "", hyp)
    assert {k: v for k, v in got.items() if v} == wanted


def test_taxonomy_query_equals_a_plain_loop(spark):
    want = Counter()
    for r in derived.lines(derived.varied(spark, SF_DIR)).select("engine", "gt_line", "hyp_line").collect():
        for k, v in E.classify(r.gt_line, r.hyp_line).items():
            want[r.engine, k] += v
    got = {(r["engine"], r["class"]): r["n"] for r in registry.QUERIES["error_taxonomy"](spark, SF_DIR).collect()}
    assert got == {k: v for k, v in want.items() if v}
    top = {e: max((n, c) for (x, c), n in got.items() if x == e)[1] for e in derived.VARIED}
    assert top["plain_letters"] == "diacritic_error" and top["lower_case"] == "case_error" and top["splits_words"] == "segmentation_error" and top["loses_words"] == "lacuna"
    levels = {(r["engine"], r["level"]): r["n"] for r in registry.QUERIES["error_recoverability"](spark, SF_DIR).collect()}
    assert levels["lower_case", "recoverable"] == sum(n for (e, c), n in got.items() if e == "lower_case" and E.RECOVERABILITY[c] == "recoverable")
    heat = registry.QUERIES["error_heat_map"](spark, SF_DIR).agg(F.min("bin"), F.max("bin")).first()
    assert tuple(heat) == (0, 9)


def test_clusters_keep_every_error(spark):
    rows = [("e", "Abc 1 d, x", "abc 2 d; y")] * 3 + [("e", f"a{c}b", f"a{c.upper()}x") for c in "qwertzuiop"]
    lines = spark.createDataFrame(rows, "engine string, gt_line string, hyp_line string")
    got = {r["label"]: r["n"] for r in reports.clusters(lines, "engine", 3).collect()}
    assert len(got) == 3 and "other" in got
    assert sum(got.values()) == sum(r["n"] for r in reports.clusters(lines, "engine", 100).collect())


def test_over_normalisation(spark):
    rows = [("e", "la vraye maison", "la vraye maifon", "la vraie maison"), ("e", "a b", "x a b", "a"), ("e", "", None, "z")]
    got = reports.over_normalisation(spark.createDataFrame(rows, "engine string, gt string, before string, after string"), "engine").first()
    # right before: la, vraye, a, b; spoilt: vraye, b
    assert (got.right, got.spoilt, got.score) == (4, 2, 0.5)


def test_modernised_words(spark):
    rows = [("e", "vray roy Vray", "vrai roy vray"), ("e", "roy vray", "roy"), ("e", "", "x")]
    got = {r.token: (r.total, r.changed, r.variants) for r in reports.modernisation(spark.createDataFrame(rows, "engine string, gt_line string, hyp_line string"), "engine").collect()}
    assert got == {"vray": (2, 2, {"vrai": 1, "∅": 1})}


def plain_fuzzy(gt, hyp, most):
    used, found = [False] * len(hyp), []
    for w in gt:
        best = min(((d, k) for k, h in enumerate(hyp) if not used[k] and (d := levenshtein(w, h)) <= most), default=None)
        if best:
            used[best[1]] = True
        found.append(best is not None)
    return found


@pytest.mark.parametrize("most", [0, 1, 2])
def test_fuzzy_search_equals_a_plain_one(most):
    rng = random.Random(most)
    for _ in range(200):
        gt, hyp = (["".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(9))] for _ in range(2))
        assert E.fuzzy_found(gt, hyp, most) == plain_fuzzy(gt, hyp, most)


def test_fuzzy_search_of_words_of_any_length():
    rng = random.Random(11)
    for n in (1, 2, 3, 50, 1000, 100_000):
        word = "".join(rng.choices("abcdé", k=n))
        middle = n // 2
        near = [word[:middle] + "Z" + word[middle + 1 :], word[1:] + "y", "x" + word]
        far = word[: n // 4] + "ZZZ" + word[n // 4 :]
        assert E.fuzzy_found([word] * 4, [far, *near], 2) == [True] * 3 + [False] if n > 3 else True
        assert E.fuzzy_found([word], [far], 2) == [False] and E.fuzzy_found([word], [], 2) == [False]
    for _ in range(150):
        gt, hyp = (["".join(rng.choices("ab", k=rng.randrange(9, 16))) for _ in range(12)] for _ in range(2))
        assert E.fuzzy_found(gt, hyp, 3) == plain_fuzzy(gt, hyp, 3)


def test_blocks_are_those_of_the_standard_matcher(spark):
    rng = random.Random(6)

    def wanted(a, b):
        return [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]

    for _ in range(1500):
        letters = "abcdef"[: rng.randrange(1, 7)]
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(2))
        assert blocks.matching(a, b) == wanted(a, b)
    rows = derived.lines(derived.varied(spark, SF_DIR).where("engine IN ('splits_words', 'loses_words')")).select("gt_line", "hyp_line").collect()
    assert len(rows) > 1000
    for r in rows:
        a, b = r.gt_line.lower().split(), r.hyp_line.lower().split()
        assert blocks.matching(a, b) == wanted(a, b)
    words = [str(rng.randrange(50)) for _ in range(20_000)]
    assert sum(n for _, _, n in blocks.matching(words, words[:9000] + words[9500:])) == 19_500


def test_fuzzy_queries(spark):
    docs = {(r.engine, r.doc_id): r for r in registry.QUERIES["document_fuzzy_recall"](spark, SF_DIR).collect()}
    rows = derived.varied(spark, SF_DIR).where("length(gt) < 400").collect()
    assert len(rows) > 50
    for r in rows:
        g, h = r.gt.split(), r.hyp.split()
        found = plain_fuzzy([w.lower() for w in g], [w.lower() for w in h], 2)
        got = docs[r.engine, r.doc_id]
        assert (got.words, got.found) == (len(g), sum(found)) and got.missed == " ".join(w for w, ok in zip(g, found, strict=True) if not ok)
    total = {r.engine: (r.words, r.found) for r in registry.QUERIES["fuzzy_search_recall"](spark, SF_DIR).collect()}
    assert total["lower_case"][0] == total["lower_case"][1] > 0


def test_invented_text():
    assert E.invention("", "")[3:] == (1.0, 1.0, [], False)
    assert E.invention("", "a b")[3:5] == (0.0, 9.99) and E.invention("", "a b")[6]
    assert E.invention("a b c d", "")[3:5] == (0.0, 0.0)
    known = {"k"}
    assert E.unknown_blocks("u u u u".split(), known) == [(0, 3)]
    assert E.unknown_blocks("u k k u k k k u u".split(), known) == [(0, 3)]
    assert E.unknown_blocks("u u k u u k".split(), known) == [(0, 5)]
    words, hyp, unknown, anchor, ratio, blocks, flagged = E.invention("one two three four", "one two three x y z w four")
    assert (words, hyp, unknown, blocks, flagged) == (4, 8, 4, [{"first": 3, "last": 7}], True) and anchor == pytest.approx(1 / 6) and ratio > 1.2


def test_every_output_is_judged_for_invention(spark):
    rows = registry.QUERIES["hallucination_documents"](spark, SF_DIR)
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert rows.count() == 4 * n
    report = {r.engine: r for r in registry.QUERIES["hallucination_report"](spark, SF_DIR).collect()}
    assert report["adds_words"].documents == n and report["adds_words"].anchor > report["drops_u"].anchor and 0 < report["e_as_c"].flagged <= 1


def plain_match(refs, hyps, label, overlap, least):
    pairs = sorted((-s, i, j) for i, r in enumerate(refs) for j, h in enumerate(hyps) if r[label].casefold() == h[label].casefold() and (s := overlap(r, h)) >= least)
    used_i, used_j, out = set(), set(), []
    for _, i, j in pairs:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((i, j))
    return out


def test_matching_equals_a_plain_one(spark):
    rng = random.Random(6)
    for _ in range(200):
        spans = lambda: [{"label": rng.choice(["A", "a", "b"]), "start": (s := rng.randrange(30)), "end": s + rng.randrange(9)} for _ in range(rng.randrange(9))]
        r, h = spans(), spans()
        assert M.matched(r, h, "label", M.span_overlap, lambda e: e["start"], lambda e: e["end"], 0.5) == plain_match(r, h, "label", M.span_overlap, 0.5)
        boxes = lambda: [{"type": rng.choice("ab"), "x": float(rng.randrange(5)), "y": float(rng.randrange(20)), "w": float(rng.randrange(6)), "h": float(rng.randrange(6))} for _ in range(rng.randrange(9))]
        r, h = boxes(), boxes()
        assert M.matched(r, h, "type", M.box_overlap, lambda e: e["y"], lambda e: e["y"] + e["h"], 0.3) == plain_match(r, h, "type", M.box_overlap, 0.3)
    for name, label in (("entity_scores", "label"), ("layout_scores", "type")):
        rows = {r[label]: r for r in registry.QUERIES[name](spark, SF_DIR).collect()}
        whole = rows.pop("*")
        assert whole.tp == sum(r.tp for r in rows.values()) > 0 and whole.fn > 0 and 0 < whole.f1 < 1
