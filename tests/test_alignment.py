"""Edit scripts and their reports against plain versions."""

import random
from collections import Counter
from functools import cache

import numpy as np
import pytest

from glyphmeter.functions import align
from glyphmeter.operators import alignment
from glyphmeter.plans import registry

SF_DIR = "/root/testdata/sf0.001"
registry.load_all()


def best(a, b):
    """(edits, -hits) of the best script, by the recursion itself."""

    @cache
    def f(i, j):
        if not i or not j:
            return (i + j, 0)
        e, h = f(i - 1, j - 1)
        options = [(e, h - 1) if a[i - 1] == b[j - 1] else (e + 1, h)]
        for e, h in (f(i - 1, j), f(i, j - 1)):
            options.append((e + 1, h))
        return min(options)

    return f(len(a), len(b))


@pytest.mark.parametrize("cells", [align.CELLS, 6])
def test_script_is_shortest_with_most_hits(monkeypatch, cells):
    monkeypatch.setattr(align, "CELLS", cells)
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(9))] for _ in range(2))
        pairs = align.script(np.array(a, np.int64), np.array(b, np.int64))
        assert [i for i, _ in pairs if i >= 0] == list(range(len(a)))
        assert [j for _, j in pairs if j >= 0] == list(range(len(b)))
        hits = sum(i >= 0 and j >= 0 and a[i] == b[j] for i, j in pairs)
        assert (len(pairs) - hits, -hits) == best(tuple(a), tuple(b))


def test_word_error_rates(spark):
    rows = [("e", "a b c d", "a x c d e"), ("e", "", "z"), ("blank", "", "q"), ("gone", "a b", None), ("e", None, None)]
    got = {r["engine"]: r.asDict() for r in alignment.word_error_rates(spark.createDataFrame(rows, "engine string, gt_line string, hyp_line string"), "engine").collect()}
    assert [got["e"][c] for c in ("hits", "subs", "dels", "ins")] == [3, 1, 0, 2]
    assert got["e"]["wer"] == pytest.approx(3 / 4) and got["e"]["mer"] == pytest.approx(3 / 6) and got["e"]["wil"] == pytest.approx(1 - 9 / 24)
    assert got["blank"]["wer"] is None and got["blank"]["wil"] is None
    assert got["gone"]["wer"] == 1 and got["gone"]["wil"] == 1


def test_confusions_and_scores(spark):
    rows = [("e", "the uefa", "thc ucfa x"), ("e", "é b", "e b"), ("e", "", "")]
    lines = spark.createDataFrame(rows, "engine string, gt_line string, hyp_line string")
    got = {(r["g"], r["o"]): r["n"] for r in alignment.confusions(lines, "engine").collect()}
    assert got == {("e", "c"): 2, ("", "x"): 1, ("é", "e"): 1}
    from pyspark.sql import functions as F

    scores = {r["class"]: (r["total"], r["errors"]) for r in alignment.character_scores(lines, "engine", alignment.block(F.col("g"))).collect()}
    assert scores == {"Basic Latin": (8, 2), "Latin-1 Supplement": (1, 1)}


def test_registered_matrix_equals_a_plain_one(spark):
    from glyphmeter.sources import derived

    want = Counter()
    for r in derived.lines(derived.outputs(spark, SF_DIR)).select("engine", "gt_line", "hyp_line").collect():
        for x, y in align.unequal_runs(r["gt_line"], r["hyp_line"]):
            want.update((r["engine"], *p) for p in align.character_edits(x, y))
    got = {(r["engine"], r["g"], r["o"]): r["n"] for r in registry.QUERIES["confusion_matrix"](spark, SF_DIR).collect()}
    assert got == dict(want)
    assert got["e_as_c", "e", "c"] > 1000
