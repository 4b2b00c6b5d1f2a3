"""Profiles, equivalences and images against plain versions."""

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmeter.functions import images as I
from glyphmeter.functions import normalise as N
from glyphmeter.plans import registry

SF_DIR = "/root/testdata/sf0.001"
registry.load_all()
TEXTS = ["vvhich ſhip & þou", "été Straße", "l'œuvre – (d’un) roi.", "vvv\nuvi", "", "ꝑ ꝓ ꝗ ꝛ y"]


def plain(text, profile):
    text = unicodedata.normalize("NFC", text)
    if profile == "caseless":
        return text.casefold()
    text = "".join(c for c in text if c not in N.EXCLUDED.get(profile, ""))
    table = N.TABLES.get(profile)
    return re.sub("|".join(sorted(map(re.escape, table), key=len, reverse=True)), lambda m: table[m[0]], text) if table else text


def test_profiles(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for profile in N.PROFILES:
        assert [r[0] for r in frame.select(N.profiled(F.col("t"), profile)).collect()] == [plain(t, profile) for t in TEXTS], profile
    with pytest.raises(KeyError):
        N.profiled(F.col("t"), "none")
    assert N.excluded_characters("', -, –") == {"'", "-", "–"} and N.excluded_characters(".,;") == set(".,;") and N.excluded_characters(None) == set() == N.excluded_characters([""])
    assert frame.select(N.equivalent(F.col("t"), "u_eq_v", "vv_eq_w")).collect()[3][0] == "wv\nwi"
    rates = {(r.engine, r.profile): r.cer for r in registry.QUERIES["profiled_error_rates"](spark, SF_DIR).collect()}
    assert rates["lower_case", "caseless"] == 0 < rates["lower_case", "nfc"] and rates["plain_letters", "nfc"] > 0 and len(rates) == 2 * len(N.PROFILES)


def test_image_scores(spark):
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (40, 30), dtype=np.uint8)
    sharp, noise, turn, contrast = I.scores(grey)
    a = grey.astype(float)
    lap = [a[y - 1, x] + a[y + 1, x] + a[y, x - 1] + a[y, x + 1] - 4 * a[y, x] for y in range(1, 39) for x in range(1, 29)]
    assert sharp == min(1, np.var(lap) / 500) and noise == 1.0 and -5 <= turn <= 5
    flat = np.full((40, 30), 200, np.uint8)
    assert I.scores(flat)[:2] == (0, 0) and I.scores(flat)[3] == 0 and I.scores(np.zeros((0, 0), np.uint8)) == (0, 0, 0, 0)
    soft = np.tile(np.linspace(50, 200, 30), (40, 1)).astype(np.uint8)
    assert 0 < I.scores(soft)[3] < 1
    sums = {d: np.var([a[i, min(29, max(0, int(np.round(i * np.tan(np.radians(d)))))) :].sum() for i in range(40)]) for d in range(-5, 6)}
    assert sums[int(turn)] == pytest.approx(max(sums.values()))
    rows = spark.createDataFrame([(40, 30, bytearray(grey.tobytes())), (40, 30, bytearray(flat.tobytes())), (9, 9, bytearray(b"x"))], "h int, w int, p binary").withColumn("s", I.image_scores("h", "w", "p"))
    got = rows.select("s.*", I.quality(F.col("s")).alias("q"), I.tier(I.quality(F.col("s"))).alias("t"), I.complexity(F.col("s")).alias("c")).collect()
    assert got[0].sharpness == pytest.approx(sharp) and got[0].q == pytest.approx(0.4 * sharp + 0.3 * contrast + 0.1 * (1 - abs(turn) / 10), abs=1e-4)
    # rows of equal sums differ most when the steepest shift cuts them off
    assert got[1].rotation == 5 and got[1].q == 0.25 and got[1].t == "poor" and got[1].c == pytest.approx(0.625) and got[2].sharpness == 0


def test_degradations():
    rng = np.random.default_rng(2)
    grey = rng.integers(0, 256, (30, 24), dtype=np.uint8)
    for kind in I.KINDS:
        out = I.degraded(grey, kind, {"noise": 10, "blur": 1, "rotation": 90, "resolution": 0.5, "binarisation": 1}[kind])
        assert out.shape == grey.shape and out.dtype == np.uint8 and (out != grey).any()
        assert (I.degraded(grey, kind, 0) == grey).all() or kind == "binarisation"
    assert I.degraded(grey, "blur", 1)[5, 5] == np.rint(grey[4:7, 4:7].mean())
    assert set(np.unique(I.degraded(grey, "binarisation", 1))) == {0, 255}
    two = np.where(rng.random((30, 24)) < 0.5, 20, 220).astype(np.uint8)
    assert ((I.degraded(two, "binarisation", 1) > 0) == (two == 220)).all()
    assert len(np.unique(I.degraded(grey, "resolution", 0.5), axis=0)) <= 15
    square = rng.integers(0, 256, (21, 21), dtype=np.uint8)
    assert (I.degraded(square, "rotation", 90) == np.rot90(square)).all() or (I.degraded(square, "rotation", 90) == np.rot90(square, -1)).all()


def test_image_queries(spark):
    docs = registry.QUERIES["image_quality_documents"](spark, SF_DIR)
    report = registry.QUERIES["image_quality_report"](spark, SF_DIR).collect()
    assert sum(r.images for r in report) == docs.count() == sum(r.good + r.medium + r.poor for r in report) and all(0 <= r.homogeneity <= 1 for r in report)
    kinds = {r.kind: r for r in registry.QUERIES["image_robustness"](spark, SF_DIR).collect()}
    assert set(kinds) == {"none", *I.KINDS} and len({r.images for r in kinds.values()}) == 1


def test_comparison(spark):
    rows = {r["class"]: r for r in registry.QUERIES["taxonomy_comparison"](spark, SF_DIR).collect()}
    assert rows["case_error"].n_b > rows["case_error"].n_a and rows["diacritic_error"].level == "recoverable"
    assert sum(r.share_a for r in rows.values()) == pytest.approx(1) and sum(r.delta for r in rows.values()) == pytest.approx(0)
    assert registry.QUERIES["scatter_points"](spark, SF_DIR).count() == 4
