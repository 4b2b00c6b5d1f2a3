"""Signs, numerals and number sequences against plain versions."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmeter.functions import philology as P
from glyphmeter.plans import registry
from glyphmeter.sources import derived

SF_DIR = "/root/testdata/sf0.001"
registry.load_all()
VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def plain_roman(s):
    s = re.sub("J$", "I", s.upper())
    if not s or set(s) - set(VALUES) or any(x in s for x in ("VV", "LL", "DD", "IIIII", "XXXXX", "CCCCC", "MMMMMM")):
        return None
    if any(VALUES[a] < VALUES[b] and a + b not in ("IV", "IX", "XL", "XC", "CD", "CM") for a, b in zip(s, s[1:], strict=False)):
        return None
    return sum(-VALUES[a] if b and VALUES[a] < VALUES[b] else VALUES[a] for a, b in zip(s, [*s[1:], None], strict=True))


def test_roman_numerals(spark):
    words = ["XIV", "xiv", "iij", "IIII", "VV", "ici", "IL", "MCMXCIX", "IIIII", "j", "jj", "mdclxvi", "DM", "viiij", "il", "cm"]
    frame = spark.createDataFrame([(" ".join(words),)], "t string")
    assert frame.select(P.romans(F.col("t"))).first()[0] == [w for w in words if plain_roman(w) is not None]
    got = {r.number: r.numeral for r in spark.range(0, 4000, 7).select(F.col("id").alias("number"), P.to_roman(F.col("id")).alias("numeral")).collect()}
    assert got[0] is None and all(plain_roman(v) == k for k, v in got.items() if k) and got[1995] == "MCMXCV"


def test_statuses(spark):
    rows = [("XIV", "en XIV.", "strict_preserved"), ("XIV", "xiv", "case_changed"), ("iij", "iii", "j_dropped"), ("iij", "III", "j_dropped"), ("XIV", "14 ans", "converted_to_arabic"), ("XIV", "XIVe 140", "lost"), ("XIV", "", "lost")]
    got = spark.createDataFrame(rows, "n string, h string, s string").select(P.roman_status(F.col("n"), F.col("h")).alias("got"), "s").collect()
    assert [r.got for r in got] == [r.s for r in got]


def test_abbreviations(spark):
    rows = [("ꝑ ꝑ ⁊ ꝯ", "per et x"), ("ꝑ p̃", "ꝑ p̃"), ("⁊", "etat"), ("", "x")]
    got = [[tuple(x) for x in r[0]] for r in spark.createDataFrame(rows, "g string, h string").select(P.abbreviation_scores(F.col("g"), F.col("h"))).collect()]
    assert got == [[("ꝑ", 2, 0, 2), ("ꝯ", 1, 0, 0), ("⁊", 1, 0, 1)], [("ꝑ", 1, 1, 1), ("p̃", 1, 1, 1)], [("⁊", 1, 0, 0)], []]


def plain_marks(text):
    before, after = r"(?:^|(?<=[\s,;:!?\(\[\«\"']))", r"(?=$|[\s,;:!?\)\]\»\"'…])"
    found = []
    for marks in P.ARCHIVE_MARKS.values():
        for m in marks:
            e = re.escape(m)
            pattern = before + e + after if "." in m else rf"\b{e}\b" if m.isascii() and m.isalnum() else e
            found += [(x.start(), -len(m), m) for x in re.finditer(pattern, text)]
    out, end = [], -1
    for start, n, m in sorted(found):
        if start >= end:
            out.append(m)
            end = start - n
    return out


def test_archive_marks(spark):
    texts = ["M. Dupont et Mme Roy, S.A.R. le 1ᵉʳ mai; arr. du bd, etc. (cf. p. 3) n° 4 «x» — l’an… M.A. barr. vve", "« M. » r.p. op. cit. ad lib. pp. 3", "", "Dr.Who Drs ép. ⚭ † ° 2ᵈᵉ XVIIIᵉ"]
    texts += [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").where("text IS NOT NULL").collect()]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.archive_marks(F.col("t")).alias("m")).collect()
    for r in got:
        assert r.m == plain_marks(r.t), r.t[:80]
    assert got[0].m[:4] == ["M.", "Mme", "S.A.R.", "1ᵉʳ"]
    row = spark.createDataFrame([("M. et M. Mme", "Monsieur et Mme")], "g string, h string").select(P.archive_scores(F.col("g"), F.col("h"))).first()[0]
    assert sorted(map(tuple, row)) == [("civility_titles", 1, True, True), ("civility_titles", 2, False, True)]


def plain_sequences(text):
    out = [("year", m[0], m[0]) for m in re.finditer(r"\b(?:1[0-9]{3}|20[0-9]{2})\b", text)]
    out += [("roman", m[0], str(v)) for m in re.finditer(r"\b[IVXLCDMivxlcdmj]+\b", text) if len(m[0]) > 1 and (v := plain_roman(m[0]))]
    out += [("foliation", m[0].strip(), re.sub(r"\s+", "", m[1]) + (m[2] or "").lower()) for m in re.finditer(r"\b(?:fol\.?|f\.|pp\.|p\.|n\.°|n°)\s*(\d+(?:\s*-\s*\d+)?)\s*([rvRV])?", text)]
    money = r"(?i)\b(\d+(?:[.,]\d+)?)\s*(livres?|sols?|deniers?|écus?|florins?|francs?|l\.|s\.|d\.|£|€|₣)(?=\b|[\s,;.!?:]|$)"
    out += [("currency", m[0], m[1].replace(",", ".") + " " + P._UNITS.get(m[2].lower(), m[2].lower())) for m in re.finditer(money, text)]
    for m in re.finditer(r"\b(?:l['’]\s*)?an\s+(?:de\s+(?:grâce|la\s+R[eé]publique)\s+)?([IVXLCDMivxlcdm]+|\d{1,4})\b", text):
        value = int(m[1]) if m[1].isdigit() else plain_roman(m[1])
        if value is not None:
            out.append(("regnal", m[0], str(value)))
    return out


SEQUENCES = ["l'an III, an de grâce 1450; f. 12v fol 3 - 4 R pp. 5 n° 9", "12 livres, 5,5 sols 8 d. 3 écus 100£ 7 francs. 4 livresque", "XIV 1789 1789 viij ici il MM", "an de la République VII an 5", ""]


def test_number_sequences(spark):
    texts = SEQUENCES + [r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.number_sequences(F.col("t")).alias("s")).collect()
    for r in got:
        assert Counter(map(tuple, r.s)) == Counter(plain_sequences(r.t)), r.t[:80]


def test_preservation_equals_greedy_matching(spark):
    want = Counter()
    for r in derived.as_written(derived.outputs, "o")(spark, SF_DIR).collect():
        gt, hyp = plain_sequences(r.gt), plain_sequences(r.hyp)
        for category in {c for c, *_ in gt}:
            left = [(f, v) for c, f, v in hyp if c == category]
            own = [(f, v) for c, f, v in gt if c == category]
            rest = []
            for f, v in own:
                same = next((x for x in left if x[0] == f), None)
                if same:
                    left.remove(same)
                    want[r.engine, category, "strict"] += 1
                    want[r.engine, category, "value"] += 1
                else:
                    rest.append(v)
            for v in rest:
                same = next((x for x in left if x[1] == v), None)
                if same:
                    left.remove(same)
                    want[r.engine, category, "value"] += 1
            want[r.engine, category, "wanted"] += len(own)
    rows = registry.QUERIES["number_sequence_preservation"](spark, SF_DIR).collect()
    got = {(r.engine, r.category, c): r[c] for r in rows for c in ("wanted", "strict", "value")}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v} and len(rows) >= 4


@pytest.mark.parametrize("name", ["early_sign_preservation", "medieval_character_coverage"])
def test_scribal_signs(spark, name):
    rows = {(r["engine"], r["class"]): r for r in registry.QUERIES[name](spark, SF_DIR).collect()}
    text = "".join(r.gt for r in derived.scribal(spark, SF_DIR).where("engine = 'keeps_some'").collect())
    if name == "early_sign_preservation":
        assert rows["keeps_some", "long_s"].total == text.count("ſ") > 0 and rows["keeps_some", "long_s"].accuracy == 0
    else:
        assert rows["keeps_some", "ꝗ"].accuracy == 1 and rows["writes_out", "ꝗ"].accuracy == 0 and rows["writes_out", "ꝗ"].total == text.count("ꝗ") > 0
