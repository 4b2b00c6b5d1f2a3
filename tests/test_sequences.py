"""Words, years and other sequences on small tables of texts."""

from collections import Counter

import pytest

from glyphmeter.plans import registry

registry.load_all()


def documents(spark, folder, *texts):
    rows = [(k, t, "fr", "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def by_engine(df):
    return {r["engine"]: r.asDict() for r in df.collect()}


def test_repeated_years_count(spark, tmp_path, monkeypatch):
    from glyphmeter.sources import derived
    from pyspark.sql import functions as F

    monkeypatch.setitem(derived.ENGINES, "drops_u", lambda gt: F.replace(gt, F.lit("1789 1789"), F.lit("1789 17B9")))
    sf_dir = documents(spark, tmp_path, "1789 1789 et 1790", "sans date")
    got = by_engine(registry.QUERIES["year_preservation"](spark, sf_dir))
    assert (got["drops_u"]["wanted"], got["drops_u"]["kept"], got["e_as_c"]["kept"]) == (3, 2, 3)
    per = {(r["engine"], r["doc_id"]): r["recall"] for r in registry.QUERIES["document_year_preservation"](spark, sf_dir).collect()}
    assert per == {(e, 0): pytest.approx(2 / 3 if e == "drops_u" else 1.0) for e in derived.ENGINES}
    assert by_engine(registry.QUERIES["distinct_year_recall"](spark, sf_dir))["drops_u"]["recall"] == 1.0


def test_a_name_is_given_once():
    with pytest.raises(ValueError):
        registry.register()(registry.QUERIES["year_preservation"])


TEXTS = ("Maître Élodie thé thè 1789é 1789", "été rue Ünal\nthé", "дом дым дым", "")


def distance(a, b):
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def accents(spark, tmp_path_factory):
    return documents(spark, tmp_path_factory.mktemp("accents"), *TEXTS)


def test_words_keep_their_letters(spark, accents):
    words = Counter(w for t in TEXTS for w in t.split())
    rare = {w for w, n in words.items() if n <= 2}
    got = by_engine(registry.QUERIES["rare_token_recall_whole"](spark, accents))
    assert {r["rare_words"] for r in got.values()} == {sum(n for w, n in words.items() if w in rare)} == {sum(words.values())}
    kept = sum((Counter(t.split()) & Counter(t.replace("e", "c").split())).total() for t in TEXTS)
    assert by_engine(registry.QUERIES["searchability_recall_whole"](spark, accents))["e_as_c"]["found"] == kept
    masked = by_engine(registry.QUERIES["rare_token_recall"](spark, accents))
    assert masked["drops_u"]["rare_words"] < got["drops_u"]["rare_words"]  # th? is three words in one


def test_sequences_of_whole_words(spark, accents):
    got = by_engine(registry.QUERIES["capitalised_preservation_whole"](spark, accents))
    # Maître, Élodie, Ünal
    assert got["drops_u"]["wanted"] == 3 and (got["e_as_c"]["kept"], got["drops_u"]["kept"]) == (1, 3)
    assert by_engine(registry.QUERIES["year_preservation_whole"](spark, accents))["drops_u"]["wanted"] == 1
    classes = {r["class"] for r in registry.QUERIES["error_class_distribution_whole"](spark, accents).collect() if r["engine"] == "e_as_c"}
    assert classes == {"non_ascii", "short"}


def test_error_rates_count_code_points(spark, accents):
    got = by_engine(registry.QUERIES["engine_aggregate_stats_whole"](spark, accents))
    lines = [x for t in TEXTS for x in t.split("\n")]
    errors = sum(distance(x, x.replace("e", "c")) for x in lines)
    ranked = by_engine(registry.QUERIES["ranking_micro_cer_whole"](spark, accents))
    assert ranked["e_as_c"]["micro_cer"] == pytest.approx(errors / sum(map(len, lines)))
    assert got.keys() == ranked.keys()


def test_whole_queries_equal_their_sql(spark, accents):
    """By the same comparison as test_queries.py, which has the larger tables."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{accents}/documents.parquet/*.parquet'")
    for name in ("searchability_recall_whole", "rare_token_recall_whole", "error_class_distribution_whole"):
        df = registry.QUERIES[name](spark, accents)
        want = con.execute(registry.ORACLES[name])
        columns = [d[0] for d in want.description]
        for a, b in zip(sorted(want.fetchall()), sorted(map(tuple, df.select(*columns).collect())), strict=True):
            assert all(x == y or x == pytest.approx(y) for x, y in zip(a, b, strict=True))
