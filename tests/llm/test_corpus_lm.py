"""The model of the whole corpus: the same scores from any number of shards, equal to a plain version."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmeter.llm import corpus_lm, ngram_lm


def plain_model(texts):
    """P as a function of (u, v, w), a text's row of results, and the counts of words, from dictionaries."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams, c1 = Counter(), Counter()
    for t in texts:
        row = [None, None, *words(t), 0]
        grams.update(zip(row, row[1:], row[2:], strict=False))
        c1.update(row[2:])
    n, types = sum(c1.values()), len(c1)
    one = lambda w: (c1[w] + 0.5) / (n + 0.5 * (types + 1))
    after, before, below = defaultdict(Counter), defaultdict(Counter), defaultdict(list)
    for (u, v, w), c in grams.items():
        after[u, v][w] += c
        before[v][w] += 1
        below[v].append(c)
    rate = lambda counts: (counts.count(1) + 6) / (counts.count(1) + 2 * counts.count(2) + 8)
    mixed = lambda counts, w, d, lower: (max(counts[w] - d, 0) + d * len(counts) * lower) / sum(counts.values()) if counts else lower

    def p(u, v, w):
        return mixed(after.get((u, v)), w, rate(below.get(v, [])), mixed(before.get(v), w, rate([*before[v].values()] if v in before else []), one(w)))

    def scored(text):
        row = [None, None, *words(text), 0]
        return len(row) - 2, sum(c1[w] > 0 for w in row[2:]), n, sum(math.log10(one(w)) for w in row[2:]), sum(math.log10(p(*g)) for g in zip(row, row[1:], row[2:], strict=False))

    return p, scored, c1


def corpus_of(seed=8):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(25)] + ["É", "The"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([3, 27])]) for _ in range(n))
    train = [text(rng.randrange(1, 25)) for _ in range(40)] + ["w1 w1 w1 w1 w1", None, "", "THE the\tThe\x0bx"] + ["w0 w0 w0 w0 w0 w0 w0"] * 12
    test = ["w1 w2 unseen w1 UNSEEN", "unseen other", "the w1 w2", text(300), None, "new " * 700, "w2 w2 " * 300 + "w26"] * 2
    return train, [(k // 2 if k else None, t, "z", k < len(train)) for k, t in enumerate(train + test)]


def test_scores_are_those_of_the_whole_corpus_from_any_number_of_shards(spark, monkeypatch):
    train, rows = corpus_of()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, learns boolean").repartition(3)
    _, scored, _ = plain_model(train)
    by = lambda r: (r[0] is not None, r[0] or 0, r[4])
    wanted, scores = sorted(((r[0], *scored(r[1])) for r in rows), key=by), []
    for tokens in (1 << 20, 400, 60, 11):
        monkeypatch.setattr(corpus_lm, "SHARD_TOKENS", tokens)
        corpus, _ = corpus_lm.learned(docs.select(F.coalesce("text", F.lit("")), "learns"))
        assert (corpus.shards > 1) == (len(corpus.hot) > 1) == (len(corpus.pairs) > 1) == (tokens < 1 << 20)
        got = sorted(map(tuple, corpus_lm.score(docs, docs.learns).collect()), key=by)
        assert len(got) == len(wanted)
        for g, w in zip(got, wanted, strict=True):
            assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9)
            # each token has three codes at most
            assert abs(g[5] - w[5]) <= 3 * w[1] / 2 / corpus_lm.STEPS + 1e-9
        scores.append([(*g[:4], g[5]) for g in got])
    assert all(s == scores[0] for s in scores)


def test_probabilities_of_all_words_sum_to_one():
    p, _, c1 = plain_model(["a b c a b d", "a b a", "c", ""])
    for history in ((None, None), ("a", "b"), ("c", "b"), ("zz", "a"), ("zz", "zz")):
        assert sum(p(*history, w) for w in c1) + p(*history, "unknown") == pytest.approx(1)


def test_words_beyond_the_head_are_scored_alike_from_any_number_of_shards(spark, monkeypatch):
    train, rows = corpus_of(3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, learns boolean").repartition(2)
    monkeypatch.setattr(corpus_lm, "HEAD_SHARE", 12)
    _, scored, _ = plain_model(train)
    runs = []
    for tokens in (1 << 20, 50):
        monkeypatch.setattr(corpus_lm, "SHARD_TOKENS", tokens)
        runs.append(sorted((r.doc_id or -1, r.n_known, round(r.base_score, 6), r.score) for r in corpus_lm.score(docs, docs.learns).collect()))
    assert runs[0] == runs[1]
    assert [r[:3] for r in runs[0]] == sorted((r[0] or -1, (s := scored(r[1]))[1], round(s[3], 6)) for r in rows)


@pytest.mark.parametrize("share", [1, 12])
def test_words_beyond_the_head_have_chances_of_their_own(spark, monkeypatch, share):
    train, rows = corpus_of(5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, learns boolean").repartition(3)
    monkeypatch.setattr(corpus_lm, "HEAD_SHARE", share)
    _, scored, _ = plain_model(train)
    by = lambda r: (r[0] is not None, r[0] or 0, r[4])
    wanted = sorted(((r[0], *scored(r[1])) for r in rows), key=by)
    for tokens in (1 << 20, 60):
        monkeypatch.setattr(corpus_lm, "SHARD_TOKENS", tokens)
        got = sorted(map(tuple, corpus_lm.score(docs, docs.learns).collect()), key=by)
        for g, w in zip(got, wanted, strict=True):
            assert g[:4] == w[:4] and abs(g[5] - w[5]) <= 3 * w[1] / 2 / corpus_lm.STEPS + 1e-9


def test_a_text_that_repeats_a_trigram_sends_it_once(spark):
    empty = np.zeros(0, np.uint64)
    corpus = corpus_lm.Corpus(ngram_lm.Words(empty, np.zeros(0, np.int64), 0, 0, 0, 1, empty, empty, empty), 1, empty, empty, empty, np.zeros((4, 0)), empty, np.zeros((2, 0)))
    (piece,) = ngram_lm.events(pa.array(["c " * 700, "c c c"]))
    _, [(_, message)] = corpus.messages(piece, piece.doc << 1 | 1)
    grams, beside, _ = ngram_lm.unpack(message)
    assert len(beside) < 20 and ((beside >> corpus_lm._ROW_BITS) + 1).sum() == 701 + 4


def test_a_model_without_texts_and_tables_without_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert corpus_lm.score(none, F.lit(True)).count() == 0
    assert sorted(map(tuple, corpus_lm.score(some, F.lit(None).cast("boolean")).collect())) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def test_the_model_beats_word_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in corpus_lm.score(docs, ~ngram_lm.held_out(docs.doc_id)).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert rows and sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)
