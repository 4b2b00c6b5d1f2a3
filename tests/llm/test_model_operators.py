"""Source divergence, whitening and language-model scoring against plain versions, with nulls, ties, long and odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmeter.llm import divergence, elias_fano, ngram_lm, whitening
from glyphmeter.llm.common import U64, mix64

# --- source divergence ------------------------------------------------------------------------------------------------


def plain_audit(rows, least, top=50):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    upper = {c: c + 32 for c in range(65, 91)}
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((r[0] or "", r[1] or "", r[2] or "") for r in rows):
        found = term.findall(text.translate(upper))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        p = lambda count: {t: 1 + 10**9 * (count[t] + 5) // (sum(count[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        of = {s: p(counts[lang, s]) for s in sources}
        q = p(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(of[s][t] - of[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, of[s][t] - q[t]) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def audited(spark, rows, extra=""):
    docs = spark.createDataFrame([(*r, "x", 1) if extra else r for r in rows], "text string, lang string, source string" + extra)
    return sorted(map(tuple, divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_divergence_equals_a_plain_version_in_any_tiles(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(6)] + ["Éa", "Zz", "éa", "ÉA"]
    rows = []
    for k in range(500):
        source = f"s{min(int(rng.expovariate(0.12)), 22)}"
        own = words[hash(source) % 7 :: 7] if rng.random() < 0.4 else words
        rows.append((" ".join(rng.choice(own) + rng.choice(["", "1", "-", "_"]) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "en", "en", "fr", None]), source))
    rows += [(None, "en", "silent"), ("", "de", "a"), (None, None, None), ("\x00", "de", "b"), ("Zz " * 5, "xx", "only")]
    monkeypatch.setattr(divergence, "LEAST_DOCS", 12)
    wanted = plain_audit(rows, 12)
    assert audited(spark, rows, ", term string, n int") == wanted
    for blocks, cells, share in ((4, 40, 4), (3, 7, 2), (5, 1000, 1), (6, 60, 1000)):
        monkeypatch.setattr(divergence, "BLOCK_GROUPS", blocks)
        monkeypatch.setattr(divergence, "PART_CELLS", cells)
        monkeypatch.setattr(divergence, "DENSE_SHARE", share)
        assert audited(spark, rows) == wanted


def test_divergence_of_empty_tables_and_long_texts(spark, monkeypatch):
    assert audited(spark, []) == []
    text = "Aé b_c " * 1000 + "x" * 500
    monkeypatch.setattr(divergence, "SLICE_BYTES", 64)
    assert divergence.term_counts(text.encode()) == Counter({"aé".encode(): 1000, b"b": 1000, b"c": 1000, b"x" * 500: 1})


# --- whitening --------------------------------------------------------------------------------------------------------


def plain_scatter(rows):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in rows]
    n, width = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(width)]
    covariance = [[Fraction(sum((r[i] * n - sums[i]) * (r[j] * n - sums[j]) for r in x), n**3) for j in range(width)] for i in range(width)]
    return x, n, sums, covariance


def test_whitening_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in np.float32(rng.normal(size=(60, 12)) * np.geomspace(1, 300, 12) + 5000)]
    vectors += [vectors[0], vectors[0]]
    rows = [(k, v, "c") for k, v in enumerate(vectors)] + [(100, None, "c"), (101, [1.0, None] * 6, "c"), (102, [float("nan")] * 12, "c"), (103, [float("inf")] + [0.0] * 11, "c"), (104, [1.0] * 5, "c"), (105, [], "c")]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, component string")).collect()
    x, n, sums, covariance = plain_scatter(vectors)
    assert sorted({r.vec_id for r in got}) == list(range(62)) and len(got) == 62 * 8 and {r.n for r in got} == {62}
    exact = np.array([[float(c) for c in row] for row in covariance])
    values, directions = np.linalg.eigh(exact)
    for r in got:
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        k = -r.component
        assert r.explained == pytest.approx(values[k] / float(sum(covariance[d][d] for d in range(12))), rel=1e-9)
        z = sum(float(Fraction(n * a - s, n)) * u for a, s, u in zip(x[r.vec_id], sums, directions[:, k], strict=True)) / math.sqrt(values[k])
        assert abs(r.whitened) == pytest.approx(abs(z), rel=1e-6, abs=1e-9)
    white = np.array([[r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == k] for k in range(1, 9)])
    error = np.abs(np.cov(white, bias=True) - np.eye(8)).max()
    assert {round(r.identity_error, 12) for r in got} == {round(got[0].identity_error, 12)} and max(error, got[0].identity_error) < 1e-9


def test_products_and_pieces_are_exact_at_any_size():
    rng = random.Random(1)
    x = np.array([[rng.randrange(-(1 << b), 1 << b) for b in (3, 19, 20, 21, 40, 62)] for _ in range(5000)])
    wanted = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(6)] for i in range(6)]
    assert whitening.cross_products(x).tolist() == wanted
    for value in (0, 1, -1, 2**32, -(2**32), 2**200 + 12345, -(2**200) - 1):
        assert sum(p << 32 * k for k, p in enumerate(whitening._pieces(value))) == value


def test_whitening_of_degenerate_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(frame([(None, [float(k), 2.0 * k, 3.0]) for k in range(5)])).collect()
    assert len(line) == 5 and {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)
    huge = whitening.whiten(frame([(k, [1e30 * (-1) ** k, float(k)]) for k in range(4)])).collect()
    assert len(huge) in (4, 8) and all(r.deviation is None for r in huge)
    large = whitening.whiten(frame([(k, [1e12 * (-1) ** k, float(k)]) for k in range(4)])).collect()
    assert all(r.deviation > 2**63 for r in large)


# --- language model ---------------------------------------------------------------------------------------------------


def test_elias_fano_finds_what_it_holds():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 2**64 - 1), (7, 3), (300, 2**63), (5000, 40), (5000, 10**7), (70_000, 10**9)):
        values = np.sort(rng.integers(0, top, n, dtype=U64, endpoint=True))
        raw = elias_fano.encode(values)
        got = elias_fano.Sequence(memoryview(b"\1" * 8 + raw), 8)
        assert got.n == n and got.next == 8 + len(raw) and len(raw) % 8 == 0
        if n:
            assert (got.get(np.arange(n)) == values).all()
        begin = rng.integers(0, n, 500, endpoint=True)
        end = np.maximum(begin, rng.integers(0, n, 500, endpoint=True))
        x = np.concatenate([rng.choice(values, 250) if n else np.zeros(250, U64), rng.integers(0, top, 250, dtype=U64, endpoint=True)])
        for b, e, want, at in zip(begin, end, x, got.find(begin, end, x), strict=True):
            place = int(b + np.searchsorted(values[b:e], want))
            assert at == (place if place < e and values[place] == want else -1)


def plain_model(texts, shard):
    """P as a function of (u, v, w) and the text, from dictionaries; shard gives what a history (u, v) of a text shares its counts with."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams, c1 = Counter(), Counter()
    for t in texts:
        row = [None, None, *words(t), 0]
        grams.update((shard(u, v, t), u, v, w) for u, v, w in zip(row, row[1:], row[2:], strict=False))
        c1.update(row[2:])
    n, types = sum(c1.values()), len(c1)
    one = lambda w: (c1[w] + 0.5) / (n + 0.5 * (types + 1))
    after, before, discounts = defaultdict(Counter), defaultdict(Counter), {}
    for (s, u, v, w), c in grams.items():
        after[s, u, v][w] += c
        before[s, v][w] += 1
    rate = lambda counts: (a / (a + 2 * b) if (a := counts.count(1)) and (b := counts.count(2)) else 0.5)
    for s in {g[0] for g in grams}:
        discounts[s] = (rate([c for (x, _), k in before.items() if x == s for c in k.values()]), rate([c for g, c in grams.items() if g[0] == s]))
    mixed = lambda counts, w, d, lower: (max(counts[w] - d, 0) + d * len(counts) * lower) / sum(counts.values()) if counts else lower

    def p(u, v, w, text=None):
        s = shard(u, v, text)
        d2, d3 = discounts.get(s, (0, 0))
        return mixed(after.get((s, u, v)), w, d3, mixed(before.get((s, v)), w, d2, one(w)))

    def scored(text):
        row = [None, None, *words(text), 0]
        return len(row) - 2, sum(c1[w] > 0 for w in row[2:]), n, sum(math.log10(one(w)) for w in row[2:]), sum(math.log10(p(*g, text)) for g in zip(row, row[1:], row[2:], strict=False))

    return p, scored, c1


def hashed(word):
    if word is None or word == 0:
        return {None: ngram_lm._START, 0: ngram_lm._END}[word]
    return next(h for _, h, _ in ngram_lm.word_hashes(pa.array([word])))[0]


@pytest.mark.parametrize("tokens", [1 << 20, 60])
def test_scores_equal_a_plain_model(spark, monkeypatch, tokens):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(25)] + ["É", "The"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([3, 27])]) for _ in range(n))
    train = [text(rng.randrange(1, 25)) for _ in range(40)] + ["w1 w1 w1 w1 w1", None, "", "THE the\tThe\x0bx"] + ["w0 w0 w0 w0 w0 w0 w0"] * 12
    test = ["w1 w2 unseen w1 UNSEEN", "unseen other", "the w1 w2", text(300), None] * 2
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", tokens)
    rows = [(k // 2 if k else None, t, "z", k < len(train)) for k, t in enumerate(train + test)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, learns boolean").repartition(3)
    words = ngram_lm.learned_words(docs.where("learns").selectExpr("coalesce(text, '') AS text"))
    assert (words.shards > 1 and len(words.hot) > 0 and len(words.pairs) > 0) == (tokens == 60)

    def shard(u, v, text):
        u, v = (np.array([hashed(x)]) for x in (u, v))
        key = mix64(v * U64(0x9E3779B97F4A7C15))
        if np.isin(v, words.hot)[0]:
            key = mix64(v ^ mix64(u))
            if (at := np.flatnonzero(words.pairs == key)).size:
                salt = mix64(np.array(sum(int(h) for _, hs, _ in ngram_lm.word_hashes(pa.array([text])) for h in hs) % 2**64, U64))
                key = mix64(key ^ mix64(salt % words.parts[at]))
        return int(key[0] % U64(words.shards))

    _, scored, _ = plain_model(train, shard)
    got = sorted(ngram_lm.score(docs, docs.learns).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.base_score))
    wanted = sorted(((r[0], *scored(r[1])) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[4]))
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted, strict=True):
        assert (g.doc_id, g.n_tokens, g.n_known, g.train_tokens) == w[:4]
        assert g.base_score == pytest.approx(w[4], rel=1e-9) and g.score == pytest.approx(w[5], rel=1e-9 if tokens == 60 else 0.02)


def test_probabilities_of_all_words_sum_to_one():
    train = ["a b c a b d", "a b a", "c", ""]
    p, _, c1 = plain_model(train, lambda u, v, text: 0)
    for history in ((None, None), ("a", "b"), ("c", "b"), ("zz", "a"), ("zz", "zz")):
        assert sum(p(*history, w) for w in c1) + p(*history, "unknown") == pytest.approx(1)


def test_words_beyond_the_head_share_one_chance():
    words = ngram_lm.Words(np.array([5, 3], U64), np.array([60, 30]), 100, 6, 10, 1, *[np.zeros(0, U64)] * 3)
    codes, tail = words.codes(np.array([3, 4, 5, 9], U64))
    assert codes.tolist() == [1, 3, 0, 4] and tail.tolist() == [4, 9]
    # four words of the tail and one unknown
    assert (10 ** words.chance(np.array([0, 1]))).sum() + 5 * 10**words.tail_chance == pytest.approx(1)


def test_quantised_codes_keep_few_values_and_bin_many():
    few, many = np.repeat([-1.5, -0.25], 10), -np.random.default_rng(4).gamma(2, 1, 20_000)
    for logs, most in ((few, 0), (many, 0.05)):
        raw = ngram_lm._quantised(logs)
        table, codes = np.frombuffer(raw, np.float64, 256), np.frombuffer(raw, np.uint8, len(logs), 2048)
        assert np.quantile(np.abs(table[codes] - logs), 0.95) <= most and len(raw) % 8 == 0


def test_messages_survive_packing():
    rng = np.random.default_rng(6)
    v = np.sort(rng.integers(0, 200, 1000))
    u, w, n, tail = rng.integers(0, 2**21, 1000), rng.integers(0, 2**21, 1000), rng.integers(0, 2**31, 1000), np.sort(rng.integers(0, 2**63, 17)).astype(U64)
    u[v == v[500]].sort()
    grams, beside, got = ngram_lm.unpack(ngram_lm.pack(np.stack([u, v, w]), n, tail))
    assert (grams == [u, v, w]).all() and (beside == n).all() and (got == tail).all()


def test_pieces_of_long_texts_keep_their_histories(monkeypatch):
    texts = pa.array(["a b", None, "", "c " * 40, "d e f"])
    all_of = lambda: [tuple(x) for p in ngram_lm.events(texts) for x in zip(p.stream[p.at - 2], p.stream[p.at - 1], p.stream[p.at], p.doc, p.salt, strict=True)]
    whole = all_of()
    monkeypatch.setattr(ngram_lm, "PIECE_TOKENS", 7)
    assert all_of() == whole
    assert len(whole) == 2 + 40 + 3 + 5


def test_a_model_without_texts_and_tables_without_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert ngram_lm.score(none, F.lit(True)).count() == 0
    assert sorted(map(tuple, ngram_lm.score(some, F.lit(None).cast("boolean")).collect())) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def test_the_model_beats_word_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in ngram_lm.score(docs, ~ngram_lm.held_out(docs.doc_id)).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert rows and sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)
