"""Packing, joins, classifiers, decontamination and search against brute force."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphmeter.llm import common, decontaminate, hamming, jaccard_join, language, packing, toxicity
from glyphmeter.llm.components import connected_components

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n", "don't STOP's 12 3½ Ünïcode", "<|endoftext|> hi", "a b\x1cc d\x85e  f", "你好 世界 ΟΔΟΣ. İ ﬁ é", "x" * 500 + " '' ... !?!a b?c", "naïve× ÷5 ªº µm ß ẞ Ñ À", "Of%%% athe***", "word " * 9000]


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def test_tokens_equal_the_library(spark):
    import pyarrow as pa

    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    library, own = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    for text, ids in zip(texts, own.texts(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_packing_is_whole_gapless_and_tight(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(ODD * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece int, length string")
    got = packing.pack_documents(docs, PATH, sequence=512).collect()
    library, wanted = Tokenizer.from_file(PATH), {}
    for i, t, *_ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k, a in enumerate(range(0, len(ids), 512)):
            wanted[i, k] = (a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == wanted and len(got) == len(wanted)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_best_fit_equals_a_linear_search():
    rng = random.Random(1)
    for capacity in (1, 7, 16, 100):
        for spread in (1, 3):
            lengths = [-(-rng.randrange(1, capacity + 1) // spread) for _ in range(300)]
            counts = {n: lengths.count(n) for n in set(lengths)}
            plan, spans = packing.best_fit_decreasing(counts, capacity), {}
            for (n, nth, first, each, offset), after in zip(plan, [*plan[1:], (None, 0)], strict=True):
                for i in range((after[1] if after[0] == n else counts[n]) - nth):
                    spans.setdefault(first + i // each, []).append((offset + i % each * n, n))
            left = []
            for n in sorted(lengths, reverse=True):
                fits = [(x, i) for i, x in enumerate(left) if x >= n]
                if fits:
                    left[min(fits)[1]] -= n
                else:
                    left.append(capacity - n)
            for own in spans.values():
                assert [a for a, _ in sorted(own)] == list(np.cumsum([0] + [n for _, n in sorted(own)])[:-1])
            assert sum(map(len, spans.values())) == len(lengths)
            assert sorted(sum(n for _, n in own) for own in spans.values()) == sorted(capacity - x for x in left)


def test_packing_is_one_best_fit_at_any_number_of_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7)
    got = packing.pack_documents(docs, PATH).select("length", "sequence_id").collect()
    lengths, left = sorted((r.length for r in got), reverse=True), []
    for n in lengths:
        fits = [(x, i) for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(4096 - n)
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sorted(used.values()) == sorted(4096 - x for x in left) and len(used) <= 1.02 * -(-sum(lengths) // 4096)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {x: x for pair in links for x in pair}
    for _ in range(len(links)):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: c for x, c in parent.items() if any(x in p and p[0] != p[1] for p in links)}


def jaccard_rows():
    rng = random.Random(7)
    shared = prose(rng, 60)
    rows = []
    for _ in range(12):  # families of copies with a few changed words, all with a passage that many share
        base = prose(rng, rng.choice([8, 30, 120, 400]), 5000).split()
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(words) + (" " + shared if rng.random() < 0.5 else ""))
    base = prose(rng, 150, 9000).split()
    for i in range(60):  # one large family
        words = list(base)
        words[rng.randrange(150)] = f"v{i}"
        rows.append(" ".join(words))
    rows += [None, "", " \t", "one two", "One  TWO", "one two three", "a b c d e", "A B C D E", rows[0], rows[0], "long " * 3000]
    rng.shuffle(rows)
    return [(i, t, 9, "x") for i, t in enumerate(rows)]


def test_jaccard_components_equal_brute_force(spark):
    rows = jaccard_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint, prefix string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs).collect()}
    sets = [sets_of(t) for _, t, *_ in rows]
    comp = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in range(12):
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    assert got == {i: (len(sets[i]), comp[i]) for i in range(len(rows))}
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))


def test_jaccard_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard_join.similar_components(docs).count() == 0
    none = spark.createDataFrame([(1, None), (None, None), (2, "")], "doc_id bigint, text string")
    assert sorted(map(str, map(tuple, jaccard_join.similar_components(none).collect()))) == sorted(map(str, [(1, 0, 1), (None, 0, None), (2, 0, 2)]))


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_language_held_out_accuracy(spark, labelled):
    docs, _ = labelled
    got = language.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    accuracy, rejected = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert accuracy > 0.97 and rejected < 0.02


def test_language_edges(spark):
    rows = [(1, None, "en", 0.5), (2, "", "en", 0.5), (3, "123 ½ ²³ Ⅷ ①② !!! \n", None, 0.5), (4, "the thing that was there", "en", 0.1), (4, "the thing that was there", "en", 0.1), (None, "die der das und", "de", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    got = language.identify_documents(docs).collect()
    assert len(got) == 6 and all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in got[:3])
    assert all(0 <= r.score <= 1 for r in got) and got[3] == got[4]
    nothing = language.identify(docs, language.fit(docs.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language.identify_documents(docs.limit(0)).count() == 0
    assert language.keep_identified(docs).columns == docs.columns


def test_language_equals_a_plain_loop(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = [(10**6, "the " * 60_000, None), (10**6 + 1, None, None), (10**6 + 2, "Ⅷ", None), (10**6 + 3, "él", None)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    known = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.identify(docs, known).collect()}
    for r in docs.collect():
        words = re.sub(r"[\W\d_]+", " ", (r.text or "").lower()).strip()
        if not any(c.isalpha() for c in words):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        sizes = {}
        for lang, raw in known.raw.items():
            encoder = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(encoder.compress(words[i : i + language.BLOCK].encode())) for i in range(0, len(words), language.BLOCK))
        (best, first), (_, second) = sorted(sizes.items(), key=lambda x: (x[1], list(known.raw).index(x[0])))[:2]
        margin = second / first - 1
        assert got[r.doc_id] == (best, round(margin / (margin + language.MARGIN), 9))


def test_every_language_is_learned(spark):
    rows = [(i, f"zork{i % 3} blah{i % 3} wug{i % 3} " * (9000 if i % 3 == 2 else 3), f"l{i % 3}") for i in range(60)]
    known = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert set(known.raw) == {"l0", "l1", "l2"} and all(len(v) <= language.DICTIONARY_BYTES for v in known.raw.values())


def plain_features(text):
    """The hashed features of a text, by integers alone."""
    words = [w.encode() for w in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def word(w):
        total, power = 0, 1
        for b in w:
            total, power = total + (b + 1) * power & mask, power * 0x9E3779B97F4A7C15 & mask
        return mix((total ^ len(w) << 56) & mask)

    hashes, tags = [word(w) for w in words], [int(t) for t in toxicity._TAGS]
    out = hashes + [mix(word(w[: toxicity.STEM]) ^ tags[0]) for w in words]
    out += [mix((a * tags[g - 1] + b) & mask) for g in (1, 2, 3) for a, b in zip(hashes, hashes[g:])]
    return {x >> 64 - toxicity.BITS for x in out}


def test_toxicity_equals_a_plain_ftrl(spark):
    import math

    rng = random.Random(8)
    rows = [(i, prose(rng, 12, 30) + (" vile é" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(60)] + [(60, "", 0), (61, "a " * 20_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    order = [r.doc_id for r in docs.orderBy(F.xxhash64(F.lit("order"), "doc_id")).select("doc_id").collect() if len(rows[r.doc_id][1]) <= toxicity.SAMPLE_BYTES]
    z, n, bias = {}, {}, 1 << toxicity.BITS

    def weight(k):
        l1 = 0 if k == bias else toxicity.L1
        x = z.get(k, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((toxicity.BETA + math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for i in order:
            keys = plain_features(rows[i][1]) | {bias}
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(w.values()))) - rows[i][2]
            for k in keys:
                rate = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA
                z[k], n[k] = z.get(k, 0.0) + g - rate * w[k], n.get(k, 0.0) + g * g
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs)).collect()}
    for i, text, _ in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(weight(k) for k in plain_features(text) | {bias}))), abs=1e-5)


def test_toxicity_held_out(spark, labelled):
    docs, labels = labelled
    sample = toxicity.sampled_labels(labels.where(~language.held_out(F.col("doc_id"))))
    got = toxicity.score(docs, toxicity.fit(docs.join(sample, "doc_id"))).join(labels, "doc_id").where(language.held_out(F.col("doc_id")))
    hit, wrong, low, high = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))), F.min("score"), F.max("score")).first()
    assert hit > 0.8 and wrong < 0.02 and 0 <= low and high <= 1


def test_toxicity_edges(spark):
    rows = [(1, None, 1, 2.0), (2, "", 0, 2.0), (3, "nice words here", 0, 2.0), (4, "bad " * 50_000, 1, 2.0), (None, "x", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, score double")
    got = toxicity.score(docs, toxicity.fit(docs)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got) and got[0].score == got[1].score
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0))).count() == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.choice([3, 5, 8, 12, 20, 33, 64, 130]), 3000)) for i in range(40)] + [(100, None), (101, " "), (1, "w1 w2 w3 w4 w5 w6"), (1, "w1 w2 w3 w4 w5 w6")]
    rows = []
    for i in range(80):
        text = prose(rng, rng.choice([0, 5, 60, 900, 5000]), 3000).split()
        item = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(3)):
            if item:
                item[rng.randrange(len(item))] = "changed"
        at = rng.randrange(len(text) + 1)
        rows.append((i, "\n".join([" ".join(text[:at]).upper(), " ".join(item), " ".join(text[at:])]), 0, "x"))
    rows += [(80, None, 0, "x"), (81, "", 0, "x"), (3, rows[3][1], 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int, containment string")
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    wanted = []
    for d, text, *_ in rows:
        for i, item in items:
            s = sets_of(item)
            shared = len(s & sets_of(text))
            if s and 100 * shared >= 75 * len(s):
                wanted.append((d, i, len(s), shared))
    assert sorted((r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in decontaminate.find_items(docs, tests).collect()) == sorted(wanted)
    clean = decontaminate.drop_contaminated(docs, tests)
    bad = {d for d, *_ in wanted}
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(d for d, *_ in rows if d not in bad)
    assert decontaminate.find_items(docs, tests.limit(0)).count() == 0 and decontaminate.drop_contaminated(docs.limit(0), tests).count() == 0


def test_very_long_texts(spark):
    """Texts beyond the bytes hashed at once and the shingles searched at once; items lie across the seams."""
    rng = random.Random(21)
    words = [f"w{rng.randrange(10**6)}" for _ in range(110_000)]
    assert len(" ".join(words)) > common.SLICE_BYTES and len(words) > 3 * decontaminate.SEGMENT
    items = [(k, " ".join(words[at - 20 : at + 21])) for k, at in enumerate((20, decontaminate.SEGMENT, decontaminate.SEGMENT + 3, 2 * decontaminate.SEGMENT - 7, 70_000, len(words) - 21))] + [(99, prose(rng, 40))]
    near = list(words)
    for k in range(0, len(near), 60):
        near[k] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::-1])), (4, "x" * 900_000), (5, "x" * 900_000 + " y")]
    docs, tests = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    sets = {d: sets_of(t) for d, t in rows}
    wanted = {(d, i) for d in sets for i, t in items if 100 * len(sets[d] & sets_of(t)) >= 75 * len(sets_of(t))}
    assert {(1, i) for i in range(6)} <= wanted
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, tests).collect()} == wanted
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs).collect()}
    assert 100 * len(sets[1] & sets[2]) >= 75 * len(sets[1] | sets[2])
    assert got == {1: (len(sets[1]), 1), 2: (len(sets[2]), 1), 3: (len(sets[3]), 3), 4: (1, 4), 5: (1, 5)}
    labelled = spark.createDataFrame([(k, f"good text {k}" if k % 2 else f"vile text {k}", (k + 1) % 2) for k in range(40)], "doc_id bigint, text string, toxic int")
    weights = toxicity.fit(labelled)
    scores = {r.doc_id: r.score for r in toxicity.score(docs.union(spark.createDataFrame([(6, "vile " + " ".join(words))], docs.schema)), weights).collect()}
    for d, text in [*rows, (6, "vile " + " ".join(words))]:
        if d != 3:
            total = sum(float(weights[k]) for k in plain_features(text)) + float(weights[-1])
            assert scores[d] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-4)


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    docs = spark.createDataFrame([(i, f"start a{i} b{i} c{i} d{i} e{i} f{i} end") for i in range(10)], "doc_id bigint, text string")
    items = docs.selectExpr("doc_id AS item_id", "text")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_items(docs, items).collect()) == [(i, i) for i in range(10)]


def test_hamming_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK_CODES", 64)
    monkeypatch.setattr(hamming, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 20))
    rows = [(i, (centres[i % 5] + rng.normal(size=20) * 0.4).astype(np.float32).tolist(), "x") for i in range(300)]
    rows += [(i, rows[0][1], "x") for i in range(300, 340)] + [(340, None, "x"), (None, rows[0][1], "x"), (360, [float("nan"), 1.0, None], "x"), (380, [], "x"), (20, rows[20][1], "x")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, code string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in hamming.top_k(frame, F.col("id") % 20 == 0, 7).collect())
    bits = [(i, [bool(x is not None and x > 0) for x in e] + [False] * (24 - len(e))) for i, e, _ in rows if i is not None and e is not None]
    wanted = []
    for q, code in bits:
        if q % 20 == 0:
            near = sorted((sum(a != b for a, b in zip(code, other, strict=True)), i) for i, other in bits)[:7]
            wanted += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    # a repeated query row is answered once for each of its rows
    assert got == sorted(wanted)
    assert hamming.top_k(frame.limit(0), F.col("id") % 20 == 0, 7).count() == 0
