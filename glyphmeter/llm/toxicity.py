"""Toxicity: logistic regression by FTRL-proximal over hashed words, word pairs and skip-grams.

Rates are per coordinate and the L1 term keeps the weights sparse, so the model is small enough to broadcast. Training
is one sequential pass after another over a sample of bounded size, in one task, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, U64, mix64, release, word_hashes

#: Bound of the training sample, in labelled documents, and the bytes of one.
SAMPLE_DOCS = 8_000
SAMPLE_BYTES = 32_768
#: The feature space: 2**BITS weights at most; the last one is the bias.
BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
EPOCHS = 4
THRESHOLD = 0.3
#: Bytes of a word that stand for its stem.
STEM = 5

_TAGS = [U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25), U64(0xC3A5C85C97CB3127)]


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Blocks (first row, row of each feature within the block, its index, rows) of a batch of texts.

    Words are lower-cased runs of letters and digits, whole and cut to their first STEM bytes; pairs are neighbours,
    skip-grams leave out one or two words.
    """
    shift = U64(64 - BITS)
    for row, (words, stems), first in word_hashes(texts, NOT_ALNUM, STEM):
        n = len(first) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        docs, indices = [doc, doc], [words >> shift, mix64(stems ^ _TAGS[0]) >> shift]
        for gap, tag in enumerate(_TAGS, 1):
            if len(words) > gap:
                same = doc[:-gap] == doc[gap:]
                docs.append(doc[:-gap][same])
                indices.append(mix64(words[:-gap] * tag + words[gap:])[same] >> shift)
        yield row, np.concatenate(docs), np.concatenate(indices).astype(np.int64), n


class Ftrl:
    """FTRL-proximal for sparse binary features (McMahan et al. 2013)."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        # the bias, last, is not shrunk
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - rate * w
        self.n[at] += g * g


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the nonzero weights after EPOCHS passes over the rows in their order."""
    rows = []
    for _, docs, index, n in features(pa.array(texts, pa.string())):
        order = np.argsort(docs, kind="stable")
        cuts = np.searchsorted(docs[order], np.arange(1, n))
        rows += [np.append(np.unique(part), 1 << BITS) for part in np.split(index[order], cuts)]
    model = Ftrl()
    for _ in range(EPOCHS):
        for at, label in zip(rows, labels, strict=True):
            model.learn(at, label)
    weights = model.weights(np.arange((1 << BITS) + 1))
    kept = np.flatnonzero(weights)
    return kept, weights[kept]


def fit(labelled: DataFrame) -> np.ndarray:
    """Weights from labelled rows (doc_id, text, toxic), which should be a bounded sample: one task reads them in an order given by a hash.

    Rows without label or text or with more than SAMPLE_BYTES bytes are not used; without rows all weights are 0.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["pick", "doc_id", "text"])
        at, w = train(part["text"].tolist(), part["toxic"].tolist())
        return pd.DataFrame({"at": at, "w": w})

    sample = labelled.select("doc_id", "text", "toxic").where("text IS NOT NULL AND toxic IS NOT NULL").where(F.octet_length("text") <= SAMPLE_BYTES)
    sample = sample.withColumn("pick", F.xxhash64(F.lit("order"), "doc_id"))
    weights = np.zeros((1 << BITS) + 1, np.float32)
    for row in sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, "at bigint, w double").collect():  # at most 2**BITS + 1 rows
        weights[row["at"]] = row["w"]
    return weights


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row of docs (doc_id, text), from the whole text alone.

    Each feature counts once in a text. Null and empty texts get the bias alone. Repeated rows give repeated results.
    """
    kept = np.flatnonzero(weights)
    model = docs.sparkSession.sparkContext.broadcast((kept, weights[kept]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << BITS) + 1, np.float32)
        table[model.value[0]] = model.value[1]
        for batch in batches:
            sums = np.full(batch.num_rows, table[-1], np.float64)
            for row, rows_of, index, n in features(batch.column(1)):
                hot = np.flatnonzero(table[index])
                pairs = np.unique(rows_of[hot] << BITS | index[hot])
                sums[row : row + n] += np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], n)
            got = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int")


def sampled_labels(labels: DataFrame) -> DataFrame:
    """SAMPLE_DOCS labelled ids (doc_id, toxic) at most, the first by a hash. An id with several labels gets the highest."""
    ids = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return ids.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(SAMPLE_DOCS)
