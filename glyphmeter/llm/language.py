"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

#: Bounds of the training sample: documents of each language and characters of one document.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 16_384
#: Bytes of a language's dictionary, and of all together, which are broadcast: more languages have smaller ones.
DICTIONARY_BYTES, ALL_BYTES = 256 << 10, 64 << 20
#: Values of lang that can be told apart; more are an error, as lang then holds something else than languages.
MOST_LANGUAGES = 8_192
#: Characters that are encoded at once, each time from the dictionary alone; whole texts are encoded block by block.
BLOCK = 16_384
#: Effort of the encoder, the same for every text.
LEVEL = 5
#: A prediction is rejected if the runner-up is less than this share longer.
MARGIN = 0.01

_GAP = re.compile(r"[\W\d_]+")
PREDICTED = "doc_id bigint, lang_pred string, score double, rejected boolean"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Dictionaries:
    """Raw-content dictionaries by language, the most frequent first, made ready once in each worker."""

    raw: dict[str, bytes]
    ready: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return {"raw": self.raw, "ready": []}

    def compressors(self) -> list:
        if not self.ready:
            for lang, data in self.raw.items():
                kept = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                kept.precompute_compress(level=LEVEL)
                self.ready.append((lang, zstandard.ZstdCompressor(dict_data=kept, write_checksum=False, write_content_size=False, write_dict_id=False)))
        return self.ready

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected): und, 0 and True for no text, no letter or no dictionary."""
        words = _GAP.sub(" ", text.lower()).strip() if text else ""
        # what is left may be a fraction or a numeral of one character, which is no letter
        if not self.raw or not any(map(str.isalpha, words)):
            return "und", 0.0, True
        blocks = [words[i : i + BLOCK].encode() for i in range(0, len(words), BLOCK)]
        # of equal sizes, the more frequent language comes first
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), k, lang) for k, (lang, c) in enumerate(self.compressors()))
        best, second = sizes[0][0], sizes[1][0] if len(sizes) > 1 else sizes[0][0] * 2
        margin = second / best - 1
        return sizes[0][2], margin / (margin + MARGIN), margin < MARGIN


def fit(labelled: DataFrame) -> Dictionaries:
    """A dictionary for each language from labelled (doc_id, text, lang): a bounded sample chosen by a hash of doc_id.

    Of a longer text a slice of SAMPLE_CHARS at a place chosen by the hash is used. Rows without text or language are
    not used; without any row there are no dictionaries, and every text is und. More than MOST_LANGUAGES are an error.
    """
    usable = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text <> ''")
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    if not counts:
        return Dictionaries({})
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * SAMPLE_DOCS / n))])
    most = min(DICTIONARY_BYTES, ALL_BYTES // len(counts))
    pick = F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("text"))
    taken = usable.withColumn("pick", pick).where(F.try_element_at(share, F.col("lang")) > (F.col("pick") / F.lit(2.0**64) + 0.5))
    at = F.pmod(F.col("pick"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int")
    taken = taken.select("lang", "pick", F.substr("text", at + 1, F.lit(SAMPLE_CHARS)).alias("text"))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        texts, size = [], 0
        # the hash makes the first of the language's rows a random sample; equal rows are taken once
        for text in part.drop_duplicates().sort_values(["pick", "text"])["text"].iloc[:SAMPLE_DOCS]:
            texts.append(_GAP.sub(" ", text.lower()).strip().encode())
            size += len(texts[-1]) + 1
            if size >= most:
                break
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "raw": [b" ".join(texts)[-most:]]})

    # about 1.5 * SAMPLE_DOCS rows of a language meet in one task, and at most ALL_BYTES come to the driver
    raw = {r["lang"]: bytes(r["raw"]) for r in taken.groupBy("lang").applyInPandas(join, "lang string, raw binary").collect()}
    return Dictionaries({lang: raw[lang] for lang in counts if len(raw.get(lang, b"")) >= 8})


def identify(docs: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row of docs (doc_id, text), from the whole text alone.

    Null texts and texts without a letter are und, with score 0, and rejected; so are all if nothing was learned.
    Narrow margins are rejected too but keep their best language. Repeated rows give repeated results.
    """
    known = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = zip(*[known.value.judge(t.as_py()) for t in batch.column(1)], strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])
        known.value.ready.clear()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, PREDICTED)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from the rows of docs (doc_id, text, lang) that are not held out and judge all rows."""
    docs = docs.select("doc_id", "text", "lang")
    return identify(docs, fit(docs.where(~held_out(F.col("doc_id"))))).withColumn("held_out", held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose language is identified; rejected ones go. Learns as identify_documents.

    Null texts and texts without a letter go. Repeated rows stay or go together; an empty table gives an empty one.
    """
    at = docs.columns.index("text")
    known = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out(F.col("doc_id")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not known.value.judge(t.as_py())[2] for t in batch.column(at)], pa.bool_()))
        known.value.ready.clear()
        release()

    return docs.mapInArrow(run, docs.schema)
