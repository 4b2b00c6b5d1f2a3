"""Token operators: multisets of words of ground truth and outputs, and what follows from their counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

#: White space as column functions split by it.
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
#: Words of a batch that goes back.
WORDS_AT_ONCE = 20_000


def _words(text: str | None) -> list[str]:
    return [w for w in _SPACE.split(text or "") if w]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, token, g and h of batches of doc_id, gt and hyps, in batches of WORDS_AT_ONCE words, or of one document's."""
    rows, tokens, g, h, ends = [], [], [], [], [0]

    def made(ids: pa.Array) -> pa.RecordBatch:
        found = [ids.take(pa.array(rows, pa.int64())), pa.array(tokens, pa.string()), pa.array(g, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h, pa.int64()))]
        for column in (rows, tokens, g, h):
            column.clear()
        ends[:] = [0]
        return pa.RecordBatch.from_arrays(found, ["doc_id", "token", "g", "h"])

    for batch in batches:
        ids = batch.column(0)
        for row, (gt, hyps) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            own, others = Counter(_words(gt.as_py())), [Counter(_words(x)) for x in hyps.as_py()]
            words = dict.fromkeys(chain(own, *others))
            if tokens and len(tokens) + len(words) > WORDS_AT_ONCE:
                yield made(ids)
            for word in words:
                rows.append(row)
                tokens.append(word)
                g.append(own[word])
                h.extend([c[word] for c in others])
                ends.append(len(h))
        if tokens:
            yield made(ids)


def counts_by_document(documents: DataFrame) -> DataFrame:
    """doc_id, token, g and h of documents (doc_id, gt, hyps): how often each word is in the ground truth, and in each output.

    All texts of a document are in one row, so words are counted where they are and nothing is shuffled for it. Null texts
    count as empty. Words go back in batches of a bounded size, however many documents come at once.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "gt", "hyps").mapInArrow(count_batches, f"doc_id {kind}, token string, g bigint, h array<bigint>")


def token_counts(counts: DataFrame, *engines: str) -> DataFrame:
    """engine, doc_id, token, g and h of counts_by_document: a row for each engine whose output or ground truth has the word."""
    each = F.array(*[F.struct(F.lit(e).alias("engine"), F.col("h")[k].alias("h")) for k, e in enumerate(engines)])
    return counts.select("doc_id", "token", "g", F.explode(each).alias("e")).select("e.engine", "doc_id", "token", "g", "e.h").where("g > 0 OR h > 0")


_TRIPLES = ArrayType(StructType().add("ng", LongType()).add("nh", LongType()).add("anchor", DoubleType()))


def _triples(words: list[str]) -> Iterator[tuple[str, ...]]:
    return zip(words, words[1:], words[2:], strict=False)


@F.pandas_udf(_TRIPLES)
def anchored(gt: pd.Series, hyps: pd.Series) -> pd.Series:
    """Of each output of a document: words of both sides, and the share of its word triples that the ground truth has, null without one."""
    out = []
    for x, ys in zip(gt, hyps, strict=True):
        g = _words(x)
        known, found = set(_triples(g)), []
        for y in ys:
            h = _words(y)
            held = sum(map(known.__contains__, _triples(h)))
            found.append({"ng": len(g), "nh": len(h), "anchor": held / (len(h) - 2) if len(h) > 2 else None})
        out.append(found)
    return pd.Series(out, dtype=object)


def hits() -> Column:
    return F.least("g", "h")


def missing() -> Column:
    return F.greatest(F.col("g") - F.col("h"), F.lit(0))


#: What tells a word with characters beyond ASCII and a capital: under the ASCII profile, and in texts as they are.
LOOKS = {False: (r"\?", "^[A-Z]"), True: (r"[^\x00-\x7F]", r"^\p{Lu}")}


ERROR_CLASSES = ("capital", "digit", "non_ascii", "punctuation", "short", "word")


def error_class(token: Column, as_written: bool = False) -> Column:
    """A coarse class of a lost word, told by its look."""
    beyond, capital = LOOKS[as_written]
    return F.when(token.rlike("[0-9]"), "digit").when(token.rlike(beyond), "non_ascii").when(token.rlike(capital), "capital").when(token.rlike("[.,;:!]$"), "punctuation").when(F.length(token) <= 3, "short").otherwise("word")


ERROR_CLASS_SQL = r"CASE WHEN regexp_matches(token, '[0-9]') THEN 'digit' WHEN regexp_matches(token, '\?') THEN 'non_ascii' WHEN regexp_matches(token, '^[A-Z]') THEN 'capital' WHEN regexp_matches(token, '[.,;:!]$') THEN 'punctuation' WHEN length(token) <= 3 THEN 'short' ELSE 'word' END"
