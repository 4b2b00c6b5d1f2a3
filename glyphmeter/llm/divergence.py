"""Source divergence audit: how far the word use of each source is from that of the other sources of its language.

Terms that many sources of a language use are compared as dense tiles (groups by terms), rare terms by their postings:
from a base that takes every term as absent everywhere, a posting corrects the pairs of its own group, and two postings
of one term correct their pair. All sums are of integers, so the parts add up exactly.

A tile is a share of a language's terms and two blocks of its groups, so no task holds a language, a source or a term
whole, whatever share of the rows it has.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored

#: Documents of a language that must have a term, what is added to every count, and what frequencies are multiplied by.
LEAST_DOCS, ADDED, SCALE = 30, 5, 1_000_000_000
#: Ranks of the terms of a group.
TOP_TERMS = 50
#: Groups of a block, and cells (term and group) of a share of the terms.
BLOCK_GROUPS, PART_CELLS = 128, 32_768
#: A term is dense where more than one in so many groups of its language has it.
DENSE_SHARE = 4
#: Bytes of text that are cut into terms at once, cells that a task counts before it hands them on, pairs expanded at once.
SLICE_BYTES, HELD_CELLS, HELD_PAIRS = 1 << 20, 400_000, 1 << 20

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a UTF-8 text: runs of letters A-Z, lower-cased, and of all beyond ASCII."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE_BYTES) if len(text) - at > SLICE_BYTES else None
        end = gap.start() if gap else len(text)
        counts.update(_TERM.findall(text[at:end].lower()))
        at = end
    return counts


def group_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs of every group's terms; the term '' stands for the group itself, with all its rows."""

    def rows(held: dict) -> pa.RecordBatch:
        cols = list(zip(*((lang, source, term.decode(), n, d) for (lang, source), terms in held.items() for term, (n, d) in terms.items()), strict=True))
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(dict)
        cells = 0
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for text, lang, source in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                into = held[lang, source]
                cells -= len(into)
                for term, n in (*term_counts(text.as_py()).items(), (b"", 0)):
                    had = into.get(term)
                    if had is None:
                        into[term] = [n, 1]
                    else:
                        had[0] += n
                        had[1] += 1
                cells += len(into)
                if cells >= HELD_CELLS:
                    yield rows(held)
                    held.clear()
                    cells = 0
        if held:
            yield rows(held)
        release()

    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = texts.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)) in whole numbers; 1 where there are no terms."""
    return F.expr(f"1 + coalesce((CAST({n} + {ADDED} AS DECIMAL(20, 0)) * {SCALE}) div nullif({total} + {ADDED} * {terms}, 0), 0)")


def _dense(out: np.ndarray, dense: np.ndarray, zero: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
    """Adds, for each pair of rows and cols, the sum of |p - q| over the tile's terms less what it is for absent ones."""
    other = dense[cols]
    for k, g in enumerate(rows):
        out[k] += np.abs(other - dense[g]).sum(1) - dense.shape[1] * np.abs(zero[cols] - zero[g])


def _sparse(out: np.ndarray, term: np.ndarray, group: np.ndarray, p: np.ndarray, zero: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
    """The same for terms given by their postings (term, group, p), sorted by term: single ones first, then those in common."""

    def singles(mine: np.ndarray, others: np.ndarray) -> np.ndarray:
        """For each group of mine and of others: the sum over mine's postings of |p - other's absent| - |mine's absent - other's absent|."""
        z, got = zero[others], np.zeros((len(mine), len(others)), np.int64)
        for k, g in enumerate(mine):
            values = np.sort(p[group == g])
            sums = np.concatenate([[0], np.cumsum(values)])
            below = np.searchsorted(values, z)
            got[k] = z * below - sums[below] + sums[-1] - sums[below] - z * (len(values) - below) - len(values) * np.abs(zero[g] - z)
        return got

    out += singles(rows, cols) + singles(cols, rows).T
    place = np.full(len(zero), -1)
    place[cols] = np.arange(len(cols))
    right = np.flatnonzero(place[group] >= 0)
    where = np.full(len(zero), -1)
    where[rows] = np.arange(len(rows))
    left = np.flatnonzero(where[group] >= 0)
    first, last = np.searchsorted(term[right], term[left], "left"), np.searchsorted(term[right], term[left], "right")
    ends = np.cumsum(last - first)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_PAIRS, "right")))
        n = (last - first)[at:to]
        x = np.repeat(left[at:to], n)
        y = right[np.repeat(first[at:to] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        zx, zy = zero[group[x]], zero[group[y]]
        np.add.at(out, (where[group[x]], place[group[y]]), np.abs(p[x] - p[y]) - np.abs(p[x] - zy) - np.abs(zx - p[y]) + np.abs(zx - zy))
        at = to


def _tile(key: tuple, table: pa.Table) -> pa.Table:
    """Partial sums of |p - q| for the pairs of groups of one tile. Rows without a term give the groups, with p for absent terms."""
    lang, part, a, b = (k.as_py() for k in key)
    term, p = (table.column(c).to_numpy() for c in ("term_id", "p"))
    dense = table.column("dense").to_numpy(zero_copy_only=False)
    names, group = np.unique(table.column("source").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    own = term < 0
    zero, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    zero[group[own]], block[group[own]] = p[own], table.column("block").to_numpy()[own]
    rows, cols = np.flatnonzero(block == a), np.flatnonzero(block == b)
    out = np.zeros((len(rows), len(cols)), np.int64)
    if part == 0:
        out += table.column("terms").to_numpy()[own].max(initial=0) * np.abs(zero[rows][:, None] - zero[cols])
    if len(at := np.flatnonzero(~own & dense)):
        ids, t = np.unique(term[at], return_inverse=True)
        matrix = np.repeat(zero[:, None], len(ids), 1)
        matrix[group[at], t] = p[at]
        _dense(out, matrix, zero, rows, cols)
    if len(at := np.flatnonzero(~own & ~dense)):
        at = at[np.argsort(term[at], kind="stable")]
        _sparse(out, term[at], group[at], p[at], zero, rows, cols)
    i, j = np.nonzero(np.triu(np.ones(out.shape, bool), 1)) if a == b else np.nonzero(np.ones(out.shape, bool))
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "one": pa.array(names[rows[i]], pa.string()), "two": pa.array(names[cols[j]], pa.string()), "value": pa.array(out[i, j], pa.int64())})


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank for every group (lang, source) of docs (text, lang, source).

    Part pair: each other source of the language, by the sum over the language's kept terms of |p - q|. Part term: the
    TOP_TERMS terms that the group uses more than its language does, by p - q. p and q are frequencies in whole billionths,
    smoothed by ADDED. Null text, lang and source count as empty. A group without terms takes part with counts of zero,
    a language without kept terms has distances of zero, one with a single source has no pairs; repeated rows count as
    documents of their own; ties go by the item's bytes; other columns are not read; an empty table gives an empty result.
    """
    counts = stored(group_counts(docs), "term-counts")
    groups, terms = counts.where("term = ''").select("lang", "source"), counts.where("term <> ''")
    vocabulary = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("groups")).where(F.col("docs") >= LEAST_DOCS)
    vocabulary = stored(vocabulary.select("lang", "term", "lang_n", "groups", F.monotonically_increasing_id().alias("term_id")), "vocabulary")
    kept = stored(terms.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]), "kept-terms")
    size = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"), F.sum("groups").alias("cells"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(size, "lang", "left").na.fill(0)
    langs = langs.withColumn("blocks", F.ceil(F.col("sources") / BLOCK_GROUPS)).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("cells") / PART_CELLS)))
    totals = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    totals = stored(totals.withColumn("zero", scaled("0", "total", "terms")).withColumn("block", F.pmod(F.xxhash64("source"), "blocks")), "group-totals")
    cells = kept.join(totals, ["lang", "source"]).withColumn("p", scaled("n", "total", "terms"))

    tiles = cells.select(
        "lang", "source", "block", "blocks", F.pmod(F.xxhash64("term_id"), "parts").alias("part"), "term_id", "p", (F.col("groups") * DENSE_SHARE > F.col("sources")).alias("dense"), "terms",
    ).unionByName(totals.select(
        "lang", "source", "block", "blocks", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(-1).cast("bigint").alias("term_id"), F.col("zero").alias("p"), F.lit(False).alias("dense"), "terms",
    ))
    tiles = tiles.withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("a", F.least("block", "with")).withColumn("b", F.greatest("block", "with"))
    sums = tiles.drop("with", "blocks").groupBy("lang", "part", "a", "b").applyInArrow(_tile, "lang string, one string, two string, value bigint").groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("s"), "value")
    pairs = pairs.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    typical = cells.withColumn("q", scaled("lang_n", "lang_total", "terms")).where("n > 0 AND p > q")
    typical = typical.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(typical.withColumn("rank", rank).where(F.col("rank") <= TOP_TERMS))
