"""Similarity join on word shingles: grouped prefix join with exact verification and components.

1. A sketch of fixed size counts shingles over all documents; it only orders them, rare ones first.
2. A document's prefix is as many of its rarest shingles as any document similar enough must share one of. Documents
   with the same prefix and size form a group, which stands in the posting lists as one entry.
3. Entries of a list are candidates if their sizes and positions allow the similarity. A list is first joined as a
   star around one entry, in a few rounds with different ones, the first around the entry that shares most; verified
   links make components. Then every pair of a list whose entries still lie in different components is expanded to its
   members, and verified unless parity bitmaps of the two sets already differ in too many places. So no link between
   components is missed, and a large group of copies costs as many verifications as it has members.
4. Candidates whose wide parity bitmaps differ in too many places go. Verification sends the exact shingle set of each
   one that is left to the document it is compared with, once for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, release, shingle_hashes, stored
from .components import connected_components

WIDTH = 5
#: Least Jaccard similarity, as a percentage.
PERCENT = 75
#: The sketch has 2**SKETCH_BITS counters, dealt in blocks of 2**BLOCK_BITS; its ranks are one byte each.
SKETCH_BITS, BLOCK_BITS = 20, 16
#: Bytes of requests or ids that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST_BYTES = 8 << 20
#: Rounds of stars before all pairs that are still apart are compared.
STARS = 2
#: Members that are compared with one copy of a document.
FAN = 64
#: Bytes of sets that a worker holds before it hands them on.
SENT_BYTES = 2 << 20

#: Bits of a set's parity bitmap; two sets differ in at least as many shingles as their bitmaps do in bits. The wide one of
#: a larger set has two bits or more for each shingle.
PARITY_BITS = 1024

PREFIXES = "doc_id bigint, n bigint, set_key string, group_key string, prefix array<bigint>, parity array<bigint>, wide array<bigint>"


def shingle_ranks(docs: DataFrame) -> np.ndarray:
    """How common the shingles of each sketch cell are, on a logarithmic scale; from all documents."""
    cells, shift = 1 << BLOCK_BITS, U64(64 - SKETCH_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, shingles in shingle_hashes(batch.column(0), WIDTH):
                np.add.at(counts, (shingles >> shift).astype(np.int64), 1)
        blocks = [(k, np.flatnonzero(part), part[part > 0]) for k, part in enumerate(counts.reshape(-1, cells)) if part.any()]
        # what most cells need is a byte or two; the width is told by the length
        small = [(k, at.astype("<u2").tobytes(), n.astype("<u2" if n.max() < 1 << 16 else "<i8").tobytes()) for k, at, n in blocks]
        release()
        yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in small], pa.int32()), pa.array([s[1] for s in small], pa.binary()), pa.array([s[2] for s in small], pa.binary())], ["block", "cells", "counts"])

    def total(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(cells, np.int64)
        for part in parts:
            for at, n in zip(part["cells"], part["counts"], strict=True):
                where = np.frombuffer(at, "<u2")
                counts[where] += np.frombuffer(n, "<u2" if len(n) == 2 * len(where) else "<i8").astype(np.int64)
        yield pd.DataFrame({"block": [key[0]], "ranks": [np.minimum(8 * np.log2(counts + 1), 255).astype(np.uint8).tobytes()]})

    ranks = np.zeros(1 << SKETCH_BITS, np.uint8)
    rows = docs.select("text").mapInArrow(count, "block int, cells binary, counts binary").groupBy("block").applyInPandas(total, "block int, ranks binary")
    for row in rows.collect():  # 2**SKETCH_BITS bytes, whatever the input
        ranks[row["block"] * cells : (row["block"] + 1) * cells] = np.frombuffer(row["ranks"], np.uint8)
    return ranks


def prefixes(docs: DataFrame, ranks: np.ndarray, percent: int) -> DataFrame:
    """doc_id, set size, keys of the set and of its group, the prefix in rank order (none for empty sets) and the parity bitmaps."""
    known, shift = docs.sparkSession.sparkContext.broadcast(ranks), U64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, groups, parts, parities, wides = [], [], [], [], [], []
            for _, shingles in shingle_hashes(batch.column(1), WIDTH):
                own = np.unique(shingles)
                n = len(own)
                order = np.argsort(known.value[(own >> shift).astype(np.int64)], kind="stable")
                prefix = own[order[: n - -(-n * percent // 100) + 1]] if n else own
                sizes.append(n)
                sets.append(xxhash.xxh3_128_hexdigest(own.tobytes()))
                groups.append(xxhash.xxh3_128_hexdigest(prefix.tobytes() + n.to_bytes(8, "little")))
                parts.append(prefix)
                bits = max(PARITY_BITS, 1 << (2 * n - 1).bit_length()) if n else PARITY_BITS
                odd = np.bincount((own & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
                wides.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                # halves of a bitmap put together are that of half the bits
                parities.append(np.bitwise_xor.reduce(wides[-1].reshape(-1, PARITY_BITS // 64)))
            words = PARITY_BITS // 64
            parity = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * words, pa.int32()), pa.array(np.concatenate([*parities, np.empty(0, np.int64)])))
            lists = lambda rows: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.array(np.concatenate([*rows, np.empty(0, rows[0].dtype if rows else np.int64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.string()), pa.array(groups, pa.string()), lists(parts), parity, lists(wides)], ["doc_id", "n", "set_key", "group_key", "prefix", "parity", "wide"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, PREFIXES)


def may_match(n1: Column, pos1: Column, n2: Column, pos2: Column, percent: int) -> Column:
    """Whether two sets that share the shingles at these positions (from 0) of their prefixes can be similar enough."""
    small, large = F.least(n1, n2), F.greatest(n1, n2)
    # the smaller set shares one of its first few shingles already
    first = F.when(n1 <= n2, pos1).otherwise(pos2)
    second = F.when(n2 <= n1, pos2).otherwise(pos1)
    indexed = lambda p: (100 + percent) * (small - p) >= 2 * percent * small
    return (100 * small >= percent * large) & (indexed(first) | indexed(second)) & ((100 + percent) * (1 + F.least(n1 - pos1 - 1, n2 - pos2 - 1)) >= percent * (n1 + n2))


def parities_allow(n1: Column, parity1: Column, n2: Column, parity2: Column, percent: int) -> Column:
    """Whether two sets whose parity bitmaps differ so can be similar enough."""
    apart = F.aggregate(F.zip_with(parity1, parity2, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (100 + percent) * apart <= (100 - percent) * (n1 + n2)


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the wide bitmaps of sets (id, n, wide) do not rule out; few others are left, however long the texts."""
    pairs = pairs.select("a", "b").distinct().checkpoint()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().checkpoint()
    known = sets.join(_sized(ids, F.lit(32)), "id")
    side = lambda key: known.select(F.col("id").alias(key), F.col("n").alias(f"n_{key}"), F.col("wide").alias(f"wide_{key}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # sets that can be similar enough differ by one doubling at most
    least = F.least(F.size("wide_a"), F.size("wide_b"))
    folded = lambda w: F.when(F.size(w) > least, F.zip_with(F.slice(w, F.lit(1), least), F.slice(w, least + 1, least), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(w))
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(near).where(parities_allow(F.col("n_a"), folded("wide_a"), F.col("n_b"), folded("wide_b"), percent)).select("a", "b").distinct()


def _sized(df: DataFrame, row_bytes: Column) -> DataFrame:
    """df, to be broadcast if its rows have MAX_BROADCAST_BYTES at most."""
    total = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= MAX_BROADCAST_BYTES else df


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose exact sets are similar enough; about FAN of a's are compared in one place."""
    pairs = plausible(pairs, sets, percent).checkpoint()
    partners = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"))
    placed = pairs.join(partners, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / FAN)).cast("int").alias("salt")).checkpoint()
    ask = lambda doc, side: placed.select(F.col(doc).alias("doc_id"), F.struct("a", "salt", F.lit(side).alias("side")).alias("ask"))
    requests = ask("a", 0).distinct().union(ask("b", 1)).groupBy("doc_id").agg(F.collect_list("ask").alias("asks")).checkpoint()
    asked = docs.select("doc_id", "text").join(_sized(requests, 64 + 40 * F.size("asks")), "doc_id")
    schema = pa.schema([("a", pa.int64()), ("salt", pa.int32()), ("side", pa.int32()), ("b", pa.int64()), ("items", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            ids, asks = batch.column(0), batch.column(2)
            for row, shingles in shingle_hashes(batch.column(1), WIDTH):
                items = np.unique(shingles).tobytes()
                for q in asks[row].as_py():
                    rows.append((q["a"], q["salt"], q["side"], ids[row].as_py(), items))
                    size += len(items) + 64
                    if size > SENT_BYTES:
                        yield made()
                        rows, size = [], 0
        if rows:
            yield made()
        release()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, U64)
        for batch in batches:
            links = []
            for a, salt, side, b, items in zip(*(batch.column(k) for k in range(5)), strict=True):
                other = np.frombuffer(items.as_buffer(), U64)
                if side.as_py() == 0:
                    at, own = (a.as_py(), salt.as_py()), other.copy()
                elif at == (a.as_py(), salt.as_py()) and len(own) and len(other):
                    # both are sorted and distinct
                    small, large = (own, other) if len(own) <= len(other) else (other, own)
                    shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                    if 100 * shared >= percent * (len(own) + len(other) - shared):
                        links.append((at[0], b.as_py()))
            cols = list(zip(*links, strict=True)) if links else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])
        release()

    sent = asked.mapInArrow(send, "a bigint, salt int, side int, b bigint, items binary")
    return sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "side").mapInArrow(compare, "a bigint, b bigint")


def _labelled(rows: DataFrame, links: DataFrame | None, key: str) -> DataFrame:
    """rows with comp, the component of the document in key as far as links tell."""
    if links is None:
        return rows.withColumn("comp", F.col(key))
    # only documents with links are in components; the lists stay where they are while those are few
    components = _sized(connected_components(links).withColumnRenamed("node", key), F.lit(32))
    return rows.join(components, key, "left").withColumn("comp", F.coalesce("component", key)).drop("component")


def _stars(lists: DataFrame, seed: int, percent: int) -> DataFrame:
    """Candidates (a, b) around one entry a of each list, in another component than b.

    The first round's hub is the entry with the longest lists, as the text that many copies derive from has them; later
    ones are chosen by a hash. An entry that is in the lists of several hubs meets only the first of them in the same
    order, so there are no more candidates than entries, and those of a large group of copies mostly meet the same hub.
    """
    lists = lists.withColumn("order", -F.col("shared") if seed == 1 else F.xxhash64(F.lit(seed), "id"))
    hub = F.min(F.struct("order", "id", "n", "pos", "comp"))
    hubs = lists.groupBy("token").agg(hub.alias("hub")).select("token", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("id", "n", "pos", "comp", "order")])
    met = lists.join(hubs, "token").where("hub_comp <> comp").where(may_match(F.col("hub_n"), F.col("hub_pos"), F.col("n"), F.col("pos"), percent))
    first = F.min(F.struct("hub_order", "hub_id"))
    return met.groupBy(F.col("id").alias("b")).agg(first["hub_id"].alias("a")).select("a", "b")


def _crossing(lists: DataFrame, sets: DataFrame, condition: Column, percent: int) -> DataFrame:
    """All candidates (a, b) of a list that lie in different components; entries of its commonest one meet only others.

    sets (id, parity) has the bitmaps; they stand in the join's condition, so pairs that they rule out are never rows.
    """
    # most lists lie within one component by now and go before anything else is counted
    tokens = lists.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token").checkpoint()
    open_ = lists.join(_sized(tokens, F.lit(32)), "token").checkpoint()
    counts = open_.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    major = counts.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"))
    marked = open_.join(major, "token").withColumn("is_major", F.col("comp") == F.col("major")).drop("major").join(sets, "id")
    x, y = marked.where(~F.col("is_major")).alias("x"), marked.alias("y")
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("y.is_major") | (F.col("x.id") < F.col("y.id"))) & condition
    met &= parities_allow(F.col("x.n"), F.col("x.parity"), F.col("y.n"), F.col("y.parity"), percent)
    return x.join(y, met).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def similar_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest linked doc_id) of every row of docs (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of WIDTH-word shingles is percent or more. Texts
    with fewer words have their whole sequence as one shingle. Null and empty texts have an empty set and no links.
    Repeated rows come back repeated. Rows with one doc_id and different texts are one document to the links, which may
    be those of either text. Shingles are compared as 64-bit hashes.
    """
    docs = docs.select("doc_id", "text")
    base = stored(prefixes(docs, shingle_ranks(docs), percent), "prefixes")
    classes = stored(base.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("group_key").alias("group_key"), F.first("parity").alias("parity"), F.first("wide").alias("wide")), "classes")
    sets, wide = classes.select("id", "parity"), classes.select("id", "n", "wide")
    groups = classes.groupBy("group_key").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("members"))
    members = classes.join(groups.where("members > 1"), "group_key").select("group_id", "id", "n").checkpoint()

    # one entry of each group in every posting list; entries that are alone in a list are left out
    heads = base.where("n > 0").groupBy("group_key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.min_by("prefix", "doc_id").alias("prefix"))
    postings = heads.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    w, whole = Window.partitionBy("token").orderBy("n", "id"), Window.partitionBy("token")
    entry = F.struct("n", "pos")
    near = postings.withColumn("pos", F.col("pos").cast("bigint")).withColumns({"before": F.lag(entry).over(w), "after": F.lead(entry).over(w), "k": F.count(F.lit(1)).over(whole)})
    # an entry whose neighbours by size are not similar enough in size has no partner in the list
    with_one = lambda other: may_match(F.col("n"), F.col("pos"), other["n"], other["pos"], percent)
    with_many = (100 * F.col("before.n") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("after.n"))
    useful = F.when(F.col("k") == 2, with_one(F.coalesce("before", "after"))).otherwise(with_many)
    shared = Window.partitionBy("id")
    lists = stored(near.where(useful).select("token", "id", "n", "pos", F.sum("k").over(shared).alias("shared")), "lists")

    within = members.where("group_id <> id").select(F.col("group_id").alias("a"), F.col("id").alias("b"))
    links = verified(docs, _stars(_labelled(lists, None, "id"), 1, percent).union(within), wide, percent).checkpoint()
    for seed in range(2, STARS + 1):
        links = links.union(verified(docs, _stars(_labelled(lists, links, "id"), seed, percent), wide, percent)).checkpoint()

    # what is still apart: all members of the groups of a list, and all members of a group
    entries = lists.withColumnRenamed("id", "group_id").join(_sized(members.select("group_id", "id"), F.lit(32)), "group_id", "left").select("token", F.coalesce("id", "group_id").alias("id"), "n", "pos")
    apart = _crossing(_labelled(entries, links, "id"), sets, may_match(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent), percent)
    apart = apart.union(_crossing(_labelled(members.withColumnRenamed("group_id", "token").select("token", "id", "n"), links, "id"), sets, F.lit(True), percent))
    links = links.union(verified(docs, apart, wide, percent)).checkpoint()

    relabel = classes.select("set_key", "id").join(connected_components(links).withColumnRenamed("node", "id"), "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    return base.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(relabel, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, without those that a document with a smaller doc_id is linked to.

    Of each component the smallest doc_id stays, once for each different text it has. Rows without doc_id stay, as do
    texts without words; an empty table gives an empty one.
    """
    found = stored(similar_components(docs, percent), "components").where("doc_id IS NOT NULL")
    copies = found.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    left = docs.join(_sized(copies, F.lit(32)), "doc_id", "left_anti")
    if repeated.isEmpty():
        return left.select(docs.columns)
    repeated = _sized(repeated, F.lit(32))
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))
