"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by the size of their shingle set, (u/2, u] for powers of two. For each partition a document
is read as overlapping windows of 1.5 u shingles, u/2 apart, so that a window around a contained item is of comparable
size and their Jaccard similarity is high (0.23 at the least for a containment of 0.75), however long the document.
A window and an item that share a MinHash value are candidates; the shingles of the whole document then decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, release, shingle_hashes

WIDTH = 5
#: Least share of an item's shingles, as a percentage.
PERCENT = 75
#: MinHash functions, each a band of its own. An item whose shared shingles lie in one window is missed with a chance of
#: 3e-5 at most at a containment of 0.75. Where they lie apart each window shares fewer of them and there is no such bound;
#: of 1,200 items of 30 to 200 words cut into up to eight parts, 300 words apart, none was missed (a simulation).
HASHES = 40
#: Items of one block, and the bytes of their texts; a block is broadcast, and each block is a pass over the documents.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
#: Shingles of a document whose hash values are laid out at once.
SEGMENT = 1 << 15
#: Items with up to this many shingles are their own class: windows of one shingle.
TINY = 8

FOUND = "doc_id bigint, key string, item_shingles bigint, shared_shingles bigint, containment double"


class ItemIndex:
    """The items of one block: their shingles, and their MinHash values by size class."""

    def __init__(self, ids: list, texts: list, hashes: int = HASHES):
        rng = np.random.default_rng(20240607)
        self.mult = rng.integers(0, 1 << 63, hashes, dtype=U64) * U64(2) + U64(1)
        self.plus = rng.integers(0, 1 << 63, hashes, dtype=U64)
        self.tags = mix64(np.arange(1, hashes + 1, dtype=U64))
        sets = [np.unique(h) for _, h in shingle_hashes(pa.array(texts, pa.string()), WIDTH)]
        keep = [i for i, s in enumerate(sets) if len(s)]
        self.ids, self.sets = [ids[i] for i in keep], [sets[i] for i in keep]
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            classes.setdefault(1 if len(s) <= TINY else 1 << (len(s) - 1).bit_length(), []).append(i)
        self.classes = {}
        for u, members in sorted(classes.items()):
            keys = np.concatenate([self.values(self.sets[i]).min(1) ^ self.tags for i in members])
            owners = np.repeat(np.array(members), hashes)
            order = np.argsort(keys, kind="stable")
            bits = min(22, max(16, int(len(keys) * 64).bit_length()))
            seen = np.zeros(1 << bits, bool)
            seen[(keys & U64((1 << bits) - 1)).astype(np.int64)] = True
            self.classes[u] = (keys[order], owners[order], seen, U64((1 << bits) - 1))
        self.overlap = 2 * max(self.classes, default=1)

    def values(self, shingles: np.ndarray) -> np.ndarray:
        return shingles[None, :] * self.mult[:, None] + self.plus[:, None]

    def candidates(self, shingles: np.ndarray) -> set[int]:
        """Items that share a MinHash value with a window of these shingles, which are in the order of the text."""
        out: set[int] = set()
        for at in range(0, max(1, len(shingles) - self.overlap), SEGMENT):
            part = shingles[at : at + SEGMENT + self.overlap]
            blocks, size = self.values(part), 1
            for u, (keys, owners, seen, mask) in self.classes.items():
                while size < u // 2:
                    if blocks.shape[1] % 2:
                        blocks = np.concatenate([blocks, blocks[:, -1:]], 1)
                    blocks, size = np.minimum(blocks[:, ::2], blocks[:, 1::2]), size * 2
                windows = blocks
                if u > 1:
                    for _ in range(2):
                        if windows.shape[1] > 1:
                            windows = np.minimum(windows[:, :-1], blocks[:, -windows.shape[1] + 1 :])
                got = windows ^ self.tags[:, None]
                got = got[seen[(got & mask).astype(np.int64)]]
                if len(got):
                    lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                    for a, b in {(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a}:
                        out.update(owners[a:b].tolist())
        return out


    def contained(self, shingles: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """(item, shared shingles) for every item of which the text with these shingles holds percent or more."""
        out = []
        if self.ids and len(shingles) and (found := self.candidates(shingles)):
            whole = np.unique(shingles)
            for i in sorted(found):
                at = np.minimum(np.searchsorted(whole, self.sets[i]), len(whole) - 1)
                shared = int((whole[at] == self.sets[i]).sum())
                if 100 * shared >= percent * len(self.sets[i]):
                    out.append((i, shared))
        return out


def keyed(items: DataFrame) -> DataFrame:
    """item_id, key and text of the items that have a text; equal texts have one key."""
    return items.where("text IS NOT NULL").select("item_id", F.md5(F.encode("text", "UTF-8")).alias("key"), "text")


def item_blocks(items: DataFrame) -> Iterator[Broadcast]:
    """Broadcast indexes of the different texts of items (item_id, text), by key, in blocks of a bounded size, one after another.

    Texts are dealt to blocks by their key, so that each has about its share; a text is in one block only.
    """
    texts = keyed(items).select("key", "text").distinct()
    n, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for block in range(blocks):
        rows = (texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)).collect()
        yield items.sparkSession.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows]))


def find_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of a document (doc_id, text) and a test item (item_id, text) whose shingles it holds to percent or more.

    Whole texts are searched; words are split and lower-cased as in common.word_hashes. The containment is the share
    of the item's distinct shingles that the whole document has, counted exactly over their 64-bit hashes. Null and empty texts and items match nothing. Every
    row counts for itself, so repeated documents or items give repeated pairs; empty tables give no pairs.
    Items come to the driver in blocks of a bounded size; documents are read once for each block and never shuffled.
    """
    docs = docs.select("doc_id", "text")

    def passed(index: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in batches:
                doc_ids, rows = batch.column(0), []
                for row, shingles in shingle_hashes(batch.column(1), WIDTH):
                    for i, shared in known.contained(shingles, percent):
                        rows.append((doc_ids[row].as_py(), known.ids[i], len(known.sets[i]), shared, shared / len(known.sets[i])))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "key", "item_shingles", "shared_shingles", "containment"])
            release()

        return docs.mapInArrow(run, FOUND)

    found = reduce(DataFrame.unionByName, map(passed, item_blocks(items)))
    # a text that several items have is searched once
    return found.join(keyed(items).select("key", "item_id"), "key").select("doc_id", "item_id", "item_shingles", "shared_shingles", "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item to percent or more; see find_items."""
    at = docs.columns.index("text")
    for index in item_blocks(items):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, shingles in shingle_hashes(batch.column(at), WIDTH):
                    keep[row] = not index.value.contained(shingles, percent)
                yield batch.filter(pa.array(keep))
            release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
