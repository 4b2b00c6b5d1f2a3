"""Tokenising whole documents and packing their pieces into sequences of a fixed length, best fit decreasing."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored

SEQUENCE = 4096
END_ID = 1
#: Bytes of text that are tokenised at once.
SLICE_BYTES = 4 << 20
_NONE = np.int64(1 << 40)

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: part and nth: the task that made a piece, and how many of its length the task made before it.
COUNTED = PIECES + ", part int, nth bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


class WordTokenizer:
    """Ids of texts under a BPE tokenizer file whose words never cross white space.

    A text is cut at ASCII white space, and each distinct chunk of a batch is tokenised once. Chunks of Latin letters
    with trailing ASCII punctuation, nearly all of them, are merged together in arrays by the file's own merge table;
    all others, and long ones, go through the tokenizers library. Both give the library's ids.
    """

    MAX_WORD = 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._fill(left << 20 | right)

    def _fill(self, keys: np.ndarray) -> None:
        """An open-addressing table from pairs to their ranks."""
        self.bits = max(18, int(len(keys) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & ((1 << self.bits) - 1)
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; _NONE where they never merge or one is missing (-1)."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left << 20 | right)
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((held != keys) & (held != -1) & (keys != -2))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def merged(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[start:end], laid out one after another, and the number of ids of each word."""
        counts, sizes = np.zeros(len(start), np.int64), end - start
        rows_of, ids_of = [], []
        for n in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == n)
            raw = data[start[rows][:, None] + np.arange(n)]
            ids = self.inner[raw]
            ids[:, -1] = self.final[raw[:, -1]]
            done_rows, live = [], rows
            ranks = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), n - 1)
            while ids.shape[1] > 1 and len(live):
                at = ranks.argmin(1)
                rank = ranks[np.arange(len(live)), at]
                going = rank < _NONE
                if not going.all():
                    done_rows.append((live[~going], ids[~going]))
                    live, ids, ranks, at, rank = live[going], ids[going], ranks[going], at[going], rank[going]
                    if not len(live):
                        break
                me, cols = np.arange(len(live)), np.arange(ids.shape[1] - 1)
                ids[me, at] = self.made[rank]
                ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
                cols = np.arange(ids.shape[1] - 1)
                if not len(cols):
                    break
                ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), 1)
                for col in (at - 1, at):
                    ok = np.flatnonzero((col >= 0) & (col < len(cols)))
                    c = col[ok]
                    ranks[ok, c] = self.rank_of(ids[ok, c], ids[ok, c + 1])
            done_rows.append((live, ids))
            for r, m in done_rows:
                if len(r):
                    counts[r] = m.shape[1]
                    rows_of.append(np.repeat(r, m.shape[1]))
                    ids_of.append(m.ravel())
        if not rows_of:
            return np.empty(0, np.int64), counts
        order = np.argsort(np.concatenate(rows_of), kind="stable")
        return np.concatenate(ids_of)[order], counts

    def chunks(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after another, and where each chunk's begin (and the end)."""
        values = values.cast(pa.large_string())
        offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
        data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None and values.buffers()[2].size else np.zeros(1, np.uint8)
        kind = _KINDS[data]
        after_c3 = np.zeros(len(data), bool)
        after_c3[1:] = data[:-1] == 0xC3
        kind[after_c3 & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)] = 1
        lower = data.copy()
        lower[(data >= 65) & (data <= 90)] += 32
        lower[after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
        odd = np.concatenate([[0], np.cumsum(kind == 0)])
        turn = np.zeros(len(data), bool)
        turn[1:] = (kind[1:] == 1) & (kind[:-1] == 2)
        turns, letters = np.concatenate([[0], np.cumsum(turn)]), np.concatenate([[0], np.cumsum(kind == 1)])
        a, b = offsets[:-1], offsets[1:]
        full = b > a
        first = np.minimum(a, len(data) - 1)
        fast = full & (odd[b] == odd[a]) & (kind[first] == 1) & (turns[b] == turns[np.minimum(a + 1, len(data))]) & (b - a <= self.MAX_WORD)
        cut = a + (letters[b] - letters[a])
        spans_a = np.where(fast, a, 0), np.where(fast, cut, 0)
        spans_b = np.where(fast, cut, 0), np.where(fast, b, 0)
        start = np.stack([spans_a[0], spans_b[0]], 1).ravel()
        end = np.stack([spans_a[1], spans_b[1]], 1).ravel()
        ids, counts = self.merged(lower, start, end)
        counts = counts.reshape(-1, 2).sum(1)
        slow = np.flatnonzero(full & ~fast)
        if len(slow):
            got = [e.ids for e in self.library.encode_batch(values.take(pa.array(slow)).to_pylist(), add_special_tokens=False)]
            total = counts.copy()
            total[slow] = [len(g) for g in got]
            at, own, out = np.cumsum(total) - total, np.cumsum(counts) - counts, np.empty(total.sum(), np.int64)
            out[np.repeat(at - own, counts) + np.arange(len(ids))] = ids
            more = np.array([i for g in got for i in g], np.int64)
            out[np.repeat(at[slow] - (np.cumsum(total[slow]) - total[slow]), total[slow]) + np.arange(len(more))] = more
            ids, counts = out, total
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
        row = 0
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(sizes, sizes[row] + SLICE_BYTES, "right")) - 1)
            split = pc.ascii_split_whitespace(texts.slice(row, stop - row))
            bounds = split.offsets.to_numpy()
            coded = split.flatten().dictionary_encode()
            ids, at = self.chunks(coded.dictionary)
            index = coded.indices.to_numpy()
            sizes_of = (at[1:] - at[:-1])[index]
            ends = np.concatenate([[0], np.cumsum(sizes_of)])
            laid = ids[np.repeat(at[:-1][index] - ends[:-1], sizes_of) + np.arange(ends[-1])]
            edges = ends[bounds - bounds[0]]
            for k in range(stop - row):
                yield laid[edges[k] : edges[k + 1]]
            row = stop


#: 1: ASCII letters and the lead byte of Latin-1 letters; 2: ASCII punctuation but the apostrophe; 0: all else.
_KINDS = np.zeros(256, np.uint8)
_KINDS[65:91] = _KINDS[97:123] = _KINDS[0xC3] = 1
_KINDS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2


def _byte_chars() -> list[str]:
    """The printable character that byte-level BPE files write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and end_id, cut into pieces of at most sequence ids: doc_id, piece, start, length, ids_crc32, part, nth.

    docs has doc_id and text. Null and empty texts have the end id alone; texts of any length are taken whole. The
    pieces should be stored before they are packed, as part and nth must not change any more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, seen = WordTokenizer(tokenizer_path), TaskContext.get().partitionId(), [0] * (sequence + 1)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.texts(batch.column(1)), strict=True):
                raw = np.append(ids, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(raw), sequence)):
                    own = raw[start : start + sequence]
                    rows.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                    seen[len(own)] += 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in COUNTED.split(", ")])
        del tokenizer
        release()

    return docs.select("doc_id", "text").mapInArrow(run, COUNTED)


class OpenBins:
    """Open bins by remaining capacity, as runs of bins that are filled alike; a segment tree over the capacities finds the tightest that still fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _change(self, left: int, by: int) -> None:
        node = left + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, left: int, first: int, bins: int) -> None:
        """Open the bins from first on, each with so much left; full ones are closed."""
        if left and bins:
            self.runs[left].append((first, bins))
            self._change(left, 1)

    def take(self, need: int) -> tuple[int, int, int] | None:
        """(remaining capacity, first bin, bins) of a run of tightest bins with at least need left, taken out; None if there is none."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        left = node - self.leaves
        first, bins = self.runs[left].pop()
        self._change(left, -1)
        return left, first, bins


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """How best fit decreasing packs counts[n] pieces of each length n, the longest first, each into the tightest open bin.

    Rows (length, nth, bin, each, offset) in the order of length and nth: the pieces of the length from the nth on, up to
    the next row, go into the bins from bin on, each of them into one bin, from its offset on. Pieces of one length are
    alike, and a bin that took one and can take another is the tightest for it, so runs of equal bins are filled
    together: the work grows with the lengths and their runs, not with the pieces.
    """
    tree, made, rows = OpenBins(capacity), 0, []
    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        nth = 0
        while nth < counts[n]:
            rest = counts[n] - nth
            if found := tree.take(n):
                left, first, bins = found
            else:
                left, first, bins = capacity, made, -(-rest // (capacity // n))
                made += bins
            each = left // n
            whole = min(bins, rest // each)
            if whole:
                rows.append((n, nth, first, each, capacity - left))
                tree.add(left - each * n, first, whole)
                nth += whole * each
            if whole < bins and nth < counts[n]:
                last = counts[n] - nth  # fewer than fill a bin
                rows.append((n, nth, first + whole, each, capacity - left))
                tree.add(left - last * n, first + whole, 1)
                nth, whole = nth + last, whole + 1
            tree.add(left, first + whole, bins - whole)
    return sorted(rows)


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """pieces (as tokenize_pieces gives them, stored) with sequence_id and offset: no sequence above the limit, no gaps within one.

    One packing of all pieces, whatever their number: the counts of the lengths come to the driver, at most one for
    each of them, and the plan made of them goes to the tasks. A piece finds its place in the plan by its rank among
    those of its length: nth, and how many of the length the tasks before its own made. Repeated rows are packed each
    for itself; no pieces give no sequences.
    """
    made = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = made.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "earlier"))).alias("earlier"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = np.array(best_fit_decreasing(counts, sequence), np.int64).reshape(-1, 5)
    known = pieces.sparkSession.sparkContext.broadcast(plan)
    ranked = pieces.join(earlier, "part").select(*[c.split()[0] for c in PIECES.split(", ")], (F.col("nth") + F.col("earlier")[F.col("length")]).alias("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = known.value
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            length, nth = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = plan[np.searchsorted(keys, (length << 48) + nth, "right") - 1] if len(nth) else np.empty((0, 5), np.int64)
            past = nth - row[:, 1]
            place = [pa.array(row[:, 2] + past // row[:, 3]), pa.array(row[:, 4] + past % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), *place], [c.split()[0] for c in PACKED.split(", ")])

    return ranked.mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Tokenise all docs (doc_id, text) and pack them; see tokenize_pieces and pack."""
    return pack(stored(tokenize_pieces(docs, tokenizer_path, sequence, end_id), "pieces"), sequence)
