"""Language-model scoring: an interpolated trigram model in Elias-Fano tries, one for each shard of the histories.

A shard has the trigrams (u, v, w) whose middle word v falls to it. The trigrams of a word that would fill a shard are
dealt by (v, u), and those of a pair that would fill one by (v, u) and a hash of their text; the counts that follow v, or
u v, are then those of the shard. Each shard learns from the texts that the model may see and scores all texts, so an
event travels once. Within a trie, the root's children are the words v; below each stand its successors w, and apart from
them its predecessors u; the children of a predecessor are the w that follow u v, written as places among the successors
of v. Pointers and children are monotone Elias-Fano sequences, where each list of children goes on from the last value of
the one before it. Probabilities and back-off weights are codes of one byte into a table of the shard.

P(w | u v) = (c(uvw) - D3) / c(uv) + D3 t(uv) / c(uv) * P(w | v), with t the number of different successors;
P(w | v) = (k(vw) - D2) / k(v) + D2 t(v) / k(v) * P(w), with k(vw) the number of different u before v w (Kneser-Ney);
P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) for the words of the head, and the mean of that over all other words and one
unknown word for each of those. D is n1 / (n1 + 2 n2) of its counts. The probabilities of all words after a history sum
to one, but for the codes.

Words are compared as 64-bit hashes. Every count is over all training texts; nothing is pruned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import elias_fano
from .common import U64, mix64, release, stored, word_hashes

#: Training tokens of a shard, on average, and shards whose sums for a document travel together.
SHARD_TOKENS, TOGETHER = 1 << 20, 4
#: Words of the head have at least one in so many training tokens, so there are no more of them.
HEAD_SHARE = 1 << 20
#: Tokens that a task sorts, and events that it looks up, at once.
PIECE_TOKENS, LOOK_UP_EVENTS = 1 << 19, 1 << 18
#: Added to each count of the base model and of P(w).
ADDED = 0.5
_START, _END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
_CODES = 256


# --- texts to events ------------------------------------------------------------------------------------------------


@dataclass
class Piece:
    """Words in a row, places of events in it, and of each event the row and a hash of its text."""

    stream: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    salt: np.ndarray


def events(texts: pa.Array) -> Iterator[Piece]:
    """The events of the texts of a batch.

    Two starts stand before the words of a text and one end after them; each word and the end is an event, the two
    before it its history. A text of any length is cut into pieces with their histories.
    """
    blocks, size = [], 0

    def pieces() -> Iterator[Piece]:
        hashes = np.concatenate([h for _, h, _ in blocks])
        lengths = np.concatenate([np.diff(first) for _, _, first in blocks])
        rows = np.concatenate([row + np.arange(len(first) - 1) for row, _, first in blocks])
        ends = np.cumsum(lengths + 3)
        stream = np.full(int(ends[-1]), _START, U64)
        place = np.arange(len(stream)) - np.repeat(ends - lengths - 3, lengths + 3)
        at = np.flatnonzero(place >= 2)
        stream[ends - 1] = _END
        inner = place >= 2
        inner[ends - 1] = False
        stream[inner] = hashes
        sums = np.append(U64(0), np.cumsum(hashes))
        salts = mix64(sums[(last := np.cumsum(lengths))] - sums[last - lengths])
        doc, salt = np.repeat(rows, lengths + 1), np.repeat(salts, lengths + 1)
        for k in range(0, len(at), PIECE_TOKENS):
            i = at[k : k + PIECE_TOKENS]
            yield Piece(stream[i[0] - 2 : i[-1] + 1], i - i[0] + 2, doc[k : k + PIECE_TOKENS], salt[k : k + PIECE_TOKENS])

    for row, hashes, first in word_hashes(texts):
        blocks.append((row, hashes, first))
        size += len(hashes) + len(first)
        if size >= PIECE_TOKENS:
            yield from pieces()
            blocks, size = [], 0
    if size:
        yield from pieces()


def _counts(texts: DataFrame, of: Callable[[Piece], np.ndarray]) -> DataFrame:
    """key and n of the 64-bit keys of all pieces of texts (text)."""

    def batch_of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for piece in events(batch.column(0)):
                parts.append(np.unique(of(piece), return_counts=True))
                size += len(parts[-1][0])
                if size >= 2 * PIECE_TOKENS:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size >= PIECE_TOKENS:
                        yield batch_of(*parts[0])
                        parts, size = [], 0
        if parts:
            yield batch_of(*merged(parts))
        release()

    return texts.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix64(v ^ mix64(u))


# --- messages to shards ---------------------------------------------------------------------------------------------


@dataclass
class Words:
    """What every task knows of the words: those of the head, most frequent first, and what is dealt by more than its word."""

    head: np.ndarray  # hashes
    counts: np.ndarray
    tokens: int
    types: int
    ends: int
    shards: int
    hot: np.ndarray  # hashes of words
    pairs: np.ndarray  # hashes of pairs, sorted
    parts: np.ndarray  # of each pair

    def __post_init__(self):
        self.order = np.argsort(self.head)
        self.sorted = self.head[self.order]
        self.total = self.tokens + ADDED * (self.types + 1)
        given = (self.counts + ADDED) / self.total
        # the last code of the head is the start, which is never scored
        self.chances = np.log10(np.append(given, 1.0))
        self.tail_chance = np.log10(max(1.0 - given.sum(), ADDED / self.total) / (self.types - len(self.counts) + 1))

    @property
    def starts(self) -> int:
        """The code of the start; codes above it are of words beyond the head."""
        return len(self.head)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the base model's probability of words with such counts."""
        return np.log10((counts + ADDED) / self.total)

    def chance(self, codes: np.ndarray) -> np.ndarray:
        """log10 P(w)."""
        return np.where(codes < self.starts, self.chances[np.minimum(codes, self.starts)], self.tail_chance)

    def codes(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of sorted different hashes, and the hashes beyond the head in the order of their codes."""
        at = np.minimum(np.searchsorted(self.sorted, words), max(len(self.head) - 1, 0))
        known = self.sorted[at] == words if len(self.head) else np.zeros(len(words), bool)
        start = words == _START
        tail = ~known & ~start
        codes = np.where(start, self.starts, self.order[at] if len(self.head) else 0)
        codes[tail] = self.starts + 1 + np.arange(tail.sum())
        return codes, words[tail]

    def home(self, piece: Piece, words: np.ndarray, back: np.ndarray) -> np.ndarray:
        """The shard of each event; words[back] is the piece's stream."""
        before = back[piece.at - 1]
        keys = mix64(words * U64(0x9E3779B97F4A7C15))[before]
        if len(self.hot) and len(split := np.flatnonzero(np.isin(words, self.hot)[before])):
            pair = _pair(piece.stream[piece.at[split] - 2], piece.stream[piece.at[split] - 1])
            if len(self.pairs):
                at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                pair = np.where(self.pairs[at] == pair, mix64(pair ^ mix64(piece.salt[split] % self.parts[at])), pair)
            keys[split] = pair
        return (keys % U64(self.shards)).astype(np.int64)

    def messages(self, piece: Piece, beside: np.ndarray) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
        """Codes of the words before the events, and (shard, packed trigrams with what stands beside each) for all events."""
        words, back = np.unique(piece.stream, return_inverse=True)
        codes, tail = self.codes(words)
        shard = self.home(piece, words, back)
        code = codes[back]
        u, v, w = code[piece.at - 2], code[piece.at - 1], code[piece.at]
        bits = int(code.max()).bit_length()
        order = np.argsort((v << 2 * bits) | (u << bits) | w) if 3 * bits <= 63 else np.lexsort((w, u, v))
        order = order[np.argsort(shard[order].astype(np.uint16 if self.shards <= 1 << 16 else np.int64), kind="stable")]
        grams, shard, beside = np.stack([u[order], v[order], w[order]]), shard[order], beside[order]
        cuts, out = np.flatnonzero(np.diff(shard, prepend=-1)), []
        for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
            part = grams[:, a:b]
            far = np.unique(part[part > self.starts])
            part = np.where(part > self.starts, self.starts + 1 + np.searchsorted(far, part), part)
            out.append((int(shard[a]), pack(part, beside[a:b], tail[far - self.starts - 1])))
        return v, out


def pack(grams: np.ndarray, beside: np.ndarray, tail: np.ndarray) -> bytes:
    """Trigrams (u, v, w) sorted by v and u, numbers below 2**32, and sorted 64-bit hashes; the numbers as differences, byte by byte, compressed."""
    u, v, w = grams.astype("<u4")
    dv = np.diff(v, prepend=v[:1] * 0)
    du = np.where(dv == 0, np.diff(u, prepend=u[:1] * 0), u)
    columns = np.stack([du, dv, w, beside.astype("<u4")]).view(np.uint8).reshape(4, len(u), 4).transpose(0, 2, 1)
    return np.array([len(u)], U64).tobytes() + elias_fano.encode(tail) + zstandard.ZstdCompressor(level=1).compress(columns.tobytes())


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams as rows u, v, w, what stands beside each, and the hashes."""
    n = int(np.frombuffer(data, U64, 1)[0])
    tail = elias_fano.Sequence(memoryview(data), 8)
    columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[tail.next :]), np.uint8).reshape(4, 4, n).transpose(0, 2, 1).copy().view("<u4")[:, :, 0]
    du, dv = columns[0].copy(), columns[1].copy()
    columns[1] = np.cumsum(dv, dtype=np.uint32)
    first = np.append(0, np.flatnonzero(dv[1:]) + 1) if n else np.zeros(0, int)
    sums = np.cumsum(du, dtype=np.uint32)
    columns[0] = sums - np.repeat(sums[first] - du[first], np.diff(np.append(first, n)))
    return columns[:3], columns[3], tail.get(np.arange(tail.n)) if tail.n else np.zeros(0, U64)


# --- the trie of a shard --------------------------------------------------------------------------------------------


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


def _chained(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lists of rising ids, each going on from the last value of the list before it."""
    last = np.append(starts[1:], len(ids)) - 1
    return ids + np.repeat(np.concatenate([[0], np.cumsum(ids[last])[:-1]]), np.diff(np.append(starts, len(ids)))) if len(ids) else ids


def _quantised(logs: np.ndarray) -> bytes:
    """A table of _CODES values and a code for each entry: bins of equally many entries, or the values where they are few."""
    values, back, n = np.unique(logs, return_inverse=True, return_counts=True)
    code = np.arange(len(values)) if len(values) <= _CODES else (np.cumsum(n) - n) * _CODES // len(logs)
    table = np.zeros(_CODES)
    np.divide(np.bincount(code, values * n, _CODES), weight := np.bincount(code, n, _CODES), out=table, where=weight > 0)
    codes = code[back].astype(np.uint8).tobytes()
    return table.tobytes() + codes.ljust(-(-len(codes) // 8) * 8, b"\0")


def build(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, chance: np.ndarray) -> bytes:
    """The trie of different trigrams, sorted by v, u and w, and their counts; words are numbers below len(chance), their P(w)."""
    pair = _runs(v, u)  # the histories u v, in the order of v
    root = _runs(v[pair])
    words_of = v[pair][root]
    tokens = np.add.reduceat(np.add.reduceat(n, pair), root)
    # successors of v, with the number of different words before them
    joint, k = np.unique(v << 32 | w, return_counts=True)
    follow = _runs(joint >> 32)
    sizes = np.diff(np.append(follow, len(joint)))
    after = np.add.reduceat(k, follow)
    d2, d3 = _discount(k), _discount(n)
    weight2 = d2 * sizes / after
    p2 = (k - d2) / np.repeat(after, sizes) + np.repeat(weight2, sizes) * chance[joint & 0xFFFFFFFF]
    types, total = np.diff(np.append(pair, len(n))), np.add.reduceat(n, pair)
    weight3 = d3 * types / total
    of = np.searchsorted(joint, v << 32 | w)
    p3 = (n - d3) / np.repeat(total, types) + np.repeat(weight3, types) * p2[of]
    place = of - np.repeat(np.repeat(follow, np.diff(np.append(root, len(pair)))), types)

    blob = [
        elias_fano.encode(words_of), elias_fano.encode(np.append(0, np.cumsum(tokens))),
        elias_fano.encode(np.append(follow, len(joint))), elias_fano.encode(np.append(root, len(pair))), elias_fano.encode(np.append(pair, len(n))),
        elias_fano.encode(_chained(joint & 0xFFFFFFFF, follow)), elias_fano.encode(_chained(u[pair], root)), elias_fano.encode(_chained(place, pair)),
        *(_quantised(np.log10(x)) for x in (weight2, p2, weight3, p3)),
    ]
    return b"".join(blob)


class Trie:
    """A shard's trie, read in place."""

    def __init__(self, blob: memoryview):
        at, levels = 0, []
        for _ in range(8):
            levels.append(elias_fano.Sequence(blob, at))
            at = levels[-1].next
        self.roots, self.tokens, self.follow, self.before, self.below, self.successors, self.predecessors, self.places = levels
        self.logs = []
        for n in (self.roots.n, self.successors.n, self.predecessors.n, self.places.n):
            self.logs.append((np.frombuffer(blob, np.float64, _CODES, at), np.frombuffer(blob, np.uint8, n, at + 8 * _CODES)))
            at += 8 * _CODES + -(-n // 8) * 8

    def _log(self, level: int, i: np.ndarray) -> np.ndarray:
        table, codes = self.logs[level]
        return table[codes[i]]

    @staticmethod
    def _child(pointers: elias_fano.Sequence, children: elias_fano.Sequence, node: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of a child among all children, -1 without one, and of its node's first child."""
        begin, end = pointers.get(node).astype(np.int64), pointers.get(node + 1).astype(np.int64)
        base = np.where(begin > 0, children.get(np.maximum(begin - 1, 0)), U64(0))
        return children.find(begin, end, base + id_.astype(U64)), begin

    def look_up(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(w | u v), given log10 P(w), and the tokens v that the trie has seen."""
        out, seen = chance.copy(), np.zeros(len(v), np.int64)
        whole = np.zeros(len(v), np.int64)
        root = self.roots.find(whole, whole + self.roots.n, v.astype(U64))
        some = np.flatnonzero(root >= 0)
        root = root[some]
        seen[some] = (self.tokens.get(root + 1) - self.tokens.get(root)).astype(np.int64)
        bigram, first = self._child(self.follow, self.successors, root, w[some])
        out[some] = np.where(bigram >= 0, self._log(1, np.maximum(bigram, 0)), self._log(0, root) + out[some])
        pair, _ = self._child(self.before, self.predecessors, root, u[some])
        known = np.flatnonzero(pair >= 0)
        some, pair, bigram, first = some[known], pair[known], bigram[known], first[known]
        trigram, _ = self._child(self.below, self.places, pair, np.maximum(bigram - first, 0))
        trigram[bigram < 0] = -1
        out[some] = np.where(trigram >= 0, self._log(3, np.maximum(trigram, 0)), self._log(2, pair) + out[some])
        return out, seen


# --- learn and score ------------------------------------------------------------------------------------------------


def learned_words(texts: DataFrame) -> Words:
    """The words of training texts (text).

    The driver gets the head, and the words and pairs that would fill a shard; their number is bounded by their share of
    the tokens. Pairs are counted only where there are such words.
    """
    counts = stored(_counts(texts, lambda p: p.stream[p.at]), "word-counts")
    end = int(_END.astype(np.int64))
    tokens, types, ends = (int(x) for x in counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("key") == end, F.col("n"))), F.lit(0))).first())
    shards = max(1, -(-tokens // SHARD_TOKENS))
    # at most max(HEAD_SHARE, shards) words have such a share of the tokens
    head = counts.where(F.col("n") * F.lit(max(HEAD_SHARE, shards)) >= tokens).orderBy(F.desc("n"), "key").toPandas()
    hashes, n = head["key"].to_numpy(np.int64).view(U64), head["n"].to_numpy(np.int64)
    hot, pairs, parts = hashes[n * shards > tokens], np.zeros(0, U64), np.zeros(0, U64)
    if len(hot):

        def of(piece: Piece) -> np.ndarray:
            u, v = piece.stream[piece.at - 2], piece.stream[piece.at - 1]
            mine = np.isin(v, hot)
            return _pair(u[mine], v[mine])

        # fewer than shards pairs
        found = _counts(texts, of).where(F.col("n") * F.lit(shards) > tokens).orderBy(F.col("key")).toPandas()
        keys, often = found["key"].to_numpy(np.int64).view(U64), found["n"].to_numpy(np.int64)
        order = np.argsort(keys)
        pairs, parts = keys[order], (-(-often[order] * shards // max(tokens, 1))).astype(U64)
    return Words(hashes, n, tokens, types, ends, shards, hot, pairs, parts)


_MESSAGE = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("batch", pa.int32()), ("message", pa.binary()), ("ids", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("base", pa.list_(pa.float64()))])
_PARTIAL = pa.schema([("part", pa.int32()), ("batch", pa.int32()), ("ids", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("rows", pa.list_(pa.int32())), ("score", pa.list_(pa.float64())), ("far", pa.list_(pa.int32())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {f'array<{kinds[f.type.value_type]}>' if pa.types.is_list(f.type) else kinds[f.type]}" for f in schema)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys, sorted, and the sums of values over each."""
    keys, at = np.unique(keys, return_inverse=True)
    return keys, *(np.bincount(at, v, len(keys)) for v in values)


def shard_scores(messages: list[bytes], batches: np.ndarray, words: Words) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Sums over a shard's events by batch << 32 | document: of log10 P; and of events whose word v is beyond the head, those
    that training has and the logarithms of the base model. The trie is built from what it may learn from."""
    parts = [unpack(m) for m in messages]
    tails = np.unique(np.concatenate([t for _, _, t in parts]))
    for grams, _, tail in parts:
        far = grams > words.starts
        grams[far] = words.starts + 1 + np.searchsorted(tails, tail)[grams[far] - words.starts - 1]
    batch = np.repeat(batches.astype(np.uint32), [len(b) for _, b, _ in parts])
    grams, beside = np.concatenate([g for g, _, _ in parts], 1), np.concatenate([b for _, b, _ in parts])
    del parts
    used = np.unique(grams)
    u, v, w = (np.searchsorted(used, g).astype(np.uint32) for g in grams)
    del grams
    order = np.lexsort((w, v.astype(np.int64) << 32 | u))
    keys, learns = batch[order].astype(np.int64) << 32 | beside[order] >> 1, beside[order] & 1
    u, v, w = u[order].astype(np.int64), v[order].astype(np.int64), w[order].astype(np.int64)
    del batch, beside, order
    new = _runs(v, u, w)
    times = np.diff(np.append(new, len(u)))
    u, v, w, n = u[new], v[new], w[new], np.add.reduceat(learns, new, dtype=np.int64)
    chance = words.chance(used)
    logs, seen = chance[w], np.zeros(len(w), np.int64)
    if (kept := n > 0).any():
        trie = Trie(memoryview(build(u[kept], v[kept], w[kept], n[kept], 10.0**chance)))
        for a in range(0, len(w), LOOK_UP_EVENTS):
            part = slice(a, a + LOOK_UP_EVENTS)
            logs[part], seen[part] = trie.look_up(u[part], v[part], w[part], logs[part])
    far = np.flatnonzero(np.repeat(used[v] > words.starts, times))
    logs, seen = np.repeat(logs, times), np.repeat(seen, times)[far]
    return _summed(keys, logs), _summed(keys[far], seen > 0, words.base(seen))


def score(docs: DataFrame, learns: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text), from its whole text.

    The model learns from the rows for which learns is true (null counts as false). Events travel to the shards of their
    histories as packed messages, one for each piece of a batch and shard; their sums travel back to the batch. A null or
    empty text is an end alone. A null doc_id is kept, repeated rows come back once for each, other columns are not read,
    an empty table gives an empty result; without rows to learn from every word is unknown. Rows must come in the same
    batches if a task is run again, as they do from a table.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    words = learned_words(texts.where("learns").select("text"))
    known = docs.sparkSession.sparkContext.broadcast(words)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        part = TaskContext.get().partitionId()
        near = words.base(words.counts)
        rows = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MESSAGE, strict=True)], schema=_MESSAGE)
        for number, batch in enumerate(batches):
            n = batch.num_rows
            learns = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens, base, seen = np.zeros(n, np.int64), np.full(n, words.base(words.ends)), np.full(n, int(words.ends > 0))
            for piece in events(batch.column(1)):
                v, sent = words.messages(piece, piece.doc << 1 | learns[piece.doc])
                tokens += np.bincount(piece.doc, minlength=n)
                # of each event the word before it, unless that is far; the end is there already
                own = np.flatnonzero(v < words.starts)
                base += np.bincount(piece.doc[own], near[v[own]], n)
                seen += np.bincount(piece.doc[own], minlength=n)
                none = [None] * len(sent)
                yield rows([s for s, _ in sent], [part] * len(sent), [number] * len(sent), [m for _, m in sent], none, none, none, none)
            yield rows([(part * 31 + number) % words.shards], [part], [number], [None], [batch.column(0).to_pylist()], [seen], [tokens], [base])
        release()

    def in_shards(table: pa.Table) -> pa.Table:
        own, sent = table.filter(table.column("message").is_null()), table.filter(table.column("message").is_valid())
        out = [pa.table({f.name: own.column(f.name) if f.name in own.column_names else pa.nulls(own.num_rows, f.type) for f in _PARTIAL})]
        if sent.num_rows:
            # batches by number, in the order of the group
            (parts, numbers), slot = np.unique(np.stack([sent.column(c).to_numpy() for c in ("part", "batch")]), axis=1, return_inverse=True)
            shard, messages = sent.column("shard").to_numpy(), [m for c in sent.column("message").chunks for m in c]
            near, far = [], []
            for k in np.unique(shard):
                mine = np.flatnonzero(shard == k)
                for found, into in zip(shard_scores([messages[i].as_buffer() for i in mine], slot.ravel()[mine], known.value), (near, far), strict=True):
                    into.append(found)
            columns = {"part": pa.array(parts), "batch": pa.array(numbers)}
            for names, found in ((("rows", "score"), near), (("far", "known", "base"), far)):
                keys, *sums = _summed(*map(np.concatenate, zip(*found, strict=True)))
                offsets = pa.array(np.searchsorted(keys >> 32, np.arange(len(parts) + 1)), pa.int32())
                columns |= {c: pa.ListArray.from_arrays(offsets, pa.array(v)) for c, v in zip(names, (keys & 0xFFFFFFFF, *sums), strict=True)}
            out.append(pa.table({f.name: columns[f.name].cast(f.type) if f.name in columns else pa.nulls(len(parts), f.type) for f in _PARTIAL}))
        release()
        return pa.concat_tables(out)

    def together(table: pa.Table) -> pa.Table:
        own, sent = table.filter(table.column("ids").is_valid()), table.filter(table.column("ids").is_null())
        flat = lambda rows, c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        n = len(ids := own.column("ids").combine_chunks().flatten())
        at, far = flat(sent, "rows"), flat(sent, "far")
        seen = flat(own, "known") + np.bincount(far, flat(sent, "known"), n).astype(np.int64)
        base = flat(own, "base") + np.bincount(far, flat(sent, "base"), n)
        columns = (ids, flat(own, "tokens"), seen, np.full(n, words.tokens), base, np.bincount(at, flat(sent, "score"), n))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORES, strict=True)], schema=_SCORES)

    messages = texts.mapInArrow(send, _ddl(_MESSAGE)).withColumn("shards", F.floor(F.col("shard") / TOGETHER))
    partials = messages.groupBy("shards").applyInArrow(in_shards, _ddl(_PARTIAL))
    return partials.groupBy("part", "batch").applyInArrow(together, _ddl(_SCORES))


def held_out(doc_id: Column) -> Column:
    """Documents that the model does not learn from: one in five. A null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))
