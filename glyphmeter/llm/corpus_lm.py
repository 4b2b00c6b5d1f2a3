"""Language-model scoring: one interpolated trigram model of all training texts, dealt over Elias-Fano tries.

A shard has the trigrams (u, v, w) whose middle word v falls to it, so all counts that follow v are there. A word that would
fill two shards is dealt by (v, u), and its pairs that would fill one by (v, u, w). The counts after such words and pairs are
taken over all texts first, and each part gets those of its own followers with its events. The number of shards follows the
tokens of all texts; it decides where a probability is found, never what it is.

P(w | u v) = (c(uvw) - D3) / c(uv) + D3 t(uv) / c(uv) * P(w | v), with t the number of different successors;
P(w | v) = (k(vw) - D2) / k(v) + D2 t(v) / k(v) * P(w), with k(vw) the number of different u before v w (Kneser-Ney);
P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) for every word, with c(w) = 0 for an unknown one. Every task knows the counts of the head,
the words with at least one in HEAD_SHARE of the training tokens; a shard gets those of the rarer words that its events end with.
D2 and D3 are those of the middle word, (n1 + 6) / (n1 + 2 n2 + 8) of the counts after it: a word that was seen little has 3/4.

Probabilities and back-off weights are codes of two bytes, steps of 1/4096 of a decade below 1, the same in every trie. So
sums of codes are whole numbers, and a score is the same however its events were dealt.

Events, messages and the layout of the tries are those of ngram_lm. Words are compared as 64-bit hashes. Every count is over
all training texts; nothing is pruned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import elias_fano
from .common import U64, mix64, release, stored
from .ngram_lm import _END, _MESSAGE, _PARTIAL, _SCORES, _START, LOOK_UP_EVENTS, PIECE_TOKENS, TOGETHER, Piece, Trie, Words, _chained, _ddl, _pair, _runs, _summed, events, pack, unpack

#: Tokens of a shard, on average.
SHARD_TOKENS = 1 << 20
#: Words of the head have at least one in so many training tokens, so there are no more of them.
HEAD_SHARE = 1 << 20
#: Codes in a decade.
STEPS = 4096
#: Shards that a word would have to fill to be dealt over several.
FULL = 2
#: Bits of a number beside a trigram that hold its row and whether it learns; the 8 above them say how often it is repeated.
_ROW_BITS = 24


def _codes(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-STEPS * np.log10(p)), 0xFFFF).astype(np.int64)


def _discount(one, two):
    """D of the numbers of counts that are one and two."""
    return (one + 6) / (one + 2 * two + 8)


# --- what is known of the words before events travel ------------------------------------------------------------------


@dataclass
class Corpus:
    """What every task knows: the head, and what is dealt by more than its word, with its counts over all training texts."""

    words: Words
    shards: int
    hot: np.ndarray  # hashes of words, sorted
    parts: np.ndarray  # that each of them is dealt over
    seen: np.ndarray  # training tokens of each
    sums: np.ndarray  # of each, in rows: k(v), t(v), D2, D3
    pairs: np.ndarray  # hashes of pairs, sorted
    pair_sums: np.ndarray  # of each, in rows: c(uv), t(uv)

    def place(self, hot: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The shard of a part of a word of hot."""
        return (mix64(self.hot[hot] ^ mix64(part + U64(1))) % U64(self.shards)).astype(np.int64)

    def part(self, u: np.ndarray, hot: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The part of words of hot, given by place, that the trigrams of hashes u and w with them are dealt to."""
        pair = _pair(u, self.hot[hot])
        return np.where(_found(self.pairs, pair) >= 0, mix64(pair ^ mix64(w)), pair) % self.parts[hot]

    def home(self, piece: Piece, words: np.ndarray, back: np.ndarray) -> np.ndarray:
        """The shard of each event; words[back] is the piece's stream."""
        before = back[piece.at - 1]
        shard = (mix64(words * U64(0x9E3779B97F4A7C15)) % U64(self.shards)).astype(np.int64)[before]
        hot = _found(self.hot, words)
        if len(split := np.flatnonzero((hot >= 0)[before])):
            at, v = piece.at[split], hot[before[split]]
            shard[split] = self.place(v, self.part(piece.stream[at - 2], v, piece.stream[at]))
        return shard

    def messages(self, piece: Piece, beside: np.ndarray) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
        """Codes of the words before the events, and (shard, packed trigrams with what stands beside each) for all events."""
        words, back = np.unique(piece.stream, return_inverse=True)
        codes, tail = self.words.codes(words)
        shard, code, starts = self.home(piece, words, back), codes[back], self.words.starts
        u, v, w = code[piece.at - 2], code[piece.at - 1], code[piece.at]
        bits = int(code.max()).bit_length()
        order = np.argsort((v << 2 * bits) | (u << bits) | w) if 3 * bits <= 63 else np.lexsort((w, u, v))
        order = order[np.argsort(shard[order].astype(np.uint16 if self.shards <= 1 << 16 else np.int64), kind="stable")]
        grams, shard, beside = np.stack([u[order], v[order], w[order]]), shard[order], beside[order]
        # a trigram that a text repeats travels once for up to 256 times
        first = _runs(shard, *grams, beside)
        times = np.diff(np.append(first, len(shard)))
        if (times > 256).any():
            first = np.flatnonzero((np.arange(len(shard)) - np.repeat(first, times)) % 256 == 0)
            times = np.diff(np.append(first, len(shard)))
        grams, shard, beside = grams[:, first], shard[first], beside[first] | (times - 1) << _ROW_BITS
        cuts, out = np.flatnonzero(np.diff(shard, prepend=-1)), []
        for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
            part = grams[:, a:b]
            far = np.unique(part[part > starts])
            part = np.where(part > starts, starts + 1 + np.searchsorted(far, part), part)
            out.append((int(shard[a]), pack(part, beside[a:b], tail[far - starts - 1])))
        return v, out

    def code(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Codes of hashes where tails are the words beyond the head, -1 for others."""
        head, far, words = _found(self.words.sorted, hashes), _found(tails, hashes), self.words
        near = words.order[np.maximum(head, 0)] if len(words.head) else head
        return np.where(hashes == _START, words.starts, np.where(head >= 0, near, np.where(far >= 0, words.starts + 1 + far, -1)))

    def hashes(self, codes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Hashes of codes where tails are the words beyond the head."""
        return np.concatenate([self.words.head, [_START], tails]).astype(U64)[codes]


def _found(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x in sorted values, -1 where it is not there."""
    if not len(values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return np.where(values[at] == x, at, -1)


def _merged(batches: Iterator[pa.RecordBatch], of: Callable[[Piece, np.ndarray], tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """Of pieces of texts (text, learns): different hashes, their number in texts that are learned from and in all, and columns.

    of gives a hash of each event that it keeps, whether the event learns, and columns that the hash stands for.
    """

    def merged(parts: list) -> list[np.ndarray]:
        hashes, n, m, *columns = (np.concatenate(c) for c in zip(*parts, strict=True))
        hashes, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        return [hashes, *(np.bincount(at, x, len(hashes)).astype(np.int64) for x in (n, m)), *(c[first] for c in columns)]

    parts, size = [], 0
    for batch in batches:
        learns = batch.column(1).to_numpy(zero_copy_only=False)
        for piece in events(batch.column(0)):
            hashes, learned, *columns = of(piece, learns[piece.doc])
            parts.append(merged([(hashes, learned, np.ones(len(hashes), np.int64), *columns)]))
            size += len(parts[-1][0])
            if size >= 2 * PIECE_TOKENS:
                parts = [merged(parts)]
                size = len(parts[0][0])
                if size >= PIECE_TOKENS:
                    yield parts[0]
                    parts, size = [], 0
    if parts:
        yield merged(parts)


def _counts(texts: DataFrame, of: Callable[[Piece, np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """key, n and m of the hashes of all pieces of texts (text, learns): n from what is learned from, m from all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, m in _merged(batches, of):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys.view(np.int64), n, m)], ["key", "n", "m"])
        release()

    return texts.mapInArrow(run, "key bigint, n bigint, m bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _hot_events(piece: Piece, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Events of a piece that come after a word of hot, and which it is."""
    different, back = np.unique(piece.stream, return_inverse=True)
    place = _found(hot, different)[back[piece.at - 1]]
    mine = np.flatnonzero(place >= 0)
    return mine, place[mine]


def learned(texts: DataFrame) -> tuple[Corpus, DataFrame | None]:
    """What tasks know of texts (text, learns), and what shards are given: shard, v, ids and known, which are followers of their parts
    of very common words v, and without v the training counts of words beyond the head.

    The driver gets the head, and the words and pairs that would fill a shard; their number is bounded by their share of
    the tokens. Followers are counted only where there are such words, counts sent only where there are words beyond the head.
    """
    counts = stored(_counts(texts, lambda p, learns: (p.stream[p.at], learns)), "word-counts")
    end, none = int(_END.astype(np.int64)), F.lit(0)
    of_end = lambda c: F.coalesce(F.sum(F.when(F.col("key") == end, F.col(c))), none)
    row = counts.agg(F.coalesce(F.sum("n"), none), F.count_if(F.col("n") > 0), of_end("n"), F.coalesce(F.sum("m"), none), of_end("m")).first()
    tokens, types, ends, every, rows = (int(x) for x in row)
    shards = max(1, -(-every // SHARD_TOKENS))
    of_head = F.col("n") * F.lit(HEAD_SHARE) >= tokens
    head = counts.where((F.col("n") > 0) & of_head).orderBy(F.desc("n"), "key").toPandas()
    rare = counts.where((F.col("n") > 0) & ~of_head).select("key", "n") if types > len(head) else None
    empty = np.zeros(0, U64)
    words = Words(head["key"].to_numpy(np.int64).view(U64), head["n"].to_numpy(np.int64), tokens, types, ends, shards, empty, empty, empty)
    # fewer than shards words; the end has nothing after it, a start stands before each text
    often = counts.where((F.col("m") * F.lit(shards) > FULL * every) & (F.col("key") != end)).toPandas()
    hot, seen, m = (often[c].to_numpy(np.int64) for c in ("key", "n", "m"))
    hot = hot.view(U64)
    if rows * shards > FULL * every:
        hot, seen, m = np.append(hot, _START), np.append(seen, ends), np.append(m, rows)
    order = np.argsort(hot)
    hot, seen, parts = hot[order], seen[order], (-(-2 * m[order] * shards // max(every, 1))).astype(U64)
    corpus = Corpus(words, shards, hot, parts, seen, np.zeros((4, len(hot))), empty, np.zeros((2, 0)))
    given = lambda: None if rare is None else _rare_counts(texts, rare, corpus)
    if not len(hot):
        return corpus, given()

    def of(piece: Piece, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine, _ = _hot_events(piece, hot)
        return _pair(piece.stream[piece.at[mine] - 2], piece.stream[piece.at[mine] - 1]), learns[mine]

    # fewer than shards pairs
    pairs = _counts(texts, of).where(F.col("m") * F.lit(shards) > every).toPandas()
    keys = pairs["key"].to_numpy(np.int64).view(U64)
    order = np.argsort(keys)
    corpus.pairs, corpus.pair_sums = keys[order], np.stack([pairs["n"].to_numpy(np.float64)[order], np.zeros(len(keys))])
    found = stored(_followers(texts, corpus), "common-followers")
    sums = found.where("sums IS NOT NULL").select("v", "sums", "pairs", "types").toPandas()
    total = np.zeros((6, len(hot)))
    for v, s, at, t in sums.itertuples(index=False):
        total[:, v] += s
        corpus.pair_sums[1, at] += t
    k, t, one, two, one3, two3 = total
    corpus.sums = np.stack([k, t, _discount(one, two), _discount(one3, two3)])
    found, counted = found.where("sums IS NULL").select("shard", "v", "ids", "known"), given()
    return corpus, found if counted is None else found.unionByName(counted)


def _in_lists(lists: int, words: np.ndarray, beside: np.ndarray, asked: bool) -> pa.RecordBatch:
    """Hashes of words and a number beside each as messages to the lists that they fall to."""
    to = (mix64(words) % U64(lists)).astype(np.int64)
    order = np.argsort(to)
    to, words, beside = to[order], words[order], beside[order].astype(np.int64)
    cuts = _runs(to)
    messages = [words[a:b].tobytes() + beside[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(to[cuts], pa.int32()), pa.array([asked] * len(cuts)), pa.array(messages, pa.binary())], ["list", "asked", "message"])


def _rare_counts(texts: DataFrame, rare: DataFrame, corpus: Corpus) -> DataFrame:
    """Of each shard the training counts of the words of rare (key, n) that its events end with: shard, v (null), ids and known.

    A list has a share of the words by their hashes, with the shards that ask for each.
    """
    known = texts.sparkSession.sparkContext.broadcast(corpus)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = known.value

        def of(piece: Piece, learns: np.ndarray) -> tuple[np.ndarray, ...]:
            words, back = np.unique(piece.stream, return_inverse=True)
            codes, _ = corpus.words.codes(words)
            last = back[piece.at]
            mine = np.flatnonzero(codes[last] > corpus.words.starts)
            w, shard = words[last[mine]], corpus.home(piece, words, back)[mine]
            return mix64(w ^ mix64(shard.astype(U64) + U64(1))), learns[mine], w, shard

        for _, _, _, w, shard in _merged(batches, of):
            if len(w):
                yield _in_lists(corpus.shards, w, shard, True)
        release()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for batch in batches:
            part.append(batch)
            size += batch.num_rows
            if size >= PIECE_TOKENS:
                yield told(part)
                part, size = [], 0
        if size:
            yield told(part)
        release()

    def told(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, n = (np.concatenate([b.column(k).to_numpy() for b in part]) for k in (0, 1))
        return _in_lists(known.value.shards, keys.view(U64), n, False)

    def gather(table: pa.Table) -> pa.Table:
        def read(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            parts = [np.frombuffer(m.as_buffer(), U64).reshape(2, -1) for c in rows.column("message").chunks for m in c]
            words, beside = np.concatenate([np.zeros((2, 0), U64), *parts], 1)
            return words, beside.view(np.int64)

        asked = table.column("asked")
        (w, shard), (keys, n) = read(table.filter(asked)), read(table.filter(pc.invert(asked)))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        at = _found(keys, w)
        at, shard = at[at >= 0], shard[at >= 0]
        order = np.lexsort((at, shard))
        at, shard = at[order], shard[order]
        new = _runs(shard, at)
        at, shard = at[new], shard[new]
        cuts = _runs(shard)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(cuts, len(at)), pa.int32()), pa.array(x[at]))
        release()
        return pa.table([pa.array(shard[cuts], pa.int32()), pa.nulls(len(cuts), pa.int32()), lists(keys.view(np.int64)), lists(n)], ["shard", "v", "ids", "known"])

    schema = "list int, asked boolean, message binary"
    both = texts.mapInArrow(ask, schema).unionAll(rare.mapInArrow(tell, schema))
    return both.groupBy("list").applyInArrow(gather, "shard int, v int, ids array<bigint>, known array<bigint>")


_FOUND = "shard int, v int, ids array<bigint>, known array<bigint>, sums array<bigint>, pairs array<bigint>, types array<bigint>"


def _followers(texts: DataFrame, corpus: Corpus) -> DataFrame:
    """For each part of a very common word v its followers w and k(vw); and of v, in pieces that add up, sums (k(v), t(v), and how
    many k(vw) and c(uvw) are one and two) and of very common pairs (by number) t(uv)."""
    known = texts.sparkSession.sparkContext.broadcast(corpus)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = known.value
        starts = corpus.words.starts
        lists = -(-corpus.parts.astype(np.int64) // (2 * FULL))  # that the followers of each word are cut into
        first = np.cumsum(lists) - lists

        def of(piece: Piece, learns: np.ndarray) -> tuple[np.ndarray, ...]:
            mine, v = _hot_events(piece, corpus.hot)
            u, w = piece.stream[piece.at[mine] - 2], piece.stream[piece.at[mine]]
            return mix64(w ^ mix64(_pair(u, corpus.hot[v]))), learns[mine], v, u, w

        for _, n, _, v, u, w in _merged(batches, of):
            if not len(v):
                continue
            to, part = first[v] + (mix64(w) % lists[v].astype(U64)).astype(np.int64), corpus.part(u, v, w)
            hashes, back = np.unique(np.concatenate([u, w]), return_inverse=True)
            codes, tail = corpus.words.codes(hashes)
            u, w = codes[back[: len(v)]], codes[back[len(v) :]]
            order = np.lexsort((u, w, to))
            out, cuts = [], np.flatnonzero(np.diff(to[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                i = order[a:b]
                grams = np.stack([u[i], w[i]])
                far = np.unique(grams[grams > starts])
                grams = np.where(grams > starts, starts + 1 + np.searchsorted(far, grams), grams)
                out.append((int(to[i[0]]), int(v[i[0]]), pack(np.stack([*grams, part[i].astype(np.int64)]), n[i], tail[far - starts - 1])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["list", "v", "message"])
        release()

    def gather(table: pa.Table) -> pa.Table:
        corpus = known.value
        words, starts, v = corpus.words, corpus.words.starts, table.column("v")[0].as_py()
        read = [unpack(m.as_buffer()) for c in table.column("message").chunks for m in c]
        tails = np.unique(np.concatenate([t for _, _, t in read]))
        for grams, _, tail in read:
            far = grams[:2] > starts
            grams[:2][far] = starts + 1 + np.searchsorted(tails, tail)[grams[:2][far] - starts - 1]
        (u, w, part), n = np.concatenate([g for g, _, _ in read], 1).astype(np.int64), np.concatenate([b for _, b, _ in read]).astype(np.int64)
        del read
        order = np.argsort(w << 32 | u)
        u, w, part, n = u[order], w[order], part[order], n[order]
        new = _runs(w, u)
        u, w, part, n = u[new], w[new], part[new], np.add.reduceat(n, new)
        different = w[_runs(w)]
        of = np.searchsorted(different, w)
        k = np.bincount(of, n > 0, len(different)).astype(np.int64)
        times = [int((x == c).sum()) for x in (k, n) for c in (1, 2)]
        pair = _found(corpus.pairs, _pair(corpus.hashes(u, tails), np.full(len(u), corpus.hot[v])))
        pairs, types = np.unique(pair[(pair >= 0) & (n > 0)], return_counts=True)
        rows = [(None, v, None, None, [int(k.sum()), int((k > 0).sum()), *times], pairs.tolist(), types.tolist())]
        mine = np.unique(part << 32 | of)
        mine = mine[k[mine & 0xFFFFFFFF] > 0]
        cuts, hashes = _runs(mine >> 32), corpus.hashes(different, tails).view(np.int64)
        shard = corpus.place(np.full(len(cuts), v), (mine[cuts] >> 32).astype(U64)).tolist()
        for to, a, b in zip(shard, cuts, [*cuts[1:], len(mine)], strict=False):
            at = mine[a:b] & 0xFFFFFFFF
            rows.append((to, v, hashes[at], k[at], None, None, None))
        release()
        longs = pa.list_(pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[longs] * 5), strict=True)], ["shard", "v", "ids", "known", "sums", "pairs", "types"])

    return texts.mapInArrow(send, "list int, v int, message binary").groupBy("list").applyInArrow(gather, _FOUND)


# --- the trie of a shard ----------------------------------------------------------------------------------------------


@dataclass
class Given:
    """Counts over all training texts of what a shard has a part of; words are the shard's numbers."""

    v: np.ndarray  # sorted
    sums: np.ndarray  # k(v), t(v), D2, D3
    joint: np.ndarray  # v << 32 | w, sorted
    k: np.ndarray
    pairs: np.ndarray  # v << 32 | u, sorted
    pair_sums: np.ndarray  # c(uv), t(uv)


def build(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, chance: np.ndarray, given: Given) -> bytes:
    """The trie of different trigrams, sorted by v, u and w, and their counts; words are numbers below len(chance), their P(w)."""
    after = v << 32 | w
    joint, k = np.unique(after, return_counts=True)
    if len(given.v):
        own = _found(given.v, joint >> 32) < 0
        joint, k = np.concatenate([joint[own], given.joint]), np.concatenate([k[own], given.k])
        order = np.argsort(joint)
        joint, k = joint[order], k[order]
    before = v << 32 | u
    pairs = np.union1d(before[_runs(before)], given.pairs)
    roots = np.union1d(pairs[_runs(pairs >> 32)] >> 32, given.v)
    follow, above = (np.append(np.searchsorted(x, roots << 32), len(x)) for x in (joint, pairs))
    below = np.append(np.searchsorted(before, pairs), len(before))
    # the root of each successor and of each pair, the pair of each trigram
    of2, of3, of = np.repeat(np.arange(len(roots)), np.diff(follow)), np.repeat(np.arange(len(roots)), np.diff(above)), np.repeat(np.arange(len(pairs)), np.diff(below))
    top = of3[of]
    counted = lambda at, x, size: np.bincount(at, x, size)
    sums = np.stack([
        counted(of2, k, len(roots)), np.diff(follow), _discount(counted(of2, k == 1, len(roots)), counted(of2, k == 2, len(roots))),
        _discount(counted(top, n == 1, len(roots)), counted(top, n == 2, len(roots))),
    ])
    sums[:, np.searchsorted(roots, given.v)] = given.sums
    k_v, t_v, d2, d3 = sums
    pair_sums = np.stack([counted(of, n, len(pairs)), np.diff(below)])
    pair_sums[:, np.searchsorted(pairs, given.pairs)] = given.pair_sums
    c_uv, t_uv = pair_sums
    weight2, weight3 = d2 * t_v / k_v, d3[of3] * t_uv / c_uv
    p2 = (k - d2[of2]) / k_v[of2] + weight2[of2] * chance[joint & 0xFFFFFFFF]
    at = np.searchsorted(joint, after)
    p3 = (n - d3[top]) / c_uv[of] + weight3[of] * p2[at]
    lists = lambda ids, pointers: elias_fano.encode(_chained(ids, pointers[:-1][np.diff(pointers) > 0]))
    blob = [
        *(elias_fano.encode(x) for x in (roots, np.append(0, np.cumsum(counted(top, n, len(roots)))), follow, above, below)),
        lists(joint & 0xFFFFFFFF, follow), lists(pairs & 0xFFFFFFFF, above), lists(at - follow[top], below),
        *((b := _codes(x).astype("<u2").tobytes()).ljust(-(-len(b) // 8) * 8 or 8, b"\0") for x in (weight2, p2, weight3, p3)),
    ]
    return b"".join(blob)


class CorpusTrie(Trie):
    """A shard's trie with codes of two bytes, read in place; look_up takes and gives codes."""

    def __init__(self, blob: memoryview):
        at, levels = 0, []
        for _ in range(8):
            levels.append(elias_fano.Sequence(blob, at))
            at = levels[-1].next
        self.roots, self.tokens, self.follow, self.before, self.below, self.successors, self.predecessors, self.places = levels
        self.logs = []
        for n in (self.roots.n, self.successors.n, self.predecessors.n, self.places.n):
            self.logs.append(np.frombuffer(blob, "<u2", max(n, 1), at))
            at += -(-2 * n // 8) * 8 or 8

    def _log(self, level: int, i: np.ndarray) -> np.ndarray:
        return self.logs[level][i].astype(np.int64)

    @staticmethod
    def _child(pointers: elias_fano.Sequence, children: elias_fano.Sequence, node: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not children.n:
            return np.full(len(node), -1), np.zeros(len(node), np.int64)
        return Trie._child(pointers, children, node, id_)


# --- learn and score --------------------------------------------------------------------------------------------------


def shard_scores(messages: list[bytes], batches: np.ndarray, lists: list[tuple[int | None, np.ndarray, np.ndarray]], corpus: Corpus) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Sums over a shard's events by batch << 32 | document: of codes of P; and of events whose word v is beyond the head, those
    that training has and the logarithms of the base model. lists: (v, w, k) of the very common words that it has parts of, and
    (None, w, c) of words beyond the head."""
    words, starts = corpus.words, corpus.words.starts
    parts = [unpack(m) for m in messages]
    tails = np.unique(np.concatenate([t for _, _, t in parts]))
    for grams, _, tail in parts:
        far = grams > starts
        grams[far] = starts + 1 + np.searchsorted(tails, tail)[grams[far] - starts - 1]
    batch = np.repeat(batches.astype(np.uint32), [len(b) for _, b, _ in parts])
    grams, beside = np.concatenate([g for g, _, _ in parts], 1), np.concatenate([b for _, b, _ in parts])
    del parts
    there = np.zeros(starts + 1 + len(tails), bool)
    there[grams.ravel()] = True
    used, number = np.flatnonzero(there), np.cumsum(there, dtype=np.int32) - np.int32(1)
    number[~there] = -1
    bits = len(used).bit_length()
    u, v, w = (number[g] for g in grams)
    del grams
    if 3 * bits <= 63:
        order = v.astype(np.int64)
        for x in (u, w):
            order <<= bits
            order |= x
        order = np.argsort(order)
    else:
        order = np.lexsort((w, u, v))
    u, v, w = u[order], v[order], w[order]
    batch, beside = batch[order], beside[order]
    del order
    keys = batch.astype(np.int64) << 32
    del batch
    keys |= (beside & (1 << _ROW_BITS) - 1) >> 1
    times = (beside >> _ROW_BITS).astype(np.int16) + np.int16(1)
    new = _runs(v, u, w)
    runs = np.diff(np.append(new, len(u)))
    n = np.add.reduceat(np.where(beside & 1, times, np.int16(0)), new, dtype=np.int64)
    del beside
    u, v, w = (x[new].astype(np.int64) for x in (u, v, w))

    def numbers(hashes: np.ndarray) -> np.ndarray:
        code = corpus.code(hashes, tails)
        return np.where(code >= 0, number[code], -1).astype(np.int64)

    # of the very common words and pairs those that this shard has and training too
    hot = numbers(corpus.hot)
    mine = np.flatnonzero((hot >= 0) & (corpus.sums[1] > 0))
    mine = mine[np.argsort(hot[mine])]
    mine = mine[np.isin(hot[mine], v)]
    joint, k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, w_hashes, w_k in lists:
        if at in mine:
            found = numbers(w_hashes)
            joint.append(hot[at] << 32 | found[found >= 0])
            k.append(w_k[found >= 0])
    joint, first = np.unique(np.concatenate(joint), return_index=True)
    k = np.concatenate(k)[first]
    first = np.flatnonzero(np.isin(v, hot[mine]))
    first = first[_runs(v[first], u[first])]
    at = _found(corpus.pairs, _pair(corpus.hashes(used[u[first]], tails), corpus.hashes(used[v[first]], tails)))
    some = (at >= 0) & (corpus.pair_sums[1, at] > 0) if len(corpus.pairs) else at >= 0
    first, at = first[some], at[some]
    given = Given(hot[mine], corpus.sums[:, mine], joint, k, v[first] << 32 | u[first], corpus.pair_sums[:, at])

    logs, tail = words.chance(used), used > starts
    rare, times_rare = (np.concatenate([np.zeros(0, t), *(x[k] for x in lists if x[0] is None)]) for k, t in ((1, U64), (2, np.int64)))
    by_hash = np.argsort(rare)
    at = _found(rare[by_hash], tails[used[tail] - starts - 1])
    logs[tail] = words.base(np.where(at >= 0, times_rare[by_hash][at] if len(rare) else 0, 0))
    chance = 10.0**logs
    codes, seen = _codes(chance)[w], np.zeros(len(w), np.int64)
    if (kept := n > 0).any() or len(mine):
        trie = CorpusTrie(memoryview(build(u[kept], v[kept], w[kept], n[kept], chance, given)))
        for a in range(0, len(w), LOOK_UP_EVENTS):
            part = slice(a, a + LOOK_UP_EVENTS)
            codes[part], seen[part] = trie.look_up(u[part], v[part], w[part], codes[part])
    common = _found(np.sort(hot[hot >= 0]), v)
    if (split := common >= 0).any():
        seen[split] = corpus.seen[np.flatnonzero(hot >= 0)[np.argsort(hot[hot >= 0])]][common[split]]
    far = np.flatnonzero(np.repeat(used[v] > starts, runs))
    codes, seen = np.repeat(codes, runs), np.repeat(seen, runs)[far]
    return _summed(keys, codes * times), _summed(keys[far], (seen > 0) * times[far], words.base(seen) * times[far])


def score(docs: DataFrame, learns: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text), from its whole text.

    The model learns from the rows for which learns is true (null counts as false). Events travel to the shards of their
    histories as packed messages, one for each piece of a batch and shard; their sums travel back to the batch. A null or
    empty text is an end alone. A null doc_id is kept, repeated rows come back once for each, other columns are not read,
    an empty table gives an empty result; without rows to learn from every word is unknown. Rows must come in the same
    batches if a task is run again, as they do from a table.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    corpus, told = learned(texts.select("text", "learns"))
    known = spark.sparkContext.broadcast(corpus)
    shards, train_tokens = corpus.shards, corpus.words.tokens

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = known.value
        words = corpus.words
        part = TaskContext.get().partitionId()
        near = words.base(words.counts)
        rows = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MESSAGE, strict=True)], schema=_MESSAGE)
        for number, batch in enumerate(batches):
            n = batch.num_rows
            learns = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens, base, seen = np.zeros(n, np.int64), np.full(n, words.base(words.ends)), np.full(n, int(words.ends > 0))
            for piece in events(batch.column(1)):
                v, sent = corpus.messages(piece, piece.doc << 1 | learns[piece.doc])
                tokens += np.bincount(piece.doc, minlength=n)
                # of each event the word before it, unless that is far; the end is there already
                own = np.flatnonzero(v < words.starts)
                base += np.bincount(piece.doc[own], near[v[own]], n)
                seen += np.bincount(piece.doc[own], minlength=n)
                none = [None] * len(sent)
                yield rows([s for s, _ in sent], [part] * len(sent), [number] * len(sent), [m for _, m in sent], none, none, none, none)
            yield rows([(part * 31 + number) % shards], [part], [number], [None], [batch.column(0).to_pylist()], [seen], [tokens], [base])
        release()

    def in_shards(table: pa.Table) -> pa.Table:
        corpus = known.value
        # messages are read where they are; rows that have none are few
        of_batch, of_message = table.column("batch").is_valid(), table.column("message").is_valid()
        given, own = table.filter(pc.invert(of_batch)), table.filter(pc.and_not(of_batch, of_message))
        sent = table.select(["shard", "part", "batch"]).filter(of_message)
        out = [pa.table({f.name: own.column(f.name) if f.name in own.column_names else pa.nulls(own.num_rows, f.type) for f in _PARTIAL})]
        if sent.num_rows:
            # batches by number, in the order of the group
            (parts, numbers), slot = np.unique(np.stack([sent.column(c).to_numpy() for c in ("part", "batch")]), axis=1, return_inverse=True)
            shard, messages = sent.column("shard").to_numpy(), [m for c in table.column("message").chunks for m in c if m.is_valid]
            of_lists = given.column("shard").to_numpy()
            near, far = [], []
            for k in np.unique(shard):
                mine = np.flatnonzero(shard == k)
                lists = [(given.column("tokens")[i].values[0].as_py() if given.column("tokens")[i].is_valid else None, given.column("ids")[i].values.to_numpy().view(U64), given.column("known")[i].values.to_numpy()) for i in np.flatnonzero(of_lists == k).tolist()]
                for found, into in zip(shard_scores([messages[i].as_buffer() for i in mine], slot.ravel()[mine], lists, corpus), (near, far), strict=True):
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
        columns = (ids, flat(own, "tokens"), seen, np.full(n, train_tokens), base, 0.0 - np.bincount(at, flat(sent, "score"), n) / STEPS)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORES, strict=True)], schema=_SCORES)

    messages = texts.mapInArrow(send, _ddl(_MESSAGE))
    if told is not None:
        lists = told.select("shard", "ids", "known", F.when(F.col("v").isNotNull(), F.array(F.col("v").cast("bigint"))).alias("tokens"))
        messages = messages.unionByName(lists, allowMissingColumns=True)
    partials = messages.withColumn("shards", F.floor(F.col("shard") / TOGETHER)).groupBy("shards").applyInArrow(in_shards, _ddl(_PARTIAL))
    return partials.groupBy("part", "batch").applyInArrow(together, _ddl(_SCORES))
