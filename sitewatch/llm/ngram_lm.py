"""Language-model scores from an Elias-Fano trigram trie that is built and asked by shards."""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Pseudo-counts of the shorter context's model in a context of one word and in one of two, and quantisation steps a decade.
PRIOR_2, PRIOR_3, STEPS = 1000.0, 30.0, 20
END, BEGIN = b"", b" "
#: Bytes of text, as expected, in which frequent first words are looked for, and the times that such a word must occur there.
SAMPLE, OFTEN = 8 << 20, 64
#: Bits of the hash by which pairs and triples know their words; unigrams have all 64. They only tell the words of one shard apart,
#: some 100,000 however large the corpus is: about one pair of words in each shard shares its pairs and triples.
WORD_BITS = 32
ODD = np.uint64(0x9E3779B97F4A7C15)
_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)


def _select(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Places of the ``i``-th ones (from 0) of a bit vector; ``before``: the ones before each of its 64-bit words."""
    at = np.searchsorted(before, i.astype(before.dtype), "right") - 1
    w, nth = words[at], (i - before[at]).astype(np.uint8)
    place = at * 64
    for half in (32, 16, 8):
        ones = np.bitwise_count(w & np.uint64((1 << half) - 1))
        beyond = nth >= ones
        nth -= ones * beyond
        w = w >> (beyond * np.uint64(half))
        place += beyond * half
    return place + _SELECT[w & np.uint64(255), nth]


class EliasFano:
    """A non-decreasing sequence: low parts as they are, high parts in unary as one bit vector, and the ones before each of its words.

    Elements are read and searched in this form; nothing is decoded beyond the elements that are asked for.
    """

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = len(values)
        bits = max(0, (int(values[-1]) // self.n).bit_length() - 1) if self.n else 0
        self.shift = np.uint64(bits)
        self.low = np.ascontiguousarray((values & np.uint64((1 << bits) - 1)).view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)])
        at = (values >> self.shift).astype(np.int64) + np.arange(self.n)
        ones = np.zeros((int(at[-1]) // 64 + 2) * 64 if self.n else 64, np.uint8)  # a zero stands behind the last one
        ones[at] = 1
        self.high = np.packbits(ones, bitorder="little").view("<u8")
        count = np.bitwise_count(self.high)
        self.ranks = np.cumsum(count, dtype=np.int64) - count

    def parts(self) -> list[str]:
        return ["low", "high", "ranks"]

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), 8), np.uint8)
        out[:, : self.low.shape[1]] = self.low[i]
        return out.view(np.uint64).ravel()

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at places ``i``: the place of the i-th one of the high bits, and the low part."""
        high = _select(self.high, self.ranks, i) - i
        return (high.astype(np.uint64) << self.shift) | self._low(i)

    def find(self, lo: np.ndarray, hi: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The place of each ``target`` within [lo, hi), -1 where it is not there: a successor search in that range alone.

        The zeros around the target's high part bound the elements that have it, the range bounds them further, and
        their low parts are halved.
        """
        zeros = np.arange(len(self.ranks)) * 64 - self.ranks
        out, parts = np.full(len(target), -1, np.int64), len(self.high) * 64 - self.n
        for a in range(0, len(target), 1 << 18):
            part = slice(a, a + (1 << 18))
            h = (target[part] >> self.shift).astype(np.int64)
            inside = np.flatnonzero((lo[part] < hi[part]) & (h < parts))  # beyond the last high part there is nothing
            h, low = h[inside], target[part][inside] & ((np.uint64(1) << self.shift) - np.uint64(1))
            first = np.zeros(len(h), np.int64)
            first[h > 0] = _select(~self.high, zeros, h[h > 0] - 1) + 1 - h[h > 0]
            first = np.maximum(first, lo[part][inside])
            end = np.minimum(_select(~self.high, zeros, h) - h, hi[part][inside])
            last, go = end.copy(), np.flatnonzero(first < end)
            while len(go):
                mid = (first[go] + last[go]) >> 1
                less = self._low(mid) < low[go]
                first[go[less]] = mid[less] + 1
                last[go[~less]] = mid[~less]
                go = go[first[go] < last[go]]
            there = np.flatnonzero(first < end)
            there = there[self._low(first[there]) == low[there]]
            out[a + inside[there]] = first[there]
        return out

    def decode(self) -> np.ndarray:
        return self.get(np.arange(self.n))

    def pack(self) -> bytes:
        """The sequence as bytes, to be sent."""
        return self.n.to_bytes(8, "little") + int(self.shift).to_bytes(8, "little") + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> EliasFano:
        e = cls.__new__(cls)
        e.n, bits = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
        e.shift, width = np.uint64(bits), -(-bits // 8)
        e.low = np.frombuffer(data, np.uint8, e.n * width, 16).reshape(e.n, width)
        e.high = np.frombuffer(data[16 + e.n * width :], "<u8")
        count = np.bitwise_count(e.high)
        e.ranks = np.cumsum(count, dtype=np.int64) - count
        return e


class TrigramTrie:
    """Three levels: roots by hash, their followers and the followers of these by rank in the shard's own dictionary.

    Each level has pointers to where the next one's ranges begin, its ranks as one monotone sequence (a
    range's ranks are raised by the number of its parent times the size of the dictionary), and quantised
    values: the smoothed probability of a follower in its context, and what a context leaves to the
    shorter one. Everything lies in one memory-mapped scratch file of the task.
    """

    def __init__(self, words: np.ndarray, roots: np.ndarray, c1: np.ndarray, pair_root: np.ndarray, pair_word: np.ndarray, c2: np.ndarray,
                 parent: np.ndarray, third: np.ndarray, c3: np.ndarray, priors: tuple[float, float] = (PRIOR_2, PRIOR_3)):
        """``words`` and ``roots``: sorted hashes; pairs sorted by (root, word), triples by (pair, word); all with counts above zero."""
        self.size = np.uint64(max(1, len(words)))
        self.words, self.roots = EliasFano(words), EliasFano(roots)
        self.first = EliasFano(np.searchsorted(pair_root, np.arange(len(roots) + 1)))
        self.second = EliasFano(np.searchsorted(parent, np.arange(len(c2) + 1)))
        self.pairs = EliasFano(pair_root.astype(np.uint64) * self.size + pair_word.astype(np.uint64))
        self.triples = EliasFano(parent.astype(np.uint64) * self.size + third.astype(np.uint64))
        self.back_1, self.back_2 = quantised(priors[0] / (c1 + priors[0])), quantised(priors[1] / (c2 + priors[1]))
        self.p_2, self.p_3 = quantised(c2 / (c1[pair_root] + priors[0])), quantised(c3 / (c2[parent] + priors[1]))
        self._map()

    def _map(self) -> None:
        holders = [(e, k) for e in (self.words, self.roots, self.first, self.second, self.pairs, self.triples) for k in e.parts()]
        holders += [(self, k) for k in ("back_1", "back_2", "p_2", "p_3")]
        self.file, places = tempfile.TemporaryFile(), []  # noqa: SIM115
        for e, k in holders:
            x = getattr(e, k)
            places.append(self.file.seek(-(-self.file.tell() // 8) * 8))
            self.file.write(x.tobytes())
        self.file.flush()
        for (e, k), at in zip(holders, places):
            x = getattr(e, k)
            setattr(e, k, np.memmap(self.file, x.dtype, "r", at, x.shape).view(np.ndarray) if x.size else x)

    def children(self, pointers: EliasFano, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ranges of the nodes begin and end on the next level; no range for a node of -1."""
        lo, hi = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        there = np.flatnonzero(node >= 0)
        lo[there], hi[there] = pointers.get(node[there]), pointers.get(node[there] + 1)
        return lo, hi

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of words in the dictionary, -1 of others."""
        return self.words.find(np.zeros(len(hashes), np.int64), np.full(len(hashes), self.words.n), hashes)

    def ask(self, roots: np.ndarray, root_of: np.ndarray, second: np.ndarray, pair_of: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes (what roots leave, probabilities of pairs, what pairs leave, probabilities of triples) of nodes, 0 where they are not in the trie.

        ``roots``: hashes; a pair is a place in them and a word's rank, a triple a place among the pairs and a word's rank.
        """
        node = self.roots.find(np.zeros(len(roots), np.int64), np.full(len(roots), self.roots.n), roots)

        def below(pointers: EliasFano, level: EliasFano, parent: np.ndarray, rank: np.ndarray) -> np.ndarray:
            lo, hi = self.children(pointers, np.where(rank < 0, -1, parent))
            return level.find(lo, hi, np.maximum(parent, 0).astype(np.uint64) * self.size + np.maximum(rank, 0).astype(np.uint64))

        pair = below(self.first, self.pairs, node[root_of], second)
        triple = below(self.second, self.triples, pair[pair_of], third)
        value = lambda codes, at: np.where(at >= 0, codes[np.maximum(at, 0)] if len(codes) else 0, 0).astype(np.uint8)
        return value(self.back_1, node), value(self.p_2, pair), value(self.back_2, pair), value(self.p_3, triple)


def quantised(share: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 of numbers up to 1 on a logarithmic scale."""
    return (1 + np.minimum(254, np.rint(-STEPS * np.log10(np.minimum(1.0, share))))).astype(np.uint8)


def value_of(codes: np.ndarray, missing: float) -> np.ndarray:
    table = np.append(missing, 10.0 ** (-np.arange(255) / STEPS))
    return table[codes]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, which one each is), in 32 bits."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], number


class Batch:
    """The distinct words, pairs and triples of some documents, as a trie whose roots are sorted by their shard.

    A root is a first word, and of a frequent one a share of its followers: so its nodes lie in several shards.
    """

    def __init__(self, texts: list[bytes], train: np.ndarray, shards: int, hot: dict[int, int]):
        """``texts`` is emptied."""
        index: defaultdict[bytes, int] = defaultdict(count().__next__)
        begin = index[BEGIN]
        ids = []
        texts.reverse()
        while texts:  # a text goes once its words are numbered
            words = texts.pop().lower().split()
            words.append(END)
            ids.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
        digest, size = xxhash.xxh64_intdigest, len(index)
        self.hash = np.array([digest(w) for w in index], np.uint64)
        order = np.argsort(self.hash)  # words are numbered by their hashes, so that a batch is the same each time, however its rows come
        number = np.empty(size, np.int64)
        number[order] = np.arange(size)
        self.hash, begin = self.hash[order], int(number[begin])
        self.lengths = np.array([len(r) for r in ids], np.int64)
        self.word = number[np.concatenate(ids)].astype(np.int32) if ids else np.zeros(0, np.int32)
        self.heads = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)[: len(self.lengths)]
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.heads] = begin
        learns = np.repeat(train, self.lengths)
        self.counts = np.bincount(self.word[learns], minlength=size)
        self.counts[begin] = train.sum()
        self.inside = np.ones(len(self.word), bool)  # a triple ends here
        self.inside[self.heads] = False

        salts = np.array([hot.get(h, 1) for h in self.hash.tolist()], np.int64)
        start = np.cumsum(salts) - salts
        self.root_word = np.repeat(np.arange(size), salts)
        self.salt = np.arange(len(self.root_word)) - start[self.root_word]
        self.root_hash = self.hash[self.root_word] ^ (self.salt.astype(np.uint64) * ODD)
        shard = (self.root_hash ^ (self.root_hash >> np.uint64(33))) * ODD >> np.uint64(20)
        shard = (shard % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((self.root_hash, shard))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.root_word, self.salt, self.root_hash, self.root_shard = self.root_word[order], self.salt[order], self.root_hash[order], shard[order]
        fork = (self.hash >> np.uint64(7)).astype(np.int64)
        root = rank[start[before] + fork[self.word] % salts[before]]
        pairs, self.pair = _numbered(root * size + self.word)
        self.pair_root, self.pair_word = pairs // size, pairs % size
        self.pair_counts = np.bincount(self.pair[learns], minlength=len(pairs))
        at = np.flatnonzero(self.inside)
        triples, self.triple = _numbered(self.pair[at - 1].astype(np.int64) * size + self.word[at])
        self.parent, self.third = triples // size, triples % size
        self.triple_counts = np.bincount(self.triple[learns[at]], minlength=len(triples))
        self.first_root = rank[start]
        self.begin = begin

    def slices(self) -> Iterator[tuple[int, slice, slice, slice]]:
        """(shard, its roots, its pairs, its triples), of the shards that occur."""
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(self.root_shard)) + 1, [len(self.root_shard)])) if len(self.root_shard) else np.zeros(1, np.int64)
        pair_cuts = np.searchsorted(self.pair_root, cuts)
        triple_cuts = np.searchsorted(self.parent, pair_cuts)
        for k in range(len(cuts) - 1):
            yield int(self.root_shard[cuts[k]]), slice(cuts[k], cuts[k + 1]), slice(pair_cuts[k], pair_cuts[k + 1]), slice(triple_cuts[k], triple_cuts[k + 1])

    def questions(self) -> Iterator[tuple]:
        """A row for each shard that occurs: its part of the trie with the counts of the training documents."""
        place = np.zeros(len(self.hash), np.int64)
        for shard, r, p, t in self.slices():
            used = np.unique(np.concatenate((self.pair_word[p], self.third[t])))
            place[used] = np.arange(len(used))
            kind = "<u2" if len(used) < 1 << 16 else "<u4"
            word = self.root_word[r]
            totals = (self.salt[r] == 0) & (word != self.begin)
            yield (
                shard, _planes(self.hash[word], 8), (self.salt[r] * 2 + totals).astype("<u4").tobytes(), *_narrow(self.counts[word]),
                EliasFano(self.hash[used] >> np.uint64(64 - WORD_BITS)).pack(),
                *_narrow(np.bincount(self.pair_root[p] - r.start, minlength=r.stop - r.start)), place[self.pair_word[p]].astype(kind).tobytes(), *_narrow(self.pair_counts[p]),
                *_narrow(np.bincount(self.parent[t] - p.start, minlength=p.stop - p.start)), place[self.third[t]].astype(kind).tobytes(), *_narrow(self.triple_counts[t]))


#: Columns of a question after its shard and batch, and of an answer.
ASKED = ["roots", "salts", "counts", "counts_big", "words", "pairs", "pairs_big", "pair_words", "pair_counts", "pair_counts_big", "triples", "triples_big", "triple_words", "triple_counts", "triple_counts_big"]
ANSWERED = ["counts", "counts_big", "back_1", "p_2", "back_2", "p_3"]


def _narrow(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts in one byte each, with those of 255 and more in full behind."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<u8").tobytes()


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of sorted numbers, their first bytes first: those hardly vary and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _wide(low: bytes, high: bytes) -> np.ndarray:
    out = np.frombuffer(low, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(high, "<u8").astype(np.int64)
    return out


def answers(rows: list[dict], priors: tuple[float, float]) -> Iterator[tuple]:
    """(batch, counts of the roots' words, codes of all nodes, training tokens and distinct ones of the shard) for each question to a shard.

    The questions' nodes are merged and counted, the trie is built from those with a training count,
    and every distinct node is looked up in it.
    """
    press = zstandard.ZstdCompressor(level=3).compress
    sizes = [(r["batch"], r["shard"], len(r["salts"]) // 4, len(r["pair_counts"]), len(r["triple_counts"])) for r in rows]
    wide = lambda k: np.concatenate([_wide(r.pop(k), r.pop(k + "_big")) for r in rows])
    salts = np.concatenate([np.frombuffer(r.pop("salts"), "<u4") for r in rows])
    roots, root_of = _numbered(np.concatenate([_from_planes(r.pop("roots"), 8) for r in rows]) ^ ((salts >> 1).astype(np.uint64) * ODD))
    dictionaries = [EliasFano.unpack(r.pop("words")).decode() for r in rows]
    words = np.unique(np.concatenate(dictionaries))
    places = [np.searchsorted(words, d).astype(np.int32) for d in dictionaries]
    rank = lambda k: np.concatenate([p[np.frombuffer(r.pop(k), "<u2" if len(p) < 1 << 16 else "<u4")] for r, p in zip(rows, places)])
    size = max(1, len(words))
    c1 = np.bincount(root_of, wide("counts"), minlength=len(roots))
    totals = np.zeros(len(roots), bool)
    totals[root_of[salts & 1 == 1]] = True
    tokens, types = int(c1[totals].sum()), int((c1[totals] > 0).sum())
    pairs, pair_of = _numbered(np.repeat(root_of, wide("pairs")).astype(np.int64) * size + rank("pair_words"))
    c2 = np.bincount(pair_of, wide("pair_counts"), minlength=len(pairs))
    triples, triple_of = _numbered(np.repeat(pair_of, wide("triples")).astype(np.int64) * size + rank("triple_words"))
    c3 = np.bincount(triple_of, wide("triple_counts"), minlength=len(triples))
    r, p, t = c1 > 0, c2 > 0, c3 > 0
    root_at, pair_at = np.cumsum(r) - 1, np.cumsum(p) - 1
    trie = TrigramTrie(words, roots[r], c1[r], root_at[pairs[p] // size], pairs[p] % size, c2[p], pair_at[triples[t] // size], triples[t] % size, c3[t], priors)
    codes = trie.ask(roots, pairs // size, pairs % size, triples // size, triples % size)
    a = b = c = 0
    for batch, shard, i, j, k in sizes:
        at = root_of[a : a + i], pair_of[b : b + j], triple_of[c : c + k]
        yield (batch, shard, *_narrow(c1[at[0]].astype(np.int64)), *(press(codes[n][at[m]].tobytes()) for n, m in enumerate((0, 1, 1, 2))), tokens, types)
        a, b, c = a + i, b + j, c + k


def log_probabilities(b: Batch, got: list[dict], n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(training counts, add-one log10 shares, the model's log10 probabilities) of a batch's tokens from its shards' answers."""
    counts, back_1 = np.zeros(len(b.root_word), np.int64), np.zeros(len(b.root_word), np.uint8)
    p_2, back_2 = np.zeros(len(b.pair_word), np.uint8), np.zeros(len(b.pair_word), np.uint8)
    p_3 = np.zeros(len(b.third), np.uint8)
    by_shard, open_ = {r["shard"]: r for r in got}, zstandard.ZstdDecompressor().decompress
    for shard, r, p, t in b.slices():
        a = by_shard[shard]
        counts[r] = _wide(a["counts"], a["counts_big"])
        for out, s, k in ((back_1, r, "back_1"), (p_2, p, "p_2"), (back_2, p, "back_2"), (p_3, t, "p_3")):
            out[s] = np.frombuffer(open_(a[k]), np.uint8)
    count_of = counts[b.first_root][b.word]
    unigram = (count_of + 1) / (n + v + 1)
    one = (value_of(p_2, 0.0)[b.pair]) + value_of(back_1, 1.0)[b.pair_root][b.pair] * unigram
    full = one.copy()
    at = np.flatnonzero(b.inside)
    full[at] = value_of(p_3, 0.0)[b.triple] + value_of(back_2, 1.0)[b.pair[at - 1]] * one[at]
    return count_of, np.log10(unigram), np.log10(full)


def hot_words(docs: DataFrame, total: int, shards: int) -> dict[int, int]:
    """Hashes of words that begin more pairs than a quarter of a shard holds, with the number of parts that they are cut into.

    Shares are estimated from about ``SAMPLE`` bytes of documents: they decide where nodes are counted, not what is counted.
    """
    every = max(1, total // SAMPLE)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [w for t in b.column(0).to_pylist() for w in (BEGIN, *t.lower().split())]
            found, n = np.unique(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["h", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    counts = some.mapInArrow(each, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    whole = counts.agg(F.sum("n")).first()[0] or 1
    rows = counts.where((F.col("n") >= OFTEN) & (F.col("n") * 4 * shards >= whole)).collect()
    return {r["h"] % (1 << 64): -(-4 * shards * r["n"] // whole) for r in rows}


def _pack(docs: DataFrame, batches_wanted: int) -> DataFrame:
    """(batch, blob): documents by a hash of their doc_id and text, some hundreds in a compressed blob."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=5)
        for b in batches:
            batch = b.column(3).to_numpy()
            order = np.argsort(batch, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(batch[order])) + 1) if len(order) else []
            blobs = []
            for p in parts:
                sink = pa.BufferOutputStream()
                some = pa.RecordBatch.from_arrays([b.column(i).take(pa.array(p)) for i in range(3)], ["doc_id", "text", "train"])
                with pa.ipc.new_stream(sink, some.schema) as w:
                    w.write_batch(some)
                blobs.append(press.compress(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([int(batch[p[0]]) for p in parts], pa.int32()), pa.array(blobs, pa.binary())], ["batch", "blob"])

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    rows = docs.select(
        "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.coalesce(~held, F.lit(True)).alias("train"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches_wanted)).cast("int").alias("batch"))
    return rows.mapInArrow(each, "batch int, blob binary")


def _unpack(group: pa.Table, shards: int, hot: dict[int, int]) -> tuple[pa.Table, Batch]:
    open_ = zstandard.ZstdDecompressor()
    rows = pa.concat_tables([pa.ipc.open_stream(open_.decompress(x)).read_all() for x in group.column("blob").to_pylist()])
    texts, rows = rows.column("text").to_pylist(), rows.select(["doc_id", "train"])
    pa.default_memory_pool().release_unused()
    return rows, Batch(texts, rows.column("train").to_numpy(zero_copy_only=False).astype(bool), shards, hot)


def language_model_scores(docs: DataFrame, batch_bytes: int = 16 << 20, priors: tuple[float, float] = (PRIOR_2, PRIOR_3)) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text; a null text is empty.

    A row for each row of ``docs``; repeated rows count as often as they come, and rows without a doc_id teach. Documents
    whose crc32(doc_id as text) mod 7 is 2 teach nothing. A batch of documents (dealt by a hash of
    doc_id and text) sends its distinct words, pairs and triples of words once, as a trie with the counts of its
    training documents, to the shards of the first words; a frequent first word's followers are dealt to
    several shards. A shard adds up what all batches send, builds its compact trie and answers every batch
    in the batch's own order. With that a batch scores its documents: a word's probability after two
    others is its smoothed share there plus what that context leaves to the model of one word less.

    Only shards that a batch has words for get a row from it, so rows grow with the text and not with
    batches times shards. Words are known by 64 bits of hash, within the pairs and triples of a shard by ``WORD_BITS``.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    wanted = shards = max(6, -(-total // batch_bytes))
    hot = hot_words(docs, total, shards)
    packed = _pack(docs, wanted)

    def ask(group: pa.Table) -> pa.Table:
        _, b = _unpack(group, shards, hot)
        number = group.column("batch")[0].as_py()
        press = zstandard.ZstdCompressor(level=1).compress
        rows = [(q[0], number, *map(press, q[1:])) for q in b.questions()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 2 + [pa.binary()] * len(ASKED))], names=["shard", "batch", *ASKED])

    def serve(group: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        rows = [{k: open_(x) if isinstance(x, bytes) else x for k, x in r.items()} for one in group.to_batches() for r in one.to_pylist()]
        rows.sort(key=lambda r: r["batch"])
        return pa.table([pa.array(c, t) for c, t in zip(zip(*answers(rows, priors)), [pa.int32()] * 2 + [pa.binary()] * len(ANSWERED) + [pa.int64()] * 2)], names=["batch", "shard", *ANSWERED, "tokens", "types"])

    asked = packed.groupBy("batch").applyInArrow(ask, ", ".join(["shard int", "batch int", *(f"{k} binary" for k in ASKED)]))
    answered = checkpointed(asked.groupBy("shard").applyInArrow(serve, ", ".join(["batch int", "shard int", *(f"{k} binary" for k in ANSWERED), "tokens bigint", "types bigint"])))
    sums = answered.groupBy("shard").agg(F.first("tokens").alias("n"), F.first("types").alias("v")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = int(sums[0]), int(sums[1])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(group: pa.Table, got: pa.Table) -> pa.Table:
        rows, b = _unpack(group, shards, hot)
        counts, unigram, full = log_probabilities(b, got.to_pylist(), n, v)
        sums = [np.add.reduceat(x, b.heads) for x in ((counts > 0).astype(np.int64), unigram, full)]
        held = ~rows.column("train").to_numpy(zero_copy_only=False).astype(bool)
        return pa.table([rows.column("doc_id"), pa.array(held), pa.array(b.lengths), pa.array(sums[0]), pa.array(np.full(len(held), n)), pa.array(sums[1]), pa.array(sums[2])],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return packed.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(score, schema)
