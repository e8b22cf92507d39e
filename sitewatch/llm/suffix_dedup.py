"""Repeated substrings by suffix arrays that are built by external induced sorting."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, numbered, pressed

GRAM = 32
#: Bytes that a bucket queue holds in memory before it writes runs to an unnamed scratch file; a full shard's queues hold several times that.
QUEUE_MEMORY = 1 << 20


class BucketQueue:
    """A monotone priority queue of suffix tuples by their first symbol; equal symbols leave in the order they came.

    A tuple is a suffix and its common prefix with the one that entered its bucket before. Beyond ``QUEUE_MEMORY`` the
    buffered runs go to one unnamed scratch file, which ends with the queue.
    """

    def __init__(self, symbols: int, kind: type = np.int64):
        self.kind = np.dtype([("at", kind), ("lcp", np.int16)])
        self.memory: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.disk: list[list[tuple[int, int]]] = [[] for _ in range(symbols)]
        self.held, self.file = 0, None

    def push(self, symbol: int, run: np.ndarray) -> None:
        self.memory[symbol].append(run)
        self.held += run.nbytes
        if self.held > QUEUE_MEMORY:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115
        for s, runs in enumerate(self.memory):
            for run in runs:
                self.disk[s].append((self.file.seek(0, 2), len(run)))
                self.file.write(run.tobytes())
            runs.clear()
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray:
        """All tuples of one symbol, oldest first; the first one has nothing before it."""
        runs = []
        for at, n in self.disk[symbol]:
            self.file.seek(at)
            runs.append(np.frombuffer(self.file.read(self.kind.itemsize * n), self.kind))
        runs += self.memory[symbol]
        self.held -= sum(r.nbytes for r in self.memory[symbol])
        self.disk[symbol], self.memory[symbol] = [], []
        out = np.concatenate(runs) if runs else np.zeros(0, self.kind)
        if len(out):
            out["lcp"][0] = 0
        return out


class Inducer:
    """Pushes what precedes the suffixes of one bucket, run after run in their order, with the common prefixes that follow from theirs.

    Two suffixes of one symbol share one symbol more than what comes after it, and that is the least of
    the common prefixes between the two in sorted order; it is 0 if they come from different buckets.
    """

    def __init__(self, t: np.ndarray, queue: BucketQueue, symbols: int, depth: int):
        self.t, self.queue, self.depth = t, queue, min(depth, 30_000)
        self.since = np.zeros(symbols, np.int16)  # least common prefix since a symbol's last push

    def begin(self) -> None:
        self.since[:] = 0

    def run(self, sources: np.ndarray, takes: np.ndarray, own: int) -> np.ndarray:
        """Push the predecessors of ``sources`` where ``takes`` says so; those of the bucket ``own`` itself come back as the next run."""
        lcp = sources["lcp"]
        at = np.flatnonzero(takes)
        symbol = self.t[sources["at"][at] - 1]
        order = np.argsort(symbol.astype(np.uint16), kind="stable")
        at, symbol = at[order], symbol[order]
        least = np.minimum.accumulate(lcp)
        new = np.ones(len(at), bool)
        new[1:] = symbol[1:] != symbol[:-1]
        shared = np.empty(len(at), np.int16)
        shared[new] = np.minimum(self.since[symbol[new]], least[at[new]])
        if not new.all():
            rest = np.flatnonzero(~new)
            shared[rest] = _range_minimum(lcp, at[rest - 1] + 1, at[rest])
        made = np.empty(len(at), self.queue.kind)
        made["at"], made["lcp"] = sources["at"][at] - 1, np.minimum(shared + 1, self.depth)
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int16(self.depth))
        np.minimum(self.since, least[-1], out=self.since)
        heads = np.flatnonzero(new)
        if len(at):
            self.since[symbol[heads]] = after[at[np.append(heads[1:] - 1, len(at) - 1)] + 1]
        here = np.zeros(0, self.queue.kind)
        for s, part in zip(symbol[heads].tolist(), np.split(made, heads[1:])):
            if s == own:
                here = part
            else:
                self.queue.push(s, part)
        return here


def _range_minimum(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least element of each x[lo..hi], both included, from minima of runs of 1, 2, 4, ... places."""
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out, runs = np.empty(len(lo), x.dtype), x
    for k in range(int(level.max()) + 1):
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(runs[lo[mine]], runs[hi[mine] - (1 << k) + 1])
        if len(runs) > 1 << k:
            runs = np.minimum(runs[: -(1 << k)], runs[1 << k :])
    return out


def _shared(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of suffixes ``a`` and ``b``, up to ``depth`` symbols."""
    out, go = np.zeros(len(a), np.int16), np.arange(len(a))
    for k in range(min(depth, 30_000)):
        go = go[t[a[go] + k] == t[b[go] + k]]
        if not len(go):
            break
        out[go] += 1
    return out


def _star_order(t: np.ndarray, stars: np.ndarray, depth: int) -> np.ndarray:
    """``stars`` (positions of the S* suffixes) in the order of their suffixes, up to ``depth`` symbols.

    The S* substrings are named by their symbols, six at a time. Where names repeat, the shorter
    string of names is the recursion; it is sorted by doubling the number of names compared.
    """
    ends = np.append(stars[1:] + 1, len(t))
    length = ends - stars
    name, k = np.zeros(len(stars), np.int64), 0
    while True:
        part = np.zeros(len(stars), np.int64)
        for j in range(6):  # a string that ends comes after those that go on: there they fall, here it rises
            part = (part << 10) | np.where(k + j < length, t[np.minimum(stars + k + j, len(t) - 1)], 1023)
        name = _ranks(name, part)
        k += 6
        if k >= length.max() or name.max() == len(stars) - 1:
            break
    step = 1
    while name.max() < len(stars) - 1 and step <= depth:
        after = np.zeros(len(stars), np.int64)
        after[: len(stars) - step] = name[step:] + 1
        name = _ranks(name, after)
        step *= 2
    return stars[np.argsort(name, kind="stable")]


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    out = np.empty(len(first), np.int64)
    out[order] = new
    return out


def induced_suffix_array(t: np.ndarray, depth: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix with the one before) of ``t`` (integers from 0 to 1022, the last one 0 and unique).

    Order holds for the first ``depth`` symbols at least, and common prefixes are exact up to ``depth`` (30,000 at most). The
    sorted S* suffixes induce the L suffixes from the smallest symbol up, and these the S suffixes from
    the largest down; between buckets, suffix tuples wait in a disk-backed queue. Common prefixes are induced
    with them; only those of neighbouring S* suffixes, and of the last L and first S one of a bucket, are compared.
    """
    n, symbols = len(t), int(t.max()) + 1
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int16)
    kind = np.int32 if n < 1 << 31 else np.int64  # of positions
    step = np.diff(t)
    follow = np.where(step != 0, np.arange(n - 1, dtype=kind), kind(n - 1))
    follow = np.minimum.accumulate(follow[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = step[np.minimum(follow, n - 2)] > 0
    del step, follow
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ordered = _star_order(t, stars, depth).astype(kind)
    shared = np.zeros(len(ordered), np.int16)
    shared[1:] = _shared(t, ordered[:-1], ordered[1:], depth)
    cuts = np.searchsorted(t[ordered], np.arange(symbols + 1))

    def tuples(at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.dtype([("at", kind), ("lcp", np.int16)]))
        out["at"], out["lcp"] = at, lcp
        return out

    def seam(upper: np.ndarray, lower: np.ndarray) -> int:
        """Common prefix of the last L and the first S suffix of a bucket: their runs of its symbol end at different ends."""
        return int(_shared(t, upper[:1], lower[:1], depth)[0])

    queue, large = BucketQueue(symbols, kind), []
    inducer = Inducer(t, queue, symbols, depth)

    def before(run: np.ndarray) -> np.ndarray:
        return t[np.maximum(run["at"] - 1, 0)]

    for c in range(symbols):
        got, wave = [], queue.pop(c)
        inducer.begin()
        while len(wave):
            got.append(wave)
            wave = inducer.run(wave, (wave["at"] > 0) & (before(wave) >= c), c)
        large.append(np.concatenate(got) if got else tuples(np.zeros(0, kind), np.zeros(0, np.int16)))
        seeds = tuples(ordered[cuts[c] : cuts[c + 1]], shared[cuts[c] : cuts[c + 1]])
        if len(seeds):
            seeds["lcp"][0] = seam(large[c]["at"][-1:], seeds["at"]) if len(large[c]) else 0
            inducer.run(seeds, seeds["at"] > 0, -1)

    queue, out = BucketQueue(symbols, kind), []
    inducer = Inducer(t, queue, symbols, depth)
    for c in range(symbols - 1, -1, -1):
        got, wave = [], queue.pop(c)
        inducer.begin()
        while len(wave):
            got.append(wave)
            wave = inducer.run(wave, (wave["at"] > 0) & (before(wave) <= c) & small[np.maximum(wave["at"] - 1, 0)], c)
        own = large[c][::-1].copy()
        if len(own):  # downwards, a suffix's common prefix is that of the one above it
            own["lcp"][1:] = large[c]["lcp"][:0:-1]
            own["lcp"][0] = seam(own["at"], got[-1]["at"][-1:]) if got else 0
            inducer.run(own, (own["at"] > 0) & (before(own) < c), -1)
        out += [*got, own]
        large[c] = None
    down = np.concatenate([*out, tuples(np.array([n - 1], kind), np.zeros(1, np.int16))])
    return down["at"][::-1], np.append(np.zeros(1, np.int16), down["lcp"][:0:-1])


def earlier_repeats(segments: list[bytes], doc: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Flags over the positions of all ``segments``, each followed by one more position: a ``width``-byte
    string begins there that also begins at a smaller (doc, start) in these segments."""
    text = np.frombuffer(b"\0".join(segments) + b"\0\0", np.uint8)
    lengths = np.array([len(s) for s in segments], np.int64)
    heads = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    t = text.astype(np.int16) + np.int16(2)
    t[heads + lengths] = 1  # ends of segments, whatever bytes they hold
    t[-1] = 0
    sa, lcp = induced_suffix_array(t, width)
    segment = np.repeat(np.arange(len(segments), dtype=np.int32), lengths + 1)
    valid = np.arange(len(t)) < len(segment)
    valid[: len(segment)] &= np.arange(len(segment)) + width <= (heads + lengths)[segment]
    kept = valid[sa]  # no string that a segment's end cuts lies between two equal ones
    string = np.cumsum(lcp < width)[kept]
    sa = sa[kept]
    flags = np.zeros(len(segment), bool)
    if len(sa) < 2:
        return flags
    same = string[1:] == string[:-1]
    if not same.any():
        return flags
    # a suffix's place in the corpus as one number: equal (doc, start) pairs are one place
    number = np.unique(doc, return_inverse=True)[1]
    base = number * (int((start + lengths).max()) + 1) + start - heads
    place = base[segment[sa]] + sa
    group = np.concatenate(([0], np.cumsum(~same)))
    first = np.minimum.reduceat(place, np.concatenate(([0], np.flatnonzero(~same) + 1)))
    flags[sa[place > first[group]]] = True
    return flags


def segment_bounds(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, lo, hi, own) of the segments of ``data``: runs of ``width``-byte strings with the same smallest hash of their 32-byte grams.

    Every ``width``-byte string lies in exactly one segment, and equal strings have equal keys.
    ``own``: the smallest hash comes twice, so a string may repeat within the segment. A longer run (of a text that
    repeats itself) is cut every ``4 * width`` strings: its pieces are then mostly equal, and equal segments are judged once.
    """
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    w = b[:-7].copy()
    for j in range(1, 8):
        w |= b[j : n - 7 + j] << np.uint64(8 * j)
    m = n - GRAM + 1
    h = w[:m] * np.uint64(0x9E3779B97F4A7C15)
    for j, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h ^= h >> np.uint64(29)
        h += w[j : m + j]
        h *= np.uint64(odd)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    span, reach = width - GRAM + 1, 1
    low = h
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    lo = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    hi = np.append(lo[1:], len(low)) + width - 1
    key, windows = low[lo], np.lib.stride_tricks.sliding_window_view(h, span)
    own, place = hi - lo - width + 1 > span, []
    for at in (lo, hi - width):  # both windows hold every gram of a segment of up to ``span`` strings
        is_low = windows[at] == key[:, None]
        own |= is_low.sum(1) > 1
        place.append(at + is_low.argmax(1))
    own |= place[0] != place[1]
    strings = hi - lo - width + 1
    if strings.max() <= 4 * width:
        return key, lo, hi, own
    pieces = -(-strings // (4 * width))
    at = np.repeat(np.arange(len(lo)), pieces)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = lo[at] + nth * 4 * width
    return key[at], start, np.minimum(start + 5 * width - 1, hi[at]), own[at]


#: A segment as it travels; it is known by 48 bits of its key and 64 of its content.
FIELDS = (("key_a", "<u4"), ("key_b", "<u2"), ("h", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("size", "<u4"), ("flags", "u1"))
#: Of a segment: equal to an earlier one of its task; may repeat within itself.
AGAIN, OWN = 1, 2


def _blob(columns: dict[str, np.ndarray], pick: np.ndarray | slice) -> bytes:
    return b"".join(np.ascontiguousarray(columns[k][pick], d).tobytes() for k, d in FIELDS)


def _unblob(blobs: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(d).itemsize for _, d in FIELDS)
    out: dict[str, list] = {k: [] for k, _ in FIELDS}
    for x in blobs:
        n, at = len(x) // width, 0
        for k, d in FIELDS:
            out[k].append(np.frombuffer(x, d, n, at))
            at += n * np.dtype(d).itemsize
    cols = {k: np.concatenate(v) for k, v in out.items()}
    cols["key"] = cols.pop("key_a").astype(np.uint64) | (cols.pop("key_b").astype(np.uint64) << np.uint64(32))
    cols["lo"] = cols["lo"].astype(np.int64)
    cols["hi"] = cols["lo"] + cols.pop("size")
    return cols


def _by_doc(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, ask: bool, key: np.ndarray | None = None) -> pa.Table:
    """Rows (doc_id, lo, hi, key, ask) with a document's spans in lists; spans that touch are one unless a key is kept."""
    order = np.lexsort((hi, lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if key is None and len(doc):
        lo, hi, doc = _merge(doc, lo, hi)
    cuts = np.flatnonzero(np.diff(doc)) + 1
    offsets = np.concatenate(([0], cuts, [len(doc)])).astype(np.int32) if len(doc) else np.zeros(1, np.int32)
    keys = (key[order].astype(np.int64) if key is not None else np.zeros(len(doc), np.int64))
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (lo, hi, keys)]
    heads = doc[offsets[:-1]]
    return pa.table([pa.array(heads, pa.int64()), *lists, pa.array(np.full(len(heads), ask))], names=["doc_id", "lo", "hi", "key", "ask"])


def _merge(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans of each document; the input is sorted by (doc, lo)."""
    big = int(hi.max()) + 2
    number = np.concatenate(([0], np.cumsum(np.diff(doc) != 0)))
    reach = np.maximum.accumulate(hi + number * big)
    new = np.concatenate(([True], lo[1:] + number[1:] * big > reach[:-1]))
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return lo[new], reach[ends] - number[ends] * big, doc[new]


#: Bytes of text that are looked through for frequent keys.
SAMPLE = 32 << 20


def hot_keys(docs: DataFrame, width: int, total: int, most: int) -> np.ndarray:
    """Sorted keys (48 bits) whose distinct segments take about ``most`` bytes or more, estimated from ``SAMPLE`` bytes of documents.

    What it names decides how strings are dealt to shards, not which repeat.
    """
    every = max(1, total // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) if every > 1 else docs

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key, lo, hi, _ = segment_bounds(data or b"", width)
                if len(key) and doc is not None:
                    h = np.array([xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(lo.tolist(), hi.tolist())], np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(16)).astype(np.int64)), pa.array(h.view(np.int64)), pa.array(hi - lo)], ["key", "h", "size"])

    # equal segments count once: they become one before they reach a shard
    sizes = some.select("doc_id", "data").mapInArrow(each, "key bigint, h bigint, size bigint").groupBy("key", "h").agg(F.max("size").alias("size"))
    sizes = sizes.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where((F.col("size") * every >= most) & (F.col("n") >= 8))
    return np.array(sorted(r["key"] for r in sizes.select("key").collect()), np.uint64)


def hashed(data: bytes, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray, hot: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(key, lo, hi, own, h): segments with the hash of their bytes; those of ``hot`` keys as their single ``width``-byte strings."""
    digest, is_hot = xxhash.xxh3_64_intdigest, np.isin(key, hot)
    cold = ~is_hot
    h = np.array([digest(data[i:j]) for i, j in zip(lo[cold].tolist(), hi[cold].tolist())], np.uint64)
    if cold.all():
        return key, lo, hi, own, h
    count = hi[is_hot] - lo[is_hot] - width + 1
    at = np.repeat(lo[is_hot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[i : i + width]) for i in at.tolist()), "<u8").reshape(-1, 2)
    return (np.concatenate((key[cold], both[:, 0] >> np.uint64(16))), np.concatenate((lo[cold], at)), np.concatenate((hi[cold], at + width)),
            np.concatenate((own[cold], np.zeros(len(at), bool))), np.concatenate((h, both[:, 1])))


SPANS = "doc_id bigint, lo array<bigint>, hi array<bigint>, key array<bigint>, ask boolean"


def repeated_spans(docs: DataFrame, width: int = 100, shard_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, lo, hi): lists of byte spans covered by ``width``-byte strings that begin earlier as well.

    ``docs``: doc_id bigint, data binary. Earlier is by (doc_id, start); rows that share a doc_id
    are at the same place and don't repeat each other.

    Texts are cut into segments that hold each ``width``-byte string once, keyed by the smallest hash
    of the string's grams; equal strings have equal keys, so a shard of keys can be judged alone. Keys
    with too many distinct segments for a shard (a frequent gram in ever other surroundings) are cut
    on: each of their strings is a segment of its own, keyed by its own hash. Of equal segments the first stands for all: they are dropped while still in their task, and again
    by shard. Where one key has different segments, or a segment may repeat itself, the bytes are fetched and a suffix array of the
    shard tells which strings repeat. A key's segments travel as packed columns, some rows a task.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    shards = max(12, -(-total // shard_bytes))
    hot = hot_keys(docs, width, int(total), shard_bytes // 4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, held, size = xxhash.xxh3_64_intdigest, [], 0

        def packed() -> pa.RecordBatch:
            cols = {k: np.concatenate([x[k] for x in held]) for k in ("key", "h", "doc", "lo", "hi", "flags")}
            order = np.lexsort((cols["lo"], cols["doc"], cols["h"], cols["key"]))
            key, h, doc, lo = (cols[k][order] for k in ("key", "h", "doc", "lo"))
            again = (np.diff(key) == 0) & (np.diff(h) == 0) & ((np.diff(doc) != 0) | (np.diff(lo) != 0))
            cols["flags"][order[1:][again]] |= AGAIN
            cols |= {"key_a": cols["key"] & np.uint64(0xFFFFFFFF), "key_b": cols["key"] >> np.uint64(32), "size": cols["hi"] - cols["lo"]}
            shard = ((cols["key"] >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)
            by = np.lexsort((cols["lo"], cols["doc"], shard))
            parts = np.split(by, np.flatnonzero(np.diff(shard[by])) + 1) if len(by) else []
            return pa.RecordBatch.from_arrays([pa.array([int(shard[p[0]]) for p in parts], pa.int32()), pa.array([_blob(cols, p) for p in parts], pa.binary())], ["shard", "blob"])

        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key, lo, hi, own = segment_bounds(data or b"", width)
                if len(key) and doc is not None:
                    key, lo, hi, own, h = hashed(data, key >> np.uint64(16), lo, hi, own, hot, width)
                    held.append({"key": key, "h": h, "doc": np.full(len(key), doc), "lo": lo, "hi": hi, "flags": np.where(own, OWN, 0).astype(np.uint8)})
                    size += max(len(data), 16 * len(key))
                    if size > 12 << 20:
                        yield packed()
                        held, size = [], 0
        if held:
            yield packed()

    def resolve(group: pa.Table) -> pa.Table:
        c = _unblob(group.column("blob").to_pylist())
        again = c["flags"] & AGAIN > 0
        # the first of each class of equal segments, then those that may share a string with another class or hold one twice
        order = np.lexsort((c["lo"], c["doc"], c["h"], c["key"]))
        order = order[~again[order]]
        key, h, doc, lo = (c[k][order] for k in ("key", "h", "doc", "lo"))
        same = (np.diff(key) == 0) & (np.diff(h) == 0)
        moved = np.concatenate(([False], same & ((np.diff(doc) != 0) | (np.diff(lo) != 0))))
        first = order[np.concatenate(([True], ~same))] if len(order) else order
        by = first[np.argsort(c["key"][first], kind="stable")]
        k = c["key"][by]
        twice = c["flags"][by] & OWN > 0
        twice[1:] |= k[1:] == k[:-1]
        twice[:-1] |= k[1:] == k[:-1]
        gone = np.concatenate((np.flatnonzero(again), order[moved]))
        asked = by[twice]
        return pa.concat_tables([
            _by_doc(c["doc"][gone], c["lo"][gone], c["hi"][gone], False),
            _by_doc(c["doc"][asked], c["lo"][asked], c["hi"][asked], True, c["key"][asked])])

    blobs = docs.select("doc_id", "data").mapInArrow(cut, "shard int, blob binary")
    spans = checkpointed(blobs.groupBy("shard").applyInArrow(resolve, SPANS))
    asked = spans.where("ask").groupBy("doc_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("lo", "hi", "key")])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows: list[tuple] = []
            for doc, pressed, lo, hi, key in zip(*(b.column(i).to_pylist() for i in range(5))):
                data = unpress(pressed)
                rows += [((k >> 8) % shards, k, doc, i, data[i:j]) for i, j, k in zip(lo, hi, key) if j <= len(data)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "key", "doc", "lo", "data"])

    def judge(group: pa.Table) -> pa.Table:
        doc, lo = (group.column(k).to_numpy() for k in ("doc", "lo"))
        segments = group.column("data").to_pylist()
        flags = earlier_repeats(segments, doc, lo, width)
        lengths = np.array([len(s) for s in segments])
        heads = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        at = np.flatnonzero(flags)
        segment = np.searchsorted(heads, at, "right") - 1
        start = lo[segment] + at - heads[segment]
        return _by_doc(doc[segment], start, start + width, False)

    found = pressed(docs, "data").join(asked, "doc_id").select("doc_id", "data", "lo", "hi", "key").mapInArrow(fetch, "shard int, key bigint, doc bigint, lo bigint, data binary")
    judged = found.groupBy("shard").applyInArrow(judge, SPANS)
    spans = spans.where("not ask").unionByName(judged)
    return spans.groupBy("doc_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("lo", "hi")])


def _with_spans(docs: DataFrame, width: int) -> DataFrame:
    """The rows of ``docs``, the text as compressed bytes, with ``_lo`` and ``_hi``: the spans of their repeated strings.

    A row gets the spans of its doc_id and text, so rows neither multiply nor go.
    """
    rows = numbered(docs)
    once = docs.select("doc_id", "text") if rows is None else rows.select("_n", "text").dropDuplicates(["_n"])
    spans = repeated_spans(once.toDF("doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data")), width)
    rows = docs.withColumn("_n", F.col("doc_id")) if rows is None else rows
    rows = rows.withColumn("text", F.coalesce(F.col("text").cast("binary"), F.lit(b""))).select(*docs.columns, "_n")
    at = docs.columns.index("text")

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([press(x) for x in cols[at].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    spans = spans.select(F.col("doc_id").alias("_d"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return rows.mapInArrow(press, rows.schema).join(spans, F.col("_n") == F.col("_d"), "left").select(*docs.columns, "_lo", "_hi")


def _removed(text: bytes, lo: list[int] | None, hi: list[int] | None) -> tuple[bytes, int]:
    """``text`` without the union of the spans, and how many separate ones that is."""
    if not lo:
        return text, 0
    lo, hi = np.array(lo), np.array(hi)
    order = np.argsort(lo, kind="stable")
    lo, hi, _ = _merge(np.zeros(len(lo), np.int64), lo[order], hi[order])
    return b"".join(text[i:j] for i, j in zip([0, *hi.tolist()], [*lo.tolist(), len(text)])), len(lo)


def without_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's bytes without the repeated ones; a null text is empty.

    A row for each row of ``docs``. Rows of the same doc_id and text are at the same place and don't repeat
    each other; other texts of that doc_id, and null doc_ids after all others, are places of their own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for pressed, lo, hi in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                text = unpress(pressed)
                kept, n = _removed(text, lo, hi)
                rows.append((len(text), len(text) - len(kept), n, kept))
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _with_spans(docs.select("doc_id", "text"), width).mapInArrow(remove, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def shortened(docs: DataFrame, width: int = 100) -> DataFrame:
    """``docs``, row by row, with their texts without repeated bytes; bytes that a cut leaves without their character go too.

    Rows of one doc_id and rows without one are taken as in ``without_repeats``.
    """
    names, at = docs.columns, docs.columns.index("text")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            cols = list(b.columns)
            texts = [_removed(unpress(x), lo, hi)[0].decode("utf-8", "ignore") for x, lo, hi in zip(*(c.to_pylist() for c in (cols[at], *cols[-2:])))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols[:-2], names)

    return _with_spans(docs, width).mapInArrow(remove, docs.schema)
