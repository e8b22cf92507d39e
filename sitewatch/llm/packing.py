"""Packing by the configuration linear program over the histogram of lengths."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, running_total
from .trie_bpe import WORDS, byte_letters, encoder, small_batches

_CODERS: dict[str, tiktoken.Encoding] = {}
#: Runs that are too long for the coder's backtracking.
LONG_RUN = re.compile(r"\s{50000}")


def coder(path: str) -> tiktoken.Encoding:
    """The vocabulary of a ``tokenizers`` byte-level BPE file, whose ids are the merge ranks."""
    if path not in _CODERS:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in s): i for s, i in data["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        _CODERS[path] = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
    return _CODERS[path]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and ``end_id``, cut if over ``capacity``.

    The first piece of a cut document takes the remainder, so all others are full. A null or empty
    text is ``end_id`` alone. Repeated rows, and rows of one doc_id, are documents of their own. Texts
    with a very long run of white space go through the trie encoder, which needs no backtracking.
    """
    def ids_of(text: str, code: tiktoken.Encoding) -> np.ndarray:
        if len(text) >= 50_000 and LONG_RUN.search(text):
            return np.frombuffer(encoder(path).encode_batch([text])[0], "<u4")
        return code.encode_to_numpy(text, allowed_special="all")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in small_batches(texts):
                rows: list[list[int]] = [[], [], [], [], []]
                for i in range(s.start, s.stop):
                    ids = np.append(ids_of(texts[i] or "", code), end_id).astype("<u4")
                    start = 0
                    for k in range(-(-len(ids) // capacity)):
                        end = start + (len(ids) % capacity or capacity) if not k else start + capacity
                        for col, x in zip(rows, (i, k, start, end - start, zlib.crc32(ids[start:end].tobytes()))):
                            col.append(x)
                        start = end
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(x, t) for x, t in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64())))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


#: Of a pattern that one knapsack gives, at most this many pieces count; what they leave free is filled by best fit.
MOST_PIECES = 32
#: Patterns that the rounding keeps; it bounds the plan.
MOST_PATTERNS = 40_000


def knapsack(worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best worth, piece to take) for every room from 0 to ``capacity``: unbounded knapsack by dynamic programming.

    worth[l]: of one piece of length l, 0 where there is none. The longest of equally good pieces is taken; 0: none fits.
    """
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(worth > 0)[::-1]
    value = worth[lengths]
    at = np.searchsorted(-lengths, -np.arange(capacity + 1))  # from where on the lengths fit
    for room in range(int(lengths[-1]) if len(lengths) else capacity + 1, capacity + 1):
        got = value[at[room] :] + best[room - lengths[at[room] :]]
        top = int(got.argmax())
        if got[top] > best[room - 1]:
            best[room], take[room] = got[top], lengths[at[room] + top]
        else:
            best[room], take[room] = best[room - 1], take[room - 1]
    return best, take


def _traced(take: np.ndarray, first: np.ndarray, capacity: int) -> np.ndarray:
    """A row per length of ``first``: it and the pieces of the best filling of the room that it leaves, zeros behind."""
    rows, room = [first], capacity - first
    while len(rows) < MOST_PIECES:
        piece = take[room]
        if not piece.any():
            break
        rows.append(piece)
        room = room - piece
    return np.stack(rows, 1)


def fractional_patterns(counts: dict[int, int], capacity: int, rounds: int = 240, pace: float = 0.005, sharpness: float = 60.0, near: float = 0.1) -> tuple[list[tuple[dict[int, int], float]], float]:
    """(patterns with fractional numbers of sequences, lower bound of the number of sequences) for the pieces ``counts``.

    Multiplicative weights for the covering program. A length's price is its size times a weight
    that falls exponentially as the length is covered. Each round one knapsack prices the best
    pattern around every length; those within ``near`` of the best grow together, each by so little that no length gains
    more than the share ``pace`` of its pieces. All prices over the worth of the best pattern are a
    solution of the dual, and so is their mean over the rounds; the better one bounds the optimum from
    below. The sum over the rounds, scaled to cover the pieces by volume, is near the optimum.
    """
    lengths = np.array(sorted(counts))
    need = np.array([counts[x] for x in lengths], float)
    place = np.full(capacity + 1, len(lengths))
    place[lengths] = np.arange(len(lengths))
    volume = lengths * need / (lengths @ need)
    covered, prices, bound = np.zeros(len(lengths)), np.zeros(len(lengths)), 0.0
    kept: list[np.ndarray] = []
    amounts: list[np.ndarray] = []
    for _ in range(rounds):
        price = lengths / capacity * np.exp(-sharpness * (covered - covered.min()))
        worth = np.zeros(capacity + 1)
        worth[lengths] = price
        best, take = knapsack(worth, capacity)
        price = price / best[capacity]
        prices += price
        bound = max(bound, float(price @ need))
        if covered @ volume >= 1:
            break
        around = worth[lengths] + best[capacity - lengths]
        rows = _traced(take, lengths[around >= (1 - near) * best[capacity]], capacity)
        of, anchor = place[rows], place[rows[:, 0]]
        load = np.bincount(of.ravel(), np.repeat(need[anchor], rows.shape[1]), minlength=len(lengths) + 1)
        load = np.append(load[:-1] / need, 0)
        step = pace * need[anchor] / load[of].max(1)
        covered += np.bincount(of.ravel(), np.repeat(step, rows.shape[1]), minlength=len(lengths) + 1)[:-1] / need
        kept.append(np.pad(rows, ((0, 0), (0, MOST_PIECES - rows.shape[1]))).astype(np.int16))
        amounts.append(step)
    best, _ = knapsack(np.bincount(lengths, prices, minlength=capacity + 1), capacity)
    bound = max(bound, float(prices @ need / best[capacity]))
    rows, amount = np.sort(np.concatenate(kept), 1)[:, ::-1], np.concatenate(amounts)
    # of near equal patterns some stand for all: a pattern's amount is rounded to units, in order, so that no part of the sum is lost
    order = np.lexsort(rows.T[::-1])
    rows, total = rows[order], np.cumsum(amount[order]) / max(1e-9, covered @ volume)
    unit = max(1.0, total[-1] / MOST_PATTERNS)
    times = np.diff(np.floor(total / unit + 0.5), prepend=0.0)
    some, sums = np.flatnonzero(times), Counter()
    for r, n in zip(rows[some].tolist(), times[some].tolist()):
        sums[tuple(r)] += unit * n
    return [(Counter(x for x in r if x), n) for r, n in sums.items()], bound


def packing_plan(counts: dict[int, int], capacity: int = 2048) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of sequences for patterns that hold exactly ``counts`` pieces of each length.

    The patterns are rounded one after the other, so that their sum stays within one of the
    fractional sum, as far as pieces last; what is left is filled best fit decreasing over the
    histogram, many equal sequences at a time, so the work depends on the number of distinct
    lengths and not on the number of pieces. If best fit alone needs no more sequences, its plan stands.
    """
    plain = _best_fit(Counter({x: n for x, n in counts.items() if n > 0}), capacity)
    left = Counter({x: n for x, n in counts.items() if 0 < x < capacity and n > 0})
    if not left:
        return plain
    full = counts.get(capacity, 0)
    plan = [({capacity: 1}, full)] if full else []
    due, given = 0.0, 0
    for pattern, x in sorted(fractional_patterns(dict(left), capacity)[0], key=lambda p: -sum(k * v for k, v in p[0].items())):
        due += x
        n = min([int(due) - given, *(left[length] // m for length, m in pattern.items())])
        given = int(due)
        if n > 0:
            plan.append((pattern, n))
            left.subtract({length: m * n for length, m in pattern.items()})
    plan += _best_fit(Counter({k: v for k, v in left.items() if v > 0}), capacity)
    return min(plan, plain, key=lambda p: sum(n for _, n in p))


def _best_fit(left: Counter, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences opened with the longest piece and closed with the piece, or two pieces, of what is left that fill them best."""
    plan, many = [], np.zeros(capacity + 1, np.int64)
    for x, n in left.items():
        many[x] = n
    tops = sorted(left)
    while tops:
        top = tops[-1]
        if not many[top]:
            tops.pop()
            continue
        pattern, room = Counter({top: 1}), capacity - top
        many[top] -= 1
        while room > 0:
            fits = np.flatnonzero(many[: room + 1])
            if not len(fits):
                break
            pick = int(fits[-1])
            if pick < room:  # an exact end with two pieces beats the longest one
                ends = fits[(many[room - fits] > 0) & ((2 * fits != room) | (many[fits] > 1))]
                pick = int(ends[-1]) if len(ends) else pick
            pattern[pick] += 1
            many[pick] -= 1
            room -= pick
        more = min(int(many[x]) // m for x, m in pattern.items())
        plan.append((dict(pattern), 1 + more))
        for x, m in pattern.items():
            many[x] -= m * more
    return plan


def packed(rows: DataFrame, capacity: int = 2048, rows_per_bucket: int = 2_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``rows`` (length 1 to capacity, further columns).

    Only the histogram of lengths, at most ``capacity`` rows, reaches the driver; its plan has a row
    for each pattern and length, at most ``MOST_PATTERNS`` patterns and those of best fit, and is joined
    with the pieces' ranks in their length. A length's rows are cut into buckets by a hash, so that a
    frequent length is ranked by many tasks. Repeated rows are pieces of their own, each with a place.
    """
    names = rows.columns
    rows = checkpointed(rows.withColumn("_tie", F.xxhash64(*names)))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = rows.sparkSession.createDataFrame([(x, -(-n // rows_per_bucket)) for x, n in counts.items()], "length bigint, _buckets bigint")
    table, sequence, at = [], 0, Counter()
    for pattern, n in packing_plan(counts, capacity):
        offset = 0
        for length, m in sorted(pattern.items(), reverse=True):
            table.append((length, at[length], at[length] + m * n, sequence, m, offset))
            at[length] += m * n
            offset += m * length
        sequence += n
    plan = rows.sparkSession.createDataFrame(table, "length bigint, low bigint, high bigint, base bigint, m bigint, place bigint")
    # pieces find their slot by length and the block of ranks that the slot lies in
    step = 4096
    plan = plan.withColumn("_block", F.explode(F.expr(f"sequence(low div {step}, (high - 1) div {step})"))) if table else plan.withColumn("_block", F.lit(0))
    rows = rows.join(F.broadcast(buckets), "length").withColumn("_bucket", F.pmod("_tie", F.col("_buckets"))).drop("_buckets")  # a row a length
    rows = running_total(rows, ["length"], "_bucket", ["_tie"], F.lit(1).cast("long"), "_rank")
    rows = rows.withColumn("_rank", F.col("_rank") - 1).withColumn("_block", F.expr(f"_rank div {step}"))
    rows = rows.join(plan, ["length", "_block"]).where("_rank >= low and _rank < high")
    nth = F.col("_rank") - F.col("low")
    return rows.select(
        *names,
        (F.col("base") + F.floor(nth / F.col("m"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(nth, F.col("m")) * F.col("length")).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """One row per piece of each document with its sequence and its place there.

    A null or empty text is one piece of one token. Which of equal pieces comes first is decided by their hash.
    """
    return packed(pieces(docs, path, capacity), capacity)
