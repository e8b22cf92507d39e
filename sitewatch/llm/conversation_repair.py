"""Repair of conversation structure by signatures: equal sequences of roles and faults are solved once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The white space of the contract; a text of nothing else is blank.
BLANK = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: States of ``(s?(ua)+)?``: 0 nothing yet, 1 after s, 2 after u, 3 after a; what each initial leads to.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one role that may be written in a state by Rerole or Insert.
WRITES = ("user", "user", "assistant", "user")
ENDS = ("", "II", "I", "")
#: Ascending, so nulls come first.
ORDER = ("conv_id", "turn", "role", "digest")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
Table = tuple[tuple[tuple[int, str] | None, ...], ...]


def _least(a: tuple[int, str] | None, b: tuple[int, str] | None) -> tuple[int, str] | None:
    return b if a is None else a if b is None else min(a, b)


def _leaf(code: str) -> Table:
    """Of one row: the cheapest edits, least in ASCII, from each state to each; inserts stand before the row they precede."""
    rows = []
    for start in range(4):
        best: list[tuple[int, str] | None] = [None] * 4
        state, cost = start, 0
        for inserts in range(3):  # a third insert only repeats a state
            written = "I" * inserts
            best[state] = _least(best[state], (cost + DELETE, written + "D"))
            if code != "d":
                cut = CUT if code.isupper() else 0
                kept, rewritten = STEPS[state].get(code.lower()), STEPS[state][WRITES[state][0]]
                if kept is not None:
                    best[kept] = _least(best[kept], (cost + cut, written + "K"))
                best[rewritten] = _least(best[rewritten], (cost + cut + REROLE, written + "R"))
            state, cost = STEPS[state][WRITES[state][0]], cost + INSERT
        rows.append(tuple(best))
    return tuple(rows)


def _joined(a: Table, b: Table) -> Table:
    """Edits of one stretch followed by those of the next. No edits of a stretch begin others of it, so least parts make least wholes."""
    rows = []
    for left in a:
        best: list[tuple[int, str] | None] = [None] * 4
        for x, right in zip(left, b):
            if x:
                for end, y in enumerate(right):
                    if y:
                        best[end] = _least(best[end], (x[0] + y[0], x[1] + y[1]))
        rows.append(tuple(best))
    return tuple(rows)


@lru_cache(maxsize=1 << 14)
def _short(signature: str) -> Table:
    return _table(signature)


def _table(signature: str) -> Table:
    """By halves whose first is the largest power of two, so that signatures share stretches; short ones are remembered."""
    if len(signature) == 1:
        return _leaf(signature)
    k = 1 << (len(signature) - 1).bit_length() - 1
    parts = (_short(x) if len(x) <= 64 else _table(x) for x in (signature[:k], signature[k:]))
    return _joined(*parts)


def cheapest(signature: str) -> tuple[int, str]:
    """Cost and audit of a signature: its cheapest edits' initials that give ``(s?(ua)+)?``, of equal ones the ASCII-least.

    A row is ``s u a x`` by its role's initial (x: another), in capitals if truncated, ``d`` if it must go.
    """
    if not signature:
        return 0, ""
    return min((x[0] + INSERT * len(end), x[1] + end) for x, end in zip(_table(signature)[0], ENDS) if x)


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with ``digest``, the text's MD5, which breaks ties of turn and role."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"), F.col("copies").cast("long").alias("copies"))


def _faults(rows: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, digest) with their copies, ``bare`` texts marked, and whether the row is ``first`` of its role and text.

    Equal rows become one with their number before they are shuffled; the first turn of each text comes by a join, which Spark can split.
    """
    ending = F.rtrim("text", F.lit(BLANK))
    kind = F.when(ending == "", "blank").when(F.right(ending, F.lit(1)).isin(".", "!", "?"), "whole").otherwise("cut")
    light = _marked(rows).withColumn("kind", kind).groupBy("conv_id", "turn", "role", "digest", "kind").agg(F.sum("copies").alias("copies"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    first = light.where("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("g")).agg(F.min(at).alias("least"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("g"))
    known = light.join(first, same, "left").withColumn("first", F.col("turn").eqNullSafe(F.col("least.at")))
    return known.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "role", "digest", "kind", "first", "copies")


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of each conversation.

    Rows are sorted by Spark and read as they come, so that a task holds one signature, a byte a row, and no texts.
    """
    rows = _faults(rows).repartition("conv_id").sortWithinPartitions(*ORDER)
    rows = rows.select("conv_id", "turn", "initial", "kind", "first", "copies")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, conv, began = None, [], None, False
        codes: list[str] = []
        n: dict[str, int] = {}
        turns: tuple[int, int, int] | None = None  # least, most, distinct
        last = ""

        def close() -> None:
            n["gaps"] = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            out.append([conv, "".join(codes), *(n[x] for x in COUNTS)])

        def batch() -> pa.RecordBatch:
            names = ["conv_id", "signature", *COUNTS]
            types = [schema.field(0).type, pa.string(), *[pa.int64()] * len(COUNTS)]
            columns = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for b in batches:
            schema = b.schema
            for c, turn, initial, what, first, copies in zip(*(x.to_pylist() for x in b.columns)):
                if not began or c != conv:
                    if began:
                        close()
                    conv, began, codes, turns, last, n = c, True, [], None, "", dict.fromkeys(COUNTS, 0)
                if not copies:
                    continue
                initial = initial if initial and initial in "sua" else "x"
                n["illegal"] += (last != "" and last + initial not in ("su", "ua", "au")) + copies - 1
                last = initial
                if turn is not None:
                    turns = (turns[0], turn, turns[2] + (turn != turns[1])) if turns else (turn, turn, 1)
                if what == "blank":
                    n["blank"] += copies
                    codes.append("d" * copies)
                else:
                    n["duplicate"] += copies - first
                    n["truncated"] += first and what == "cut"
                    codes.append((initial.upper() if what == "cut" else initial) * first + "d" * (copies - first))
            if len(out) > 1000:
                yield batch()
                out.clear()
        if began:
            close()
            yield batch()

    return rows.mapInArrow(each, f"conv_id {kind}, signature string, {', '.join(f'{x} long' for x in COUNTS)}")


def audits(rows: DataFrame) -> DataFrame:
    """Signatures of all conversations with ``cost`` and ``audit``; each distinct signature is solved once and joined back."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [cheapest(s) for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])

    known = signatures(rows)
    solved = known.select("signature").distinct().mapInArrow(each, "signature string, cost long, audit string")
    return known.join(solved, "signature").select("conv_id", "signature", *COUNTS, "cost", "audit")


def _scripts(rows: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one task and one after the other."""
    said = audits(rows).select("conv_id", F.lit(0).alias("part"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.unhex(F.lit("")).alias("digest"), F.lit(0).cast("long").alias("copies"), *COUNTS, "cost", "audit")
    texts = _marked(rows).where("copies > 0").withColumn("part", F.lit(1))
    both = said.unionByName(texts, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions(ORDER[0], "part", *ORDER[1:])
    return both.select("conv_id", "part", "turn", "role", "text", "copies", *COUNTS, "cost", "audit")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """What the audits say, edit by edit: (header, None) opens a conversation, (None, (edit, turn, role, text)) is a row of it, deleted ones too."""
    audit, at, state, waiting = "", 0, 0, False

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = WRITES[state]
            at, state = at + 1, STEPS[state][role[0]]
            yield None, ("I", None, role, "")

    for b in batches:
        for conv, part, turn, role, text, copies, *rest in zip(*(x.to_pylist() for x in b.columns)):
            if not part:
                if waiting:
                    yield from inserted()
                audit, at, state, waiting = rest[-1], 0, 0, True
                yield (conv, *rest), None
                continue
            for _ in range(copies):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "D":
                    yield None, ("D", turn, role, text)
                    continue
                as_role = role if edit == "K" else WRITES[state]
                state = STEPS[state][as_role[0]]
                yield None, (edit, turn, as_role, text)
    if waiting:
        yield from inserted()


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, turn, role, text), ``place`` from 0; inserted rows have no turn."""
    scripts = _scripts(rows)
    kinds = {x: scripts.schema[x].dataType.simpleString() for x in ("conv_id", "turn")}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                types[:] = [b.schema.field("conv_id").type, b.schema.field("turn").type]
                yield b

        def batch(out: list[list]) -> pa.RecordBatch:
            kind = [types[0], pa.int64(), pa.string(), types[1], pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kind)], ["conv_id", "place", "edit", "turn", "role", "text"])

        out, conv, place = [], None, 0
        for header, row in _replayed(seen()):
            if header:
                conv, place = header[0], 0
            elif row[0] != "D":
                out.append([conv, place, row[0], *row[1:]])
                place += 1
                if len(out) == 1000:
                    yield batch(out)
                    out.clear()
        if out:
            yield batch(out)

    return scripts.mapInArrow(each, f"conv_id {kinds['conv_id']}, place long, edit string, turn {kinds['turn']}, role string, text string")


def repairs(rows: DataFrame) -> DataFrame:
    """Each conversation's faults, the cheapest edits that mend it, and the SHA-256 of the repaired ``role:text`` lines.

    ``rows`` has conv_id, turn, role, text and ``copies``: how often the row stands there (0: it is gone, but its conversation is
    reported). Rows stand by turn, nulls first; of one turn by role, then by the text's MD5. A null role or text is one space, so a null
    text is blank; null conv_ids are one conversation; repeated rows are further copies, thus duplicates; an empty text is blank, a very
    long one is hashed as it is read. Other columns are not read, and an empty table gives none. A conversation is read by one task, as
    its hash needs its rows in order, but row by row: a task holds one conversation's audit, a byte a row.
    """
    scripts = _scripts(rows)
    kind = scripts.schema["conv_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                types[:] = [b.schema.field("conv_id").type, *[pa.int64()] * (len(COUNTS) + 1), pa.string(), pa.string()]
                yield b

        def batch(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"])

        out: list[list] = []
        header = digest = None
        written = False
        for opens, row in _replayed(seen()):
            if opens:
                if header:
                    out.append([*header, digest.hexdigest()])
                    if len(out) == 1000:
                        yield batch(out)
                        out.clear()
                header, digest, written = opens, hashlib.sha256(), False
            elif row[0] != "D":
                digest.update((("\n" if written else "") + f"{row[2]}:{row[3]}").encode())
                written = True
        if header:
            out.append([*header, digest.hexdigest()])
        if out:
            yield batch(out)

    return scripts.mapInArrow(each, f"conv_id {kind}, {', '.join(f'{x} long' for x in COUNTS)}, cost long, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage by the CRC-32 of ``conv_id:turn`` (a null is one space): gone, emptied, without sentence ends, twice, or from the user."""
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    pick = F.crc32(F.concat_ws(":", *spelled).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(pick <= 1, "").when(pick == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    gone = pick == 0
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").when(pick == 4, "user").otherwise(role).alias("role"), text.alias("text"),
        F.when(gone, 0).when(pick == 3, 2).otherwise(1).alias("copies"),
    )
