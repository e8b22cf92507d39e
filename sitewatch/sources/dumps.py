r"""Table dumps (``COPY name (columns) FROM stdin;``, a line a row, ``\.``) read in splits of bytes, only where the wanted table lies."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import pyarrow.csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a split; a line belongs to the split in which it begins.
SPLIT = 32 << 20
# What an escaped letter of a dump stands for.
ESCAPES = {b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v"}
_MARK = re.compile(rb"^(?:COPY [^\n]* FROM stdin;|\\\.)$", re.MULTILINE)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|x[0-9A-Fa-f]{1,2}|.)", re.DOTALL)
_NAME = re.compile(r'"((?:[^"]|"")*)"|([^\s,"]+)')


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def listed(path: str) -> list[tuple[str, int]]:
    """Path and bytes of the files below a folder, or of one file; those whose names begin with a dot or a line aren't data."""
    system, place = opened(path)
    root = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else [info]
    return sorted((root + f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._")


@dataclass
class Bytes(InputPartition):
    path: str
    start: int
    end: int


def lines_from(split: Bytes, chunk: int = 8 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of whole lines that begin in a split, some ``chunk`` bytes at a time."""
    system, place = opened(split.path)
    with system.open_input_file(place) as raw, io.BufferedReader(raw, 1 << 20) as f:
        f.seek(max(0, split.start - 1))
        if split.start:
            f.readline()  # the rest of a line that began before; only its end, if a line begins with the split
        at = f.tell()
        while at < split.end:
            data = f.read(min(chunk, split.end - at))
            if not data:
                return
            if not data.endswith(b"\n"):
                data += f.readline()
            yield at, data
            at += len(data)


class _Marks(DataSource):
    """Lines that may begin or end a table's rows: (path, at, after, head); ``head`` is null for an end."""

    @classmethod
    def name(cls) -> str:
        return "dump_marks"

    def schema(self) -> str:
        return "path string, at bigint, after bigint, head string"

    def reader(self, schema) -> DataSourceReader:
        return _MarkReader(self.options["path"], int(self.options["split"]))


class _MarkReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Bytes]:
        return [Bytes(p, a, min(a + self.split, n)) for p, n in listed(self.path) for a in range(0, n, self.split)] or [Bytes("", 0, 0)]

    def read(self, split: Bytes) -> Iterator[tuple]:
        for at, data in lines_from(split) if split.path else ():
            for m in _MARK.finditer(data):
                head = m.group().decode("utf-8", "replace")
                yield split.path, at + m.start(), at + m.end() + 1, head if head != "\\." else None


class _Rows(DataSource):
    """Rows of given stretches of files, all columns as text."""

    @classmethod
    def name(cls) -> str:
        return "dump_rows"

    def reader(self, schema) -> DataSourceReader:
        return _RowReader(json.loads(self.options["blocks"]), int(self.options["split"]), [f.name for f in schema])


class _RowReader(DataSourceReader):
    def __init__(self, blocks: list, split: int, wanted: list[str]):
        self.blocks, self.split, self.wanted = blocks, split, wanted

    def partitions(self) -> list[InputPartition]:
        cut = [Stretch(p, x, min(x + self.split, b), columns) for p, a, b, columns in self.blocks for x in range(a, b, self.split)]
        return cut or [Stretch("", 0, 0, [])]

    def read(self, split: Stretch) -> Iterator[pa.RecordBatch]:
        for _, data in lines_from(split) if split.path else ():
            found = pa.csv.read_csv(
                pa.BufferReader(data), pa.csv.ReadOptions(use_threads=False, block_size=len(data) + 1, column_names=split.columns),
                pa.csv.ParseOptions(delimiter="\t", quote_char=False, escape_char=False, newlines_in_values=False, ignore_empty_lines=False),
                pa.csv.ConvertOptions(column_types={c: pa.string() for c in split.columns}, null_values=["\\N"], strings_can_be_null=True, include_columns=self.wanted))
            yield from pa.table([unescaped(c) for c in found.columns], self.wanted).to_batches(4096)


@dataclass
class Stretch(Bytes):
    columns: list[str]


def unescaped(texts: pa.ChunkedArray) -> pa.ChunkedArray:
    """Texts without their escapes; a column without any is left as it is."""
    if not pa.compute.any(pa.compute.match_substring(texts, "\\")).as_py():
        return texts

    def one(m: re.Match) -> bytes:
        x = m.group(1)
        if x[:1].isdigit() and x[0] < 56:
            return bytes([int(x, 8) & 255])
        return bytes([int(x[1:], 16)]) if x[:1] == b"x" and len(x) > 1 else ESCAPES.get(x, x)

    values = [t if t is None or "\\" not in t else _ESCAPE.sub(one, t.encode()).decode("utf-8", "replace") for t in texts.to_pylist()]
    return pa.chunked_array([pa.array(values, pa.string())])


def head_parts(head: str) -> tuple[str, list[str]]:
    """The table's name, without quotes, and its columns; no columns where the head names none."""
    m = re.fullmatch(r"COPY (.*?)(?: \((.*)\))? FROM stdin;", head)
    plain = lambda text: [(a.replace('""', '"') if a else b) for a, b in _NAME.findall(text or "")]
    return m.group(1).replace('"', ""), plain(m.group(2))


def dump_blocks(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(path, start, end, head) of the rows of each table in the dumps at ``path``; an empty table has ``start`` = ``end``.

    All files are read once, for the lines that may begin or end a table. A row of a table may look like the head of another; so a head counts
    only as the first mark of a file or after an end. A dump that breaks off has a last table without an end, which
    goes to the end of what is there: ``end`` is null.
    """
    spark.dataSource.register(_Marks)
    marks = spark.read.format("dump_marks").option("path", path).option("split", split).load()
    w = Window.partitionBy("path").orderBy("at")  # marks of a file: two a table, and rows that look like one
    opens = F.col("head").isNotNull() & ((F.lag("at").over(w).isNull()) | F.lag("head").over(w).isNull())
    ends = F.min(F.when(F.col("head").isNull(), F.col("at"))).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return marks.withColumn("opens", opens).withColumn("end", ends).where("opens").select("path", F.col("after").alias("start"), "end", "head")


def dumped(spark: SparkSession, path: str, table: str, schema: str, split: int = SPLIT) -> DataFrame:
    r"""Rows of ``table`` in the dumps at ``path`` (a file or a folder), as ``schema``, which names the columns to read.

    Columns are found by the head's names, in whatever order (where a head names none, by ``schema``'s order). ``\N`` is null,
    an empty text is one, escapes are undone; what can't be cast is an error in Spark's strict mode. A row with
    another number of columns than its head is an error. Files without the table give no rows.
    """
    fields = spark.createDataFrame([], schema).schema
    sizes = dict(listed(path))
    found = [r for r in dump_blocks(spark, path, split).collect() if head_parts(r["head"])[0] == table]  # a row a table and file
    blocks = [(r["path"], r["start"], sizes[r["path"]] if r["end"] is None else r["end"], head_parts(r["head"])[1] or fields.names) for r in found]
    lost = {c for *_, columns in blocks for c in fields.names if c not in columns}
    if lost:
        raise ValueError(f"{table} has no columns {sorted(lost)}")
    spark.dataSource.register(_Rows)
    text = ", ".join(f"`{c}` string" for c in fields.names)
    rows = spark.read.format("dump_rows").schema(text).option("blocks", json.dumps(blocks)).option("split", split).load()
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])


def dump_lines(rows: DataFrame, table: str) -> DataFrame:
    r"""(line): each partition of ``rows`` as a dump of its own, with head, escaped rows and end. Arrays and maps must be texts already."""
    def escaped(name: str):
        x = F.col(f"`{name}`").cast("string")
        for raw, letter in (("\\", "\\\\"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\v", "\\v")):
            x = F.replace(x, F.lit(raw), F.lit(letter))
        return F.coalesce(x, F.lit("\\N"))

    names = ", ".join('"' + c.replace('"', '""') + '"' if re.search(r"[^a-z0-9_]", c) else c for c in rows.columns)
    head = f"COPY {table} ({names}) FROM stdin;"

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(["--", "SET client_encoding = 'UTF8';", "", head])], ["line"])
        yield from (pa.RecordBatch.from_arrays([b.column(0)], ["line"]) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array(["\\.", "", "-- over"])], ["line"])

    return rows.select(F.concat_ws("\t", *map(escaped, rows.columns)).alias("line")).mapInArrow(around, "line string")
