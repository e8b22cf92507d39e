"""Archives of members (tar): an index from their headers alone, and members read at their places."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from sitewatch.sources.dumps import Bytes, listed, opened

#: Bytes that a header's read takes along; members themselves are passed over.
HEADER = 4096


class _Members(DataSource):
    """(path, member, offset, size) of the files in the archives below ``path``; a task walks the headers of one archive."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "path string, member string, offset bigint, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return _MemberReader(self.options["path"])


class _MemberReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Bytes]:
        return [Bytes(p, 0, n) for p, n in listed(self.path) if p.endswith(".tar")] or [Bytes("", 0, 0)]

    def read(self, split: Bytes) -> Iterator[tuple]:
        if not split.path:
            return
        system, place = opened(split.path)
        with system.open_input_file(place) as raw, io.BufferedReader(raw, HEADER) as f, tarfile.open(fileobj=f, mode="r:") as tar:
            while (m := tar.next()) is not None:
                tar.members.clear()  # else all headers of the archive stay in memory
                if m.isreg():
                    yield split.path, m.name, m.offset_data, m.size


def archive_index(spark: SparkSession, path: str, mark: str = "/store/") -> DataFrame:
    """(key, path, member, offset, size): of each object key the first member, by archive and then place in it.

    A member's key is what follows the last ``mark`` in its name, or the whole name. Folders, links and devices are no members; an empty
    archive has none. A damaged header is an error.
    """
    spark.dataSource.register(_Members)
    rows = spark.read.format("tar_members").option("path", path).load()
    first = F.min(F.struct("path", "offset", "member", "size")).alias("m")
    return rows.groupBy(F.substring_index("member", mark, -1).alias("key")).agg(first).select("key", "m.path", "m.member", "m.offset", "m.size")


def with_bytes(index: DataFrame, stretch: int = 64 << 20, held: int = 4 << 20) -> DataFrame:
    """Rows of an index (with path, offset, size) and their members' bytes as ``data``.

    Rows go to a task by stretches of ``stretch`` bytes of an archive and are sorted by place, so that an archive is opened by few
    tasks and read forwards. Some ``held`` bytes of members are in memory, or one member.
    """
    names = index.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = file = None
        for whole in batches:
            done, size_held, data = 0, 0, []

            def filled(end: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*whole.slice(done, end - done).columns, pa.array(data, pa.binary())], [*names, "data"])

            places = zip(*(whole.column(names.index(c)).to_pylist() for c in ("path", "offset", "size")))
            for i, (p, offset, size) in enumerate(places):
                if data and size_held + size > held:
                    yield filled(i)
                    done, size_held, data = i, 0, []
                if p != path:
                    if file is not None:
                        file.close()
                    system, place = opened(p)
                    path, file = p, system.open_input_file(place)
                data.append(file.read_at(size, offset))
                size_held += size
            if data:
                yield filled(whole.num_rows)
        if file is not None:
            file.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema) + ", data binary"
    return index.repartition("path", F.floor(F.col("offset") / stretch)).sortWithinPartitions("path", "offset").mapInArrow(each, schema)


def write_archives(members: DataFrame, folder: str) -> DataFrame:
    """Write ``members`` (archive, place, name, data) as ``folder``/archive.tar, whose name may have folders, members by place; (archive, members) when it is run.

    Spark sorts, and a task streams its archives one after the other. An archive that a repeated task writes again replaces the same file.
    """
    rows = members.select("archive", "place", "name", "data").repartition("archive").sortWithinPartitions("archive", "place", "name")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = tar = out = None
        n = 0

        def over() -> pa.RecordBatch:
            tar.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([n], pa.int64())], ["archive", "members"])

        for b in batches:
            for a, name, data in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                if a != archive:
                    if tar is not None:
                        yield over()
                    system, place = opened(folder)
                    system.create_dir(f"{place}/{a}".rsplit("/", 1)[0])
                    archive, n, out = a, 0, system.open_output_stream(f"{place}/{a}.tar")
                    tar = tarfile.open(fileobj=out, mode="w|")
                entry = tarfile.TarInfo(name)
                entry.size = len(data)
                tar.addfile(entry, io.BytesIO(data))
                tar.members.clear()
                n += 1
        if tar is not None:
            yield over()

    return rows.mapInArrow(each, "archive string, members bigint")
