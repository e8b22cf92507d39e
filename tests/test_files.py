"""Log files by hour and archives: what is opened, odd names and members, empty ones."""

import datetime
import io
import tarfile

import pytest
from pyspark.sql import functions as F
from sitewatch.operators.runtime import parsed_lines
from sitewatch.sources.archives import archive_index, with_bytes, write_archives
from sitewatch.sources.logs import hourly_lines
from sitewatch.sources.views import log_lines

DATA = "/root/testdata/sf0.001"


def files_read(frame) -> int:
    """Files of the scan, as the plan that has been run counts them."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_only_the_hours_of_a_range_are_opened(spark, tmp_path):
    """Telemetry as a tree of files by hour, its days dealt to hours; other files lie beside them."""
    lines = log_lines(spark, DATA).where("year(ts) = 1995 and month(ts) < 4").select("ts", "line", "place.camera").collect()
    want, tree = [], {}
    for r in lines:
        at = datetime.datetime.combine(r["ts"], datetime.time(r["camera"] % 24)) if not isinstance(r["ts"], datetime.datetime) else r["ts"].replace(hour=r["camera"] % 24)
        tree.setdefault((f"worker-{r['camera'] % 2}", at), []).append(r["line"])
    for (component, at), some in tree.items():
        file = tmp_path / component / at.strftime("%Y/%m/%d/%H.log")
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("\n".join(some) + "\n", encoding="utf-8")
        if component == "worker-1" and datetime.datetime(1995, 2, 3, 4) <= at <= datetime.datetime(1995, 2, 20, 18):
            want += [(component, at, line) for line in some]
    (tmp_path / "worker-1" / "notes.txt").write_text("not a log\n")
    (tmp_path / "worker-1" / "1995" / "02" / "04" / "05.log.gz.part").parent.mkdir(parents=True, exist_ok=True)
    (tmp_path / "worker-1" / "1995" / "02" / "04" / "05.log.part").write_text("half\n")
    rows = hourly_lines(spark, str(tmp_path), "1995-02-03 04:30:00", "1995-02-20 18:00:00", ["worker-1"])
    assert sorted((r["component"], r["hour"], r["line"]) for r in rows.collect()) == sorted(want) and want
    hours = {at for c, at in tree if c == "worker-1" and datetime.datetime(1995, 2, 3, 4) <= at <= datetime.datetime(1995, 2, 20, 18)}
    assert files_read(rows.select("line")) == len(hours) < len(tree)
    every = hourly_lines(spark, str(tmp_path))
    assert every.count() == len(lines) and files_read(every.select("line")) == len(tree)
    in_order = [r["line"] for r in every.where("component = 'worker-0'").orderBy("hour", "place").collect()]
    assert in_order == [line for (c, at), some in sorted(tree.items()) if c == "worker-0" for line in some]
    assert parsed_lines(rows, "1999-01-01").where("at is not null").count() == 0


def test_archives(spark, tmp_path):
    long, big = "d" * 150 + "/store/" + "k" * 120, bytes(range(256)) * 3000
    rows = [("b", 1, "x/store/one", b"later"), ("a", 2, "y/store/one", b"second"), ("a", 1, "z/store/one", b"first"), ("b", 2, long, big), ("c", 1, "plain", b""), ("c", 2, "é/store/通道", b"\x00")]
    frame = spark.createDataFrame([(a, p, n, bytearray(x)) for a, p, n, x in rows], "archive string, place bigint, name string, data binary")
    written = {r["archive"]: r["members"] for r in write_archives(frame, str(tmp_path / "t")).collect()}
    assert written == {"a": 2, "b": 2, "c": 2}
    write_archives(frame, str(tmp_path / "t")).collect()  # once more changes nothing
    with tarfile.open(tmp_path / "t" / "d.tar", "w") as tar:  # as others write them: a folder, a link, a key that is there already
        tar.addfile(tarfile.TarInfo("store"))
        folder, link, again = tarfile.TarInfo("f/store/dir"), tarfile.TarInfo("f/store/link"), tarfile.TarInfo("f/store/one")
        folder.type, link.type, link.linkname, again.size = tarfile.DIRTYPE, tarfile.SYMTYPE, "f/store/one", 3
        tar.addfile(folder), tar.addfile(link), tar.addfile(again, io.BytesIO(b"old"))
    with tarfile.open(tmp_path / "t" / "e.tar", "w"):
        pass
    (tmp_path / "t" / "notes.txt").write_text("x")
    got = {r["key"]: (r["path"].rsplit("/", 1)[1], r["member"], bytes(r["data"])) for r in with_bytes(archive_index(spark, str(tmp_path / "t"))).collect()}
    assert got == {"one": ("a.tar", "z/store/one", b"first"), "k" * 120: ("b.tar", long, big), "plain": ("c.tar", "plain", b""), "通道": ("c.tar", "é/store/通道", b"\x00"), "store": ("d.tar", "store", b"")}
    (tmp_path / "t" / "f.tar").write_bytes(b"no archive" * 100)
    with pytest.raises(Exception, match="(?i)header"):
        archive_index(spark, str(tmp_path / "t")).collect()
    assert write_archives(frame.where("false"), str(tmp_path / "u")).collect() == []


def test_archives_of_many_volumes_give_the_same_index(spark, monkeypatch):
    from sitewatch.operators import search

    whole = sorted(tuple(r) for r in search.io13_archive_index(spark, DATA).collect())
    monkeypatch.setattr(search, "VOLUME", 4)
    sizes = search.archive_members(spark, DATA).groupBy("archive").count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) <= 16
    assert sorted(tuple(r) for r in search.io13_archive_index(spark, DATA).collect()) == whole and whole
