"""Dumps read in splits: escapes, other tables, rows that look like marks, and splits that begin anywhere."""

import pytest
from sitewatch.operators.exchange import dump_columns
from sitewatch.sources.dumps import dump_blocks, dump_lines, dumped, head_parts

DATA = "/root/testdata/sf0.001"
ODD = ["plain", "", None, "\\N", "a\tb", "two\nlines", "\\.", "back\\slash\\", "COPY t (x) FROM stdin;", "\r\n\b\f\v", "é 通道 \U0001f600", "\\t", "x" * 5000]


@pytest.mark.parametrize("split", [1 << 20, 64])
def test_round_trip_whatever_the_splits(spark, tmp_path, split):
    rows = [(i, v, i % 2 == 0, ODD[-1 - i]) for i, v in enumerate(ODD)]
    frame = spark.createDataFrame(rows, '`id` bigint, `odd name` string, `flag` boolean, `other` string').repartition(3)
    dump_lines(frame, "public.events").write.text(str(tmp_path / "d"))
    dump_lines(spark.createDataFrame([("COPY public.events (id) FROM stdin;",), ("1\t2",)], "t string"), "public.notes").write.mode("append").text(str(tmp_path / "d"))
    got = dumped(spark, str(tmp_path / "d"), "public.events", "other string, id bigint, `odd name` string, flag boolean", split)
    assert sorted((r["id"], r["odd name"], r["flag"], r["other"]) for r in got.collect()) == sorted(rows, key=lambda r: r[0])
    assert dumped(spark, str(tmp_path / "d"), "public.nothing", "id bigint", split).count() == 0
    if split == 64:
        assert got.rdd.getNumPartitions() > 100  # a block is many splits
        with pytest.raises(ValueError):
            dumped(spark, str(tmp_path / "d"), "public.events", "gone string", split)


def test_written_elsewhere(spark, tmp_path):
    r"""Octal and hex escapes, a head without columns, an empty table, a table whose rows look like heads, and one that breaks off."""
    (tmp_path / "a.sql").write_bytes(
        b"-- dump\nCOPY public.empty (a) FROM stdin;\n\\.\n\nCOPY one FROM stdin;\nCOPY one FROM stdin;\n\\101\\x42\\q\n\n\\N\n\\.\n"
        b'COPY "public"."q" ("a ""b", c) FROM stdin;\n1\t2\n3\t\\N')
    assert [tuple(r) for r in dumped(spark, f"{tmp_path}/a.sql", "one", "x string").collect()] == [("COPY one FROM stdin;",), ("ABq",), ("",), (None,)]
    assert dumped(spark, str(tmp_path), "public.empty", "a bigint").collect() == []
    assert sorted(tuple(r) for r in dumped(spark, str(tmp_path), "public.q", '`a "b` int', 5).collect()) == [(1,), (3,)]
    assert dump_blocks(spark, str(tmp_path), 9).count() == 3
    assert head_parts("COPY t FROM stdin;") == ("t", [])
    (tmp_path / "b.sql").write_bytes(b"COPY one (x) FROM stdin;\n1\t2\n\\.\n")
    with pytest.raises(Exception, match="(?i)column"):
        dumped(spark, f"{tmp_path}/b.sql", "one", "x string").collect()
    with pytest.raises(FileNotFoundError):
        dumped(spark, f"{tmp_path}/none", "one", "x string")


def test_all_columns_come_back(spark, tmp_path):
    rows = dump_columns(spark, DATA)
    assert len(rows.columns) == 34
    dump_lines(rows, "public.events").write.text(str(tmp_path / "d"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    got = dumped(spark, str(tmp_path / "d"), "public.events", schema, 20_000)
    assert got.exceptAll(rows).count() == 0 and rows.exceptAll(got).count() == 0 and rows.where("note like '%\n%' and note like '%\t%'").count() > 100
