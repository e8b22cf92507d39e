"""Parsers of text that clients and configurations write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = r"(Z|[+-]\d{2}:\d{2})$"


def iso_naive(text: Column) -> Column:
    """An ISO time without its offset; null where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, OFFSET, "")).cast("timestamp_ntz")


def local_naive(text: Column, local_minutes: int) -> Column:
    """An ISO time as local time: one with an offset is converted, one without is local."""
    offset = F.regexp_extract(text, OFFSET, 1)
    minutes = F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")
    minutes = F.when(offset == "Z", 0).when(offset.startswith("-"), -minutes).otherwise(minutes)
    shift = F.when(offset == "", 0).otherwise(F.lit(local_minutes) - minutes)
    return iso_naive(text) + F.make_dt_interval(F.lit(0), F.lit(0), shift)


def list_text(text: Column) -> Column:
    """A JSON array, else a list with commas; blank parts go."""
    parts = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, ","))
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def polygon_points(text: Column) -> Column:
    """Corners of a JSON polygon; entries that aren't pairs are left out."""
    points = F.from_json(text, "array<array<double>>")
    return F.filter(F.coalesce(points, F.array().cast("array<array<double>>")), lambda p: F.size(p) == 2)


def ip_number(host: Column) -> Column:
    """An IPv4 address as a number, null for other hosts."""
    part = lambda i: F.split(host, r"\.")[i].cast("bigint")
    return F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))
