"""Event search, labels, names, evidence, orders and pages, set operations and parsers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.functions.clock import now, seconds
from sitewatch.functions.text import ip_number, iso_naive, list_text, local_naive, polygon_points
from sitewatch.functions.vocabulary import TYPES, event_label, expanded, matched_types, normal_key, type_label
from sitewatch.operators.runtime import folded
from sitewatch.sources.archives import archive_index, with_bytes, write_archives
from sitewatch.sources.store import placed
from sitewatch.sources.views import cameras, case_events, persons, safety_events, shown_events, table, typed
from sitewatch.streaming.replay import shared_folder

#: Order of the floors; others come last.
FLOORS = {"一楼": 1, "二楼": 2, "三楼": 3, "四楼": 4, "室外": 5, "户外": 5}
LEFT_OVER = "^(track_|unknown|person_)"


def filtered(events: DataFrame, camera: str | None = None, person: str | None = None, start: str | None = None, end: str | None = None, violations: bool = False) -> DataFrame:
    """Events by the filters that are given, the range with both its ends; a time that can't be read is a ValueError."""
    if camera:
        events = events.where(F.col("camera_id") == camera)
    if person:
        events = events.where(F.col("person_id") == person)
    for text, holds in ((start, lambda t: F.col("ts") >= t), (end, lambda t: F.col("ts") <= t)):
        if text:
            at = datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
            events = events.where(holds(F.lit(at.isoformat(" ")).cast("timestamp_ntz")))
    return events.where("is_violation") if violations else events


def f01_filtered_events(spark: SparkSession, d: str) -> DataFrame:
    rows = filtered(safety_events(spark, d), camera="cam_3", start="2024-01-05T00:00:00Z", end="2024-01-20T12:00:00", violations=True)
    return rows.select("event_id", "ts", "camera_id")


def f05_name_search(spark: SparkSession, d: str) -> DataFrame:
    """Events whose own name contains a text or whose person's name does: a left join with a flag, as OR rules out a semi join."""
    people = persons(spark, d).where(F.lower("name").contains("42")).select(F.col("id").alias("person_id"), F.lit(True).alias("named"))
    rows = case_events(spark, d).join(people, "person_id", "left")
    return rows.where(F.lower("person_name").contains("42") | F.col("named").isNotNull()).select("event_id", "person_id", "camera_id")


def f07_with_evidence(spark: SparkSession, d: str) -> DataFrame:
    return case_events(spark, d).where("is_violation and (key is not null or path is not null)").select("event_id")


def f06_raw_type_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events with a raw label among the spellings of a type, whatever their stored types are."""
    from sitewatch.functions.vocabulary import normal_key

    raw = F.transform(F.concat("missing", "actions"), normal_key)
    return safety_events(spark, d).where(F.arrays_overlap(raw, F.array(*map(F.lit, expanded("Safety Shoes"))))).select("event_id")


def f11_invalid_employees(spark: SparkSession, d: str) -> DataFrame:
    """Employees without a real name: blank, equal to the id, or what a tracker left."""
    name = F.trim("name")
    return persons(spark, d).where(F.col("employee") & ((name == "") | (name == F.col("id")) | F.lower(name).rlike(LEFT_OVER))).select("id", "name")


def settings_rows(spark: SparkSession, d: str) -> DataFrame:
    """Settings as they were saved, one row a save."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("n_nationkey") * 7 % 25).cast("int"))
    return table(spark, d, "nation").select(at.alias("updated_at"), (F.col("n_regionkey") + 1).alias("interval_hours"), "n_nationkey")


def io02_event_by_id(spark: SparkSession, d: str) -> DataFrame:
    return safety_events(spark, d).where("event_id = 123").select("event_id", "ts", "camera_id", "event_type").limit(1)


def io03_latest_settings(spark: SparkSession, d: str) -> DataFrame:
    return settings_rows(spark, d).orderBy(F.desc("updated_at"), F.desc("n_nationkey")).limit(1)


def f16_patrol_sightings(spark: SparkSession, d: str) -> DataFrame:
    """Sightings that count as patrols: by an inspector, at a patrol camera, while the latest settings have an interval."""
    inspectors = persons(spark, d).where("c_custkey % 5 = 0").select(F.col("id").alias("person_id"))
    at = cameras(spark, d).where("patrol").select("camera_id")
    valid = io03_latest_settings(spark, d).where("interval_hours > 0").select(F.lit(1).alias("one"))  # one row at most
    rows = safety_events(spark, d).where("event_type = 'view'").join(inspectors, "person_id", "left_semi").join(at, "camera_id", "left_semi")
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(valid), "one", "left_semi").select("event_id", "person_id", "camera_id")


def p01_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels of an event's raw lists, in their order."""
    return safety_events(spark, d).select("event_id", F.array_join(F.transform(F.concat("missing", "actions"), event_label), ";").alias("labels"))


def effective_types(events: DataFrame) -> Column:
    """The stored types, or those of the raw lists where none are stored."""
    return F.when(F.size(F.coalesce("stored", F.array().cast("array<string>"))) > 0, F.col("stored")).otherwise(matched_types(F.col("missing"), F.col("actions")))


def p02_effective_types(spark: SparkSession, d: str) -> DataFrame:
    rows = case_events(spark, d)
    return rows.select("event_id", F.array_join(effective_types(rows), ",").alias("types"))


def p03_evidence_urls(spark: SparkSession, d: str) -> DataFrame:
    """Where a browser finds the evidence: in the object store, else by the old file's name, else nowhere."""
    url = F.when(F.col("bucket").isNotNull() & F.col("key").isNotNull(), F.concat(F.lit("/api/events/objects/"), "bucket", F.lit("/"), "key"))
    url = url.when(F.col("path").isNotNull(), F.concat(F.lit("/api/events/snapshots/"), F.substring_index("path", "/", -1)))
    return case_events(spark, d).select("event_id", url.alias("url"))


def p04_event_names(spark: SparkSession, d: str) -> DataFrame:
    """The row's own name, else the directory's, else the id; an id of an unknown person is only unknown."""
    shown = F.when(F.col("k") % 20 == 0, F.concat(F.lit("unknown:"), F.col("user_id").cast("string"))).otherwise(F.col("person_id"))
    people = persons(spark, d).select(F.col("id").alias("shown_id"), F.col("name").alias("known_as"))
    rows = case_events(spark, d).withColumn("shown_id", shown).join(people, "shown_id", "left")
    return rows.select("event_id", F.when(F.col("shown_id").startswith("unknown:"), "unknown").otherwise(F.coalesce("person_name", "known_as", "shown_id")).alias("name"))


def p05_camera_names(spark: SparkSession, d: str) -> DataFrame:
    """The names of all cameras of an event in its order; a camera without a row keeps its id."""
    names = cameras(spark, d).select("camera_id", "name")
    rows = case_events(spark, d).select("event_id", F.posexplode("cameras").alias("place", "camera_id")).join(names, "camera_id", "left")
    parts = F.array_sort(F.collect_list(F.struct("place", F.coalesce("name", "camera_id").alias("name"))))
    return rows.groupBy("event_id").agg(F.array_join(F.transform(parts, lambda p: p["name"]), "、").alias("names"))


def p06_gallery_messages(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("missing", F.transform("actions", lambda a: F.concat(F.lit("action:"), a)))
    person = F.coalesce("person_id", F.lit("unknown person"))
    text = F.when(F.size(raw) > 0, F.concat(person, F.lit(" missing "), F.translate(F.array_join(raw, ", "), "_", " "))).otherwise(F.concat(person, F.lit(" violation")))
    return case_events(spark, d).where("is_violation").select("event_id", text.alias("message"))


def p09_camera_short_names(spark: SparkSession, d: str) -> DataFrame:
    """The suffix, else the name without its floor before it, else the name."""
    suffix, floor, name = F.trim("suffix"), F.trim("floor"), F.trim("name")
    rest = F.trim(F.substr(name, F.length(floor) + 1))
    short = F.when(suffix != "", suffix).when((floor != "") & name.startswith(floor) & (rest != ""), rest).otherwise(name)
    return cameras(spark, d).select("camera_id", short.alias("short"))


def p10_event_options(spark: SparkSession, d: str) -> DataFrame:
    """All types in canonical order with their labels, as a filter offers them, and how many shown events each would find."""
    names = spark.createDataFrame([(i + 1, t) for i, t in enumerate(TYPES)], "position int, key string")
    found = typed(shown_events(spark, d)).select(F.explode("types").alias("key")).groupBy("key").agg(F.count("*").alias("events"))
    return names.join(found, "key", "left").select("position", "key", type_label(F.col("key")).alias("label"), F.coalesce("events", F.lit(0)).alias("events"))


def o01_event_total(spark: SparkSession, d: str) -> DataFrame:
    """The separate count beside a page: all rows of its filter."""
    return filtered(safety_events(spark, d), camera="cam_3", violations=True).agg(F.count("*").alias("total"))


def _ranked(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order with their places; only these are numbered."""
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def o03_person_order(spark: SparkSession, d: str) -> DataFrame:
    """All employees by segment, falling balance and id."""
    rows = persons(spark, d).where("employee")
    return placed(rows, [F.col("c_mktsegment").asc_nulls_last(), F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")]).select("place", "id")


def o04_camera_order(spark: SparkSession, d: str) -> DataFrame:
    """All cameras by floor, then host as a number, then names."""
    floor = F.trim("floor")
    order = F.coalesce(F.create_map(*[F.lit(x) for pair in FLOORS.items() for x in pair])[floor], F.lit(99))
    host = F.trim("host")
    rows = cameras(spark, d).select("camera_id", order.alias("a"), F.coalesce(ip_number(host), F.lit(2**32 - 1)).alias("b"), F.when(host == "", "").otherwise(host).alias("c"), floor.alias("e"), F.trim("suffix").alias("f"), F.trim("name").alias("g"))
    return placed(rows, [F.col(x) for x in ("a", "b", "c", "e", "f", "g", "camera_id")]).select("place", "camera_id")


def schedules(spark: SparkSession, d: str) -> DataFrame:
    """A row for each day with orders: the ids on duty, its smallest and largest customer, as JSON text, as comma text, or as one old id."""
    date = F.to_date("o_orderdate")
    rows = table(spark, d, "orders").groupBy(date.alias("shift_date")).agg(F.min("o_custkey").cast("string").alias("x"), F.max("o_custkey").cast("string").alias("y"))
    day = F.date_diff("shift_date", F.lit("1992-01-01").cast("date"))
    text = F.when(day % 7 == 0, F.col("x")).when(day % 2 == 0, F.concat(F.lit('["'), "x", F.lit('", "'), "y", F.lit('"]'))).otherwise(F.concat("x", F.lit(" , ,"), "y"))
    return rows.select("shift_date", day.alias("day"), text.alias("day_ids"))


def o05_schedule_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of ten with the total and whether more follow."""
    rows = schedules(spark, d)
    total = rows.agg(F.count("*").alias("total"))  # one row
    page = rows.orderBy(F.desc("shift_date")).offset(20).limit(10)
    return page.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").select("shift_date", "day_ids", "total", (F.col("total") > 30).alias("has_more"))


def o06_latest_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The newest ten violations with evidence among the newest forty: it may hold fewer."""
    newest = case_events(spark, d).where("is_violation").orderBy(F.desc("ts"), F.desc("event_id")).limit(40)
    return newest.where("key is not null or path is not null").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "ts")


def o07_alert_feed(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of the last hours, each id once though it was sent twice, newest first."""
    e = safety_events(spark, d).where(F.col("is_violation") & (F.col("ts") >= now() - F.expr("INTERVAL 12 HOURS")) & (F.col("ts") <= now()))
    sent = e.unionByName(e.where("event_id % 2 = 0"))
    return sent.groupBy("event_id").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), F.desc("event_id")).limit(10)


def o08_camera_type_table(spark: SparkSession, d: str) -> DataFrame:
    """A row for each camera with a column for each of three types; cameras without any of them are left out."""
    kinds = TYPES[:3]
    rows = safety_events(spark, d).where("is_violation").select("camera_id", F.explode(matched_types(F.col("missing"), F.col("actions"))).alias("type")).where(F.col("type").isin(kinds))
    return rows.groupBy("camera_id").pivot("type", kinds).count().na.fill(0)


def o09_visits(spark: SparkSession, d: str) -> DataFrame:
    """Visits by falling start and end, the first twenty."""
    end = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 20).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", end.alias("ends"))
    return _ranked(rows, [F.desc("o_orderdate"), F.desc("ends"), F.col("o_orderkey")], 20).select("place", "o_orderkey")


def u01_gallery(spark: SparkSession, d: str) -> DataFrame:
    """Employees, external persons and registrations in one gallery."""
    row = lambda df, kind, key, name: df.select(F.lit(kind).alias("subject_type"), F.col(key).cast("string").alias("subject_id"), F.col(name).alias("name"))
    p = persons(spark, d)
    parts = [row(p.where("employee"), "employee", "id", "name"), row(p.where("not employee"), "external_person", "id", "name"), row(table(spark, d, "supplier"), "external_registration", "s_suppkey", "s_name")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def u03_schedule_rows(spark: SparkSession, d: str) -> DataFrame:
    """Schedules of several sources: an override wins, else the first source that has the date."""
    rows = schedules(spark, d)
    parts = [rows.where("day % 10 = 0").withColumn("day_ids", F.lit("override")).withColumn("rank", F.lit(0)), rows.where("day % 4 <> 0").withColumn("rank", F.lit(1)), rows.where("day % 3 <> 0").withColumn("day_ids", F.concat("day_ids", F.lit("*"))).withColumn("rank", F.lit(2))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("shift_date").agg(F.min_by("day_ids", "rank").alias("day_ids"))


def similar_sets(a: Column, b: Column) -> Column:
    """Equal, one in the other, or half of the smaller one common; two empty sets are similar, one empty set is not."""
    both, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), True).when(least == 0, False).otherwise(both >= F.lit(0.5) * least)


def u04_set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Each event's missing equipment beside that of the same person's event before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = safety_events(spark, d).withColumn("b", F.lag("missing").over(w)).where("b is not null")
    a, b = F.col("missing"), F.col("b")
    return rows.select(
        "event_id", F.size(F.array_union(a, b)).alias("n_union"), F.size(F.array_intersect(a, b)).alias("n_both"), F.size(F.array_except(a, b)).alias("n_new"),
        (F.size(F.array_except(a, b)) == 0).alias("inside"), similar_sets(a, b).alias("similar"))


def s03_expanded_types(spark: SparkSession, d: str) -> DataFrame:
    """Filter names with the spellings they stand for, and the events whose raw lists hold one of these."""
    names = spark.createDataFrame([(t, expanded(t)) for t in [*TYPES, "new-type", " "]], "name string, list array<string>")
    raw = safety_events(spark, d).select("event_id", F.explode(F.concat("missing", "actions")).alias("raw")).select("event_id", normal_key(F.col("raw")).alias("spelling"))
    wanted = names.select("name", F.explode("list").alias("spelling"))  # some for each type
    found = raw.join(F.broadcast(wanted), "spelling").groupBy("name", "event_id").agg(F.lit(1)).groupBy("name").agg(F.count("*").alias("events"))
    return names.join(found, "name", "left").select("name", F.array_join("list", "|").alias("spellings"), F.coalesce("events", F.lit(0)).alias("events"))


def s04_label_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = safety_events(spark, d).select(F.explode(F.concat("missing", "actions")).alias("raw"))
    return rows.groupBy(type_label(F.col("raw")).alias("label")).agg(F.count("*").alias("n"))


def _written_times(spark: SparkSession, d: str) -> DataFrame:
    """Event times as clients write them: with Z, with an offset, with a fraction, or wrong."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    ways = [F.concat(text, F.lit("Z")), F.concat(text, F.lit("+08:00")), F.concat(text, F.lit(".250")), F.concat(text, F.lit(".5-05:30")), F.lit("yesterday")]
    return safety_events(spark, d).select("event_id", F.element_at(F.array(*ways), (F.col("event_id") % 5 + 1).cast("int")).alias("text"))


def s05_naive_times(spark: SparkSession, d: str) -> DataFrame:
    """Times as written: an offset is dropped and not converted."""
    return _written_times(spark, d).select("event_id", iso_naive(F.col("text")).alias("at"))


def s06_local_times(spark: SparkSession, d: str) -> DataFrame:
    """Times with an offset in local time (eight hours before UTC's clock reads the same); without one they are local."""
    return _written_times(spark, d).select("event_id", local_naive(F.col("text"), 8 * 60).alias("at"))


def s08_schedule_ids(spark: SparkSession, d: str) -> DataFrame:
    """Lists written as JSON or with commas."""
    return schedules(spark, d).select("shift_date", F.array_join(list_text(F.col("day_ids")), "|").alias("ids"))


def j17_on_duty(spark: SparkSession, d: str) -> DataFrame:
    """The inspectors of each day in the order of the list, without ids that nobody has."""
    people = persons(spark, d).select("id", "name")
    rows = schedules(spark, d).select("shift_date", F.posexplode(list_text(F.col("day_ids"))).alias("place", "id"))
    return rows.join(people, "id").select("shift_date", "place", "id", "name")


def j21_without_camera(spark: SparkSession, d: str) -> DataFrame:
    """Events' camera lists after a camera is gone, those that held it."""
    rows = case_events(spark, d).where(F.array_contains("cameras", "cam_4"))
    return rows.select("event_id", F.array_join(F.array_distinct(F.array_remove("cameras", "cam_4")), ",").alias("cameras"))


def s09_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Corners of polygons written as JSON; corners of another size are left out, text that is no JSON has none."""
    n = F.col("number")
    text = F.when(n % 4 == 3, "[[1,2],").otherwise(F.concat(F.lit("[["), n.cast("string"), F.lit(",2],[3,4,5],[6.5,"), (n * 2).cast("string"), F.lit("],[9]]")))
    points = polygon_points(text)
    return cameras(spark, d).select("camera_id", F.size(points).alias("corners"), F.aggregate(points, F.lit(0.0), lambda s, p: s + p[0] * p[1]).alias("mixed"))


def j19_missing_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Exported rows and the archive's index by object key, whose first member wins; rows without one are counted by camera."""
    rows = case_events(spark, d).where("is_violation and key is not null").select("camera_id", "key")
    index = case_events(spark, d).where("key is not null and event_id % 4 <> 0").select("key", F.col("event_id").alias("member"))
    index = index.unionByName(index.where("member % 3 = 0").withColumn("member", F.col("member") + 1_000_000)).groupBy("key").agg(F.min("member").alias("member"))
    return rows.join(index, "key", "left").groupBy("camera_id").agg(F.count("*").alias("n"), F.count_if(F.col("member").isNull()).alias("missing"))


def f17_export_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a snapshot export: violations with evidence in the store, oldest first, as numbered lines."""
    rows = case_events(spark, d).where("is_violation and bucket is not null and key is not null")
    return placed(rows, [F.col("ts"), F.col("event_id")]).select("place", "event_id", "key")


def a14_person_counters(spark: SparkSession, d: str, touch: int = 6 * 3600) -> DataFrame:
    """Counters that a service would keep up: events, violations, and when last seen.

    A violation moves that time always; a mere sighting only when ``touch`` seconds have gone since. So only sightings after the last violation
    are followed one by one.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = safety_events(spark, d).where("person_id is not null").select("person_id", "event_id", micros.alias("at"), "is_violation")
    start = F.coalesce(F.max(F.when(F.col("is_violation"), F.col("at"))), F.min("at"))
    totals = rows.groupBy("person_id").agg(F.count("*").alias("events"), F.count_if("is_violation").alias("violations"), start.alias("start"))

    def step(state, row):
        if row is None:
            return state, [state]
        person, seen = state or (row["person_id"], row["start"])
        return (person, row["at"] if row["at"] - seen >= touch * 1_000_000 else seen), []

    later = rows.where("not is_violation").join(totals.select("person_id", "start"), "person_id").where("at > start").select("person_id", "event_id", "at", "start")
    moved = folded(later, ["person_id"], ["at", "event_id"], step, "person_id string, seen bigint")
    seen = F.timestamp_micros(F.coalesce("seen", "start")).cast("timestamp_ntz")
    return totals.join(moved, "person_id", "left").select("person_id", "events", "violations", seen.alias("last_seen"))


def a13_top_counters(spark: SparkSession, d: str) -> DataFrame:
    """Five persons by violations and then by when last seen."""
    rows = a14_person_counters(spark, d)
    return _ranked(rows, [F.desc("violations"), F.desc("last_seen"), F.col("person_id")], 5).select("place", "person_id", "violations")


def a11_online_cameras(spark: SparkSession, d: str) -> DataFrame:
    """Cameras that are on, and the last patrol."""
    on = cameras(spark, d).where("enabled").agg(F.count("*").alias("online"))
    last = safety_events(spark, d).where("event_type = 'view'").agg(F.max("ts").alias("last_patrol_at"))  # one row each
    return on.withColumn("one", F.lit(1)).join(F.broadcast(last.withColumn("one", F.lit(1))), "one").select("online", "last_patrol_at")


def a32_active_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Violations whose latest event is still open, by source; the source may be unknown."""
    latest = safety_events(spark, d).groupBy("user_id", "source").agg(F.max_by("is_violation", F.struct("ts", "event_id")).alias("open"))
    return latest.where("open").groupBy("source").agg(F.count("*").alias("active"))


def a31_life_sets(spark: SparkSession, d: str) -> DataFrame:
    """All equipment missed over the life of a person's day."""
    rows = safety_events(spark, d).where("is_violation").groupBy("user_id", F.to_date("ts").alias("day"))
    return rows.agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("missing")))), "|").alias("missing"))


def j14_clip_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames within three minutes of a violation of the same camera: both sides are cut into buckets of six minutes."""
    e = safety_events(spark, d).select("event_id", "camera_id", "is_violation", seconds(F.col("ts")).alias("at"))
    spans = e.where("is_violation").select(F.col("event_id").alias("event"), "camera_id", F.col("at").alias("t"), F.explode(F.sequence(F.floor((F.col("at") - 180) / 360), F.floor((F.col("at") + 180) / 360))).alias("bucket"))
    frames = e.select("event_id", "camera_id", "at", F.floor(F.col("at") / 360).alias("bucket"))
    return spans.join(frames, ["camera_id", "bucket"]).where("at between t - 180 and t + 180").groupBy("event").agg(F.count("*").alias("frames"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def f09_exemption(spark: SparkSession, d: str) -> DataFrame:
    """Whether any visit holds a moment: one row is enough to know."""
    at = F.expr("timestamp_ntz'1998-06-30 12:00:00'")
    end = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 20).cast("int"))
    one = table(spark, d, "orders").where((F.col("o_orderdate") <= at) & (end >= at)).limit(1)
    return one.agg((F.count("*") > 0).alias("exempt"))


#: Places of a volume, as a power of two.
VOLUME = 16


def archive_members(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots in four archives; every fifth is there twice, one half of those first in the archive that comes before all others.

    An archive is a folder of volumes in the order of their members' places, so that no task writes or reads more than a volume.
    """
    e = case_events(spark, d).where("key is not null")
    own, n = F.concat(F.lit("part-"), (1 + F.col("event_id") % 3).cast("string")), F.col("event_id").cast("string")
    body = F.concat(F.lit("snap "), n, F.repeat(F.lit("."), (F.col("event_id") % 50).cast("int")))
    first = e.select(own.alias("part"), F.col("event_id").alias("place"), F.concat(F.lit("own/store/"), "key").alias("name"), body.cast("binary").alias("data"))
    part = F.when(F.col("event_id") % 10 == 0, "part-0").otherwise(own)
    again = e.where("event_id % 5 = 0").select(part.alias("part"), (F.col("event_id") + (1 << 40)).alias("place"), F.concat(F.lit("again/store/"), "key").alias("name"), F.concat(F.lit("again "), n).cast("binary").alias("data"))
    volume = F.format_string("%s/%012d/%s", "part", F.shiftright("place", VOLUME), "part")
    return first.unionByName(again).select(volume.alias("archive"), "place", "name", "data")


def io13_archive_index(spark: SparkSession, d: str) -> DataFrame:
    """Members of archives by the object key at the end of their names; the first member of a key counts, and only it is read."""
    folder = shared_folder(spark)
    write_archives(archive_members(spark, d), folder).agg(F.sum("members")).collect()  # one row; the files are what it is run for
    rows = with_bytes(archive_index(spark, folder))
    return rows.select("key", F.substring_index("path", "/", -1).alias("part"), "member", "size", F.md5("data").alias("md5"))


def io14_exported_rows(spark: SparkSession, d: str) -> DataFrame:
    """The export as plain SQL: violations with a stored snapshot."""
    return spark.sql("select event_id, ts, key from {e} where is_violation and bucket is not null and key is not null order by ts, event_id", e=case_events(spark, d))


def s30_file_names(spark: SparkSession, d: str) -> DataFrame:
    """The old file's name, and a name for the export from the time, without characters that files can't have."""
    stamp = F.translate(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), " :/", "_--")
    return case_events(spark, d).where("path is not null").select("event_id", F.substring_index("path", "/", -1).alias("base"), F.concat(stamp, F.lit(".jpg")).alias("export"))


def s31_formatted(spark: SparkSession, d: str) -> DataFrame:
    """Labels and person ids as clients show them: known ones by name, others in title case; persons and tracks by number."""
    from sitewatch.functions.vocabulary import LABELS, literal_map

    raw = F.element_at(F.array(*map(F.lit, ["action:fall_detected", " NO-hardhat ", "safety-shoes", "new  kind-of thing", "Gloves"])), (F.col("event_id") % 5 + 1).cast("int"))
    key = F.regexp_replace(F.lower(F.regexp_replace(F.trim(raw), "^(?i)action:", "")), r"[\s-]+", "_")
    known = literal_map(LABELS)
    label = F.coalesce(F.when(key.startswith("no_"), known[F.substr(key, F.lit(4))]), known[key], F.initcap(F.translate(key, "_", " ")))
    u = F.col("user_id").cast("string")
    person = F.element_at(F.array(F.concat(F.lit("person_"), u), F.concat(F.lit("TRACK_"), u), F.concat(F.lit("unknown:"), u), F.lit(""), u), (F.col("event_id") % 5 + 1).cast("int"))
    number = F.regexp_extract(person, r"(?i)^(person|track)_(\d+)$", 2)
    shown = F.when((person == "") | F.lower(person).startswith("unknown:"), "未知人员").when(number != "", F.concat(F.when(F.lower(person).startswith("person"), "人员 #").otherwise("轨迹 #"), number)).otherwise(person)
    return safety_events(spark, d).select("event_id", label.alias("label"), shown.alias("person"))


def s32_presets(spark: SparkSession, d: str) -> DataFrame:
    """Events within the clients' presets: from midnight some days before today up to the end of today."""
    end = F.date_trunc("day", now()) + F.expr("INTERVAL 86399 SECONDS")
    presets = {"today": 0, "3days": 3, "7days": 7, "30days": 30}
    counts = safety_events(spark, d).agg(*[F.count_if((F.col("ts") >= F.date_trunc("day", now()) - F.expr(f"INTERVAL {n} DAYS")) & (F.col("ts") <= end)).alias(name) for name, n in presets.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), F.col(f"`{n}`").alias("n")) for n in presets])).alias("x")).select("x.*")


def s33_day_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A day with times that may be left out, as a range up to the last second of its last minute."""
    day, n = F.date_format("shift_date", "yyyy-MM-dd"), F.col("day")
    start, end = F.when(n % 2 == 0, "08:15").otherwise(""), F.when(n % 3 == 0, "17:45").otherwise("")
    at = lambda t, other, s: F.concat(day, F.lit("T"), F.when(t == "", other).otherwise(t), F.lit(s))
    return schedules(spark, d).select("shift_date", at(start, "00:00", ":00").alias("start"), at(end, "23:59", ":59").alias("end"))
