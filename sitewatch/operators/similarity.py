"""Nearest subjects of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.operators.cells import best, comparable, through_cells, units
from sitewatch.sources.views import table

#: Bytes of query vectors that go to every task; more of them search the index.
BROADCAST = 64 << 20
#: Subjects of a query that leave a task.
KEPT = 12
#: Least similarity of a known face and its least lead; here the test tables' vectors need lower ones.
FACE, LEAD = 0.45, 0.05
TEST_FACE, TEST_LEAD = 0.2, 0.005


def cosine(a: str, b: str) -> Column:
    """Of two vectors in double precision, 0 where one has no length, never beyond one."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    lengths = F.sqrt(dot(F.col(a), F.col(a)) * dot(F.col(b), F.col(b)))
    return F.when(lengths <= 1e-8, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col(a), F.col(b)) / lengths)))


def nearest(queries: DataFrame, subjects: DataFrame, kept: int = KEPT, most: int | None = None) -> DataFrame:
    """(query, subject, label, score, rank): the ``kept`` best subjects of each query other than itself, by cosine and then id.

    ``queries``: query, q; ``subjects``: subject, s, label; ids are unique in each. Vectors that are null, of another width than the queries'
    widest or hold a null or non-finite component take no part; one without length has the score 0. Queries of at most ``most`` bytes (``BROADCAST``) go
    to all tasks as one matrix, and a task's subjects meet them by matrix products, of which the best of each query leave
    the task. More queries search an index of cells (``operators.cells``), with the same result.
    """
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    if 8 * n * width <= (BROADCAST if most is None else most):
        rows = queries.where(F.col("query").isNotNull() & comparable("q", width)).orderBy("query").collect()  # of a checked size
        ids, matrix = np.array([r["query"] for r in rows], np.int64), units(pa.array([r["q"] for r in rows], pa.list_(pa.float64())))
        shared = subjects.sparkSession.sparkContext.broadcast((ids, matrix))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(shared.value[0]) and b.num_rows:
                    yield from best(*shared.value, b.column(0).to_numpy(), units(b.column(1)), b.column(2), kept)

        label = subjects.schema["label"].dataType.simpleString()
        usable = subjects.where(F.col("subject").isNotNull() & comparable("s", width))
        found = usable.select("subject", "s", "label").mapInArrow(each, f"query bigint, subject bigint, label {label}, score double")
    else:
        found = through_cells(queries, subjects, width, kept)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "subject")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kept)


def _gallery(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries (ids divisible by 100) and all vectors as subjects."""
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("subject"), F.col("embedding").alias("s"), "label")


def recognised(ranked: DataFrame, least: float = FACE, lead: float = LEAD) -> DataFrame:
    """The best subject of each query if it is similar enough and far enough before the second one; a lone subject has no second."""
    best, second = F.max(F.when(F.col("rank") == 1, F.col("score"))), F.max(F.when(F.col("rank") == 2, F.col("score")))
    subject = F.max(F.when(F.col("rank") == 1, F.col("subject")))
    accepted = (best > 0) & (best >= least) & (second.isNull() | (best - second >= lead))
    return ranked.where("rank <= 2").groupBy("query").agg(F.when(accepted, subject).alias("subject"), F.round(best, 4).alias("best"))


def j08_best_subject(spark: SparkSession, d: str) -> DataFrame:
    return recognised(nearest(*_gallery(spark, d)), TEST_FACE, TEST_LEAD)


def _points(score: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score + 1) / 2)) * 100, 1)


def j09_ranked_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Ten best subjects with a score from 0 to 100."""
    return nearest(*_gallery(spark, d)).where("rank <= 10").select("query", "rank", "subject", _points(F.col("score")).alias("points"))


def j09_registry(spark: SparkSession, d: str) -> DataFrame:
    """The comparison with three registries as one: their kind, the cosine to four places, and whether a match is strong."""
    queries, subjects = _gallery(spark, d)
    kinds = ["employee", "external_person", "external_registration"]
    parts = [subjects.where(F.col("subject") % 3 == i).withColumn("label", F.lit(kind)) for i, kind in enumerate(kinds)]
    ranked = nearest(queries, parts[0].unionByName(parts[1]).unionByName(parts[2])).where("rank <= 10")
    return ranked.select("query", "rank", "subject", F.col("label").alias("kind"), F.round("score", 4).alias("cosine"), (F.col("score") >= TEST_FACE).alias("strong"))


def j10_known_samples(spark: SparkSession, d: str, least: float = 0.15) -> DataFrame:
    """Of a query's five best samples the first that is similar enough and not of an excluded person."""
    ranked = nearest(*_gallery(spark, d)).where((F.col("rank") <= 5) & (F.col("score") >= least) & (F.col("label") != 3))
    return ranked.groupBy("query").agg(F.min_by(F.struct("subject", "label"), "rank").alias("s")).select("query", "s.subject", F.col("s.label").alias("person"))


def j08_indexed_subjects(spark: SparkSession, d: str, kept: int = 5) -> DataFrame:
    """Five best subjects of each query through the index of cells, whatever the queries' size."""
    return nearest(*_gallery(spark, d), kept, most=0).select("query", "rank", "subject", F.round("score", 6).alias("cosine"))


def j11_nearest_centroids(spark: SparkSession, d: str) -> DataFrame:
    """The person whose mean vector is nearest to each query; a person is few numbers, a query stays one row."""
    queries, subjects = _gallery(spark, d)
    means = subjects.select("label", F.posexplode("s").alias("place", "x")).groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("s"))
    return nearest(queries, means.select((-F.col("label") - 1).cast("bigint").alias("subject"), "s", "label"), 1).select("query", F.col("label").alias("person"), F.round("score", 4).alias("cosine"))


def st13_gallery_samples(spark: SparkSession, d: str, most: int = 8, ttl: int = 864_000) -> DataFrame:
    """The samples that a gallery holds: of each person the newest eight, none older than ten days."""
    from sitewatch.functions.clock import now, seconds
    from sitewatch.sources.views import safety_events

    e = safety_events(spark, d).where("person_id is not null")
    w = Window.partitionBy("person_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = e.withColumn("r", F.row_number().over(w)).where((F.col("r") <= most) & (seconds(F.col("ts")) >= seconds(now()) - ttl))
    return rows.select("person_id", "event_id", "r")


def j12_merged_identities(spark: SparkSession, d: str) -> DataFrame:
    """The newest frame of each track with the newest name that was found for it; names of tracks without a frame are ignored."""
    from sitewatch.sources.views import case_events

    e = case_events(spark, d)
    order = F.struct("ts", "event_id")
    frames = e.where("k % 3 <> 0").groupBy("user_id").agg(F.max_by("event_id", order).alias("event_id"))
    found = e.where("k % 3 = 0 and person_name is not null").groupBy("user_id").agg(F.max_by("event_id", order).alias("seen_in"), F.max_by("person_name", order).alias("found"))
    return frames.join(found, "user_id", "left").select("user_id", "event_id", F.coalesce("found", F.concat(F.lit("track "), F.col("user_id").cast("string"))).alias("name"), "seen_in")


def j13_answered_requests(spark: SparkSession, d: str, wait: int = 43_200) -> DataFrame:
    """Requests with the first answer of the same key after them, if it comes in time."""
    from sitewatch.functions.clock import seconds
    from sitewatch.sources.views import safety_events

    e = safety_events(spark, d).select("event_id", "user_id", "ts", seconds(F.col("ts")).alias("at"), (F.col("k") % 2 == 0).alias("asks"))
    later = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    answer = F.last(F.when(~F.col("asks"), F.struct("event_id", "at")), ignorenulls=True).over(later)  # grows row by row; a frame that shrinks would be read anew
    rows = e.withColumn("answer", answer).where("asks")
    return rows.select("event_id", F.when(F.col("answer.at") - F.col("at") <= wait, F.col("answer.event_id")).alias("answer"))


def st21_expired_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests that nobody answered in time, by camera."""
    from sitewatch.sources.views import safety_events

    rows = j13_answered_requests(spark, d).where("answer is null").select("event_id")
    return rows.join(safety_events(spark, d).select("event_id", "camera_id"), "event_id").groupBy("camera_id").agg(F.count("*").alias("expired"))


def a35_label_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of each label, as (label, place, mean)."""
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return rows.groupBy("label", "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
