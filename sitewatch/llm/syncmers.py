"""Document fingerprints of closed syncmers over words, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

WORDS, INNER, KEPT = 3, 1, 64
#: A word; longer runs without white space are cut, so that text without spaces has anchors too.
WORD = r"[^\x20\x09-\x0D]{1,16}"


def with_anchors(docs: DataFrame, text: str, name: str, words: int = WORDS, inner: int = INNER) -> DataFrame:
    """Add ``name``: the text's closed syncmers as an array of (place, hash), ``place`` being the number of the first word.

    A run of ``words`` words is one if, of the hashes of its inner runs of ``inner`` words, the first or the last is a smallest one.
    That depends on the run alone: whatever surrounds it, a passage has the same anchors at the same distances. A text of fewer words
    has itself as its only anchor, a null or empty one has none.
    """
    h, n = f"_{name}_h", words - inner
    count = F.size(f"_{name}_w")
    docs = docs.withColumn(f"_{name}_w", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)))
    run = lambda i: F.xxhash64(*[F.col(f"_{name}_w")[i + k] for k in range(inner)])
    places = lambda runs: F.sequence(F.lit(0), F.greatest(runs - 1, F.lit(0)))
    docs = docs.withColumn(h, F.when(count >= words, F.transform(places(count - (inner - 1)), run)))
    least = lambda i: F.least(*[F.col(h)[i + k] for k in range(n + 1)])
    closed = lambda i: (F.col(h)[i] == least(i)) | (F.col(h)[i + n] == least(i))
    covering = sorted({*range(0, n + 1, inner), n})  # inner runs that hold all words
    anchor = lambda i: F.struct(i.alias("place"), F.xxhash64(*[F.col(h)[i + k] for k in covering]).alias("hash"))
    many = F.transform(F.filter(places(F.size(h) - n), closed), anchor)
    one = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(text).alias("hash")))
    none = F.filter(one, lambda x: F.lit(False))
    whole = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, none).otherwise(one)
    return docs.withColumn(name, F.when(count >= words, many).otherwise(whole)).drop(f"_{name}_w", h)


def sketch(anchors: Column | str, kept: int = KEPT) -> Column:
    """The ``kept`` smallest distinct hashes of the anchors, by their lower 32 bits; all, if fewer."""
    lower = F.transform(anchors, lambda x: x["hash"].bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.slice(F.sort_array(F.array_distinct(lower)), 1, kept)


def spelled(prints: Column | str) -> Column:
    """A sketch as a string, eight hex digits a hash."""
    return F.lower(F.array_join(F.transform(prints, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: str, b: str, kept: int = KEPT) -> Column:
    """Estimated share of common anchors: of the ``kept`` smallest hashes of both sketches, how many are in each. Two empty ones are alike."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, kept)
    shared = F.size(F.array_intersect(F.array_intersect(both, F.col(a)), F.col(b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, other_id, shift, anchors): where documents of ``b`` stand in those of ``a``, by common anchors at a constant distance.

    Of each pair the shift (words from the place in ``b`` to that in ``a``) that most common anchors have, the smallest of equal ones.
    An anchor is matched only if it stands once in each of the two documents. For sets of documents whose common anchors are few.
    """
    def places(docs: DataFrame, id_: str, place: str) -> DataFrame:
        rows = with_anchors(docs.select("doc_id", "text"), "text", "anchors").select(F.col("doc_id").alias(id_), F.inline("anchors"))
        return rows.groupBy(id_, "hash").agg(F.min("place").alias(place), F.count("*").alias("n")).where("n = 1").drop("n")

    pairs = places(a, "doc_id", "here").join(places(b, "other_id", "there"), "hash")
    runs = pairs.groupBy("doc_id", "other_id", (F.col("here") - F.col("there")).alias("shift")).agg(F.count("*").alias("anchors"))
    best = runs.groupBy("doc_id", "other_id").agg(F.max(F.struct("anchors", -F.col("shift"))).alias("best"))
    return best.select("doc_id", "other_id", (-F.col("best.col2")).alias("shift"), F.col("best.anchors").alias("anchors"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("g", F.xxhash64("text"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.g") == F.col(f"{b}.g"))


def successors(keys: DataFrame) -> DataFrame:
    """(doc_id, g, n_chars, next_id, next_g) of distinct (doc_id, g, n_chars): each one's next by doc_id descending, the last one's the first.

    A range sort deals the keys; places are numbers of partitions plus places therein, so that no task sees more than its own share.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("g")]
    placed = checkpointed(keys.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))  # a row for each partition
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    ranked = placed.withColumn("part", part).join(F.broadcast(sizes), "part")
    ranked = ranked.select("doc_id", "g", "n_chars", (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")).alias("i"), "total")
    ahead = ranked.select(F.col("doc_id").alias("next_id"), F.col("g").alias("next_g"), F.pmod(F.col("i") - 1 + F.col("total"), "total").alias("i"))
    return ranked.drop("total").join(ahead, "i").drop("i")


def fingerprints(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they and the next document's are.

    Edited: the last third of the characters replaced by as many first ones of the next document, by doc_id descending. A fingerprint
    spells the ``kept`` smallest hashes of the text's closed syncmers; likeness estimates the share of common ones.

    Null texts are empty and have an empty fingerprint; two empty ones are alike (1), an empty and another one aren't (0). A null
    doc_id comes after all others, of one doc_id the text with the smaller hash comes first, and rows of one doc_id and text are one
    document with a result for each row. A text of fewer than three words has itself as its one anchor. Long texts are read whole, in the
    memory of one row. Other columns aren't read; an empty table gives no rows, and a single document is its own next.
    """
    rows = _keyed(docs)
    keys = rows.groupBy("doc_id", "g", F.length("text").cast("long").alias("n_chars")).agg(F.count("*").alias("copies"))
    keys = checkpointed(keys)
    repeated = bool(keys.where("copies > 1").limit(1).count())
    links = checkpointed(successors(keys.drop("copies")))
    third = F.floor(F.col("n_chars") / 3)
    wanted = links.select(F.col("next_id").alias("doc_id"), F.col("next_g").alias("g"), F.col("doc_id").alias("to_id"), F.col("g").alias("to_g"), third.cast("int").alias("take"))
    once = rows.dropDuplicates(["doc_id", "g"]) if repeated else rows
    # what the next document gives: its first characters and its sketch
    gives = once.alias("a").join(wanted.alias("b"), _same("a", "b")).select(F.col("to_id").alias("doc_id"), F.col("to_g").alias("g"), "take", "text")
    gives = with_anchors(gives, "text", "anchors").select("doc_id", "g", "take", F.substring("text", F.lit(1), F.col("take")).alias("gift"), sketch("anchors", kept).alias("next_print"))
    own = once.alias("a").join(gives.alias("b"), _same("a", "b")).select("a.doc_id", "a.g", "text", "take", "gift", "next_print")
    own = own.withColumn("n_chars", F.length("text").cast("long"))
    own = own.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("take")), "gift")).drop("gift", "take")
    own = with_anchors(own, "text", "anchors").withColumn("print", sketch("anchors", kept)).drop("anchors", "text")
    own = with_anchors(own, "edited", "anchors").withColumn("edited_print", sketch("anchors", kept)).drop("anchors")
    done = own.select(
        "doc_id", "g", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelled("print").alias("fingerprint"), spelled("edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print", kept).alias("near_edited"), likeness("print", "next_print", kept).alias("near_next"),
    )
    if repeated:
        done = rows.select("doc_id", "g").alias("a").join(done.alias("b"), _same("a", "b")).select("b.*")
    return done.drop("g")
