"""The registered queries of this subpackage; none of them can be said in SQL but where ORACLE_SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compact_windows, conversation_repair, cover_tree, crf_quality, ftrl, hard_negatives, ngram_lm, oracles, packing, sharding, simhash, suffix_dedup, syncmers, trie_bpe
from .common import table


def vocabulary() -> str:
    """The public byte-level BPE file; its place belongs to the machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"), 40)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), 4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.language_model_scores(table(spark, sf_dir, "documents"))


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_passages(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary(), 2048)


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op9_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), 100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repairs(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_shards, op2_simhash, op3_line_labels, op4_language_model, op5_trie_bpe, op6_compact_windows, op7_packing, op8_cover_tree, op9_ftrl, op10_suffix_array, op11_conversation_repair, op12_syncmers, op13_hard_negatives)
}

#: In DuckDB's SQL, of the queries that it can express.
ORACLE_SQL: dict[str, str] = {"op8_cover_tree": oracles.OP8, "op11_conversation_repair": oracles.OP11, "op13_hard_negatives": oracles.OP13}
