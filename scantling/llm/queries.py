"""Queries of the corpus operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantling.llm import crosssplit, dedup, groups, leakage, mojibake, packing, pii, quality, quotes, topn
from scantling.session import table

SPLIT_TARGETS = {"train": 0.70, "validation": 0.15, "test": 0.15}


def _formatted(spark: SparkSession, d: str) -> DataFrame:
    return dedup.tagged(
        {
            "enron": table(spark, d, "enron").select(F.col("sample_id").alias("id"), dedup.mail_key(F.col("text")).alias("key")),
            "sms": table(spark, d, "sms").select(F.col("sample_id").alias("id"), dedup.items_key(F.col("text")).alias("key")),
            "mask": table(spark, d, "mask").select(F.col("sample_id").alias("id"), dedup.items_key(F.col("proposition")).alias("key")),
        }
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    _, members = dedup.equal_runs(_formatted(spark, d))
    return dedup.untagged(["enron", "sms", "mask"], members, "rep", "member").selectExpr("dataset", "rep as sample_id_a", "member as sample_id_b")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record with its number of copies."""
    records, _ = dedup.equal_runs(_formatted(spark, d))
    return dedup.untagged(["enron", "sms", "mask"], records, "rep").selectExpr("dataset", "rep as sample_id", "copies")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    mails, messages = (table(spark, d, t).select(F.lit(t).alias("dataset"), "sample_id", "text") for t in ("enron", "sms"))
    return mails.unionByName(messages)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.details(_messages(spark, d), table(spark, d, "person_names"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every mail and message with typed placeholders for its personal details."""
    return pii.redacted(_messages(spark, d), table(spark, d, "person_names"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["dataset", "model", "balance_mode", "k"]
    runs = topn.top_n(table(spark, d, "runs").select(*keys, "test_recall_at_1pct_fpr", "run_id"), keys, "test_recall_at_1pct_fpr", "run_id", 3)
    entries = table(spark, d, "activations").select("vec_id", F.posexplode("x").alias("i", "v")).withColumn("v", F.abs("v"))
    vectors = topn.top_n(entries, ["vec_id"], "v", "i", 3)
    return runs.select(F.lit("runs").alias("source"), F.concat_ws("|", *keys).alias("group_key"), "pos", F.col("run_id").alias("item")).unionByName(
        vectors.select(F.lit("activations").alias("source"), F.col("vec_id").cast("string").alias("group_key"), "pos", F.col("i").cast("string").alias("item"))
    )


def _mask_related(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mask").select(
        F.col("sample_id").alias("id"),
        F.concat("category", F.lit("\u0001"), "question_id").alias("question"),
        dedup.items_key(F.col("proposition")).alias("claim"),
    )
    return groups.related(rows, ["question", "claim"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _mask_related(spark, d).where("member <> root").selectExpr("root as sample_id_a", "member as sample_id_b")


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """A split for every row of mask, near 70/15/15, related rows together."""
    return groups.balanced_splits(_mask_related(spark, d), SPLIT_TARGETS).selectExpr("member as sample_id", "root as component", "bin", "split")


def _mails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enron").select(F.col("sample_id").alias("id"), "text", "source")


def _mail_splits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "splits").where("dataset = 'enron'")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = crosssplit.overlapping_rows(_mails(spark, d).select("id", "text"), _mail_splits(spark, d))
    return rows.selectExpr("model", "a as sample_id_a", "b as sample_id_b")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps counted by model, split and source."""
    return crosssplit.overlap_report(_mails(spark, d), _mail_splits(spark, d))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Items that stand in a document, twelve words exactly or the item nearly, with how many passages and how nearly."""
    return leakage.leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "heldout_items").select("item_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).where("exact").select("doc_id", "item_id")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """How many passages of twelve words of each item stand in a document."""
    return p9_leaks(spark, d).where("exact").select("doc_id", "item_id", "windows")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quotes.old_lines(table(spark, d, "enron").select("sample_id", "sent_at", "text"))


def p4_new_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each mail with only its sender's new text."""
    return quotes.new_texts(table(spark, d, "enron").select("sample_id", "sent_at", "text"))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    mails = table(spark, d, "enron").select(F.lit("enron").alias("dataset"), "sample_id", "source", "text")
    return mojibake.garbled(mails.unionByName(table(spark, d, "sms").select(F.lit("sms").alias("dataset"), "sample_id", F.lit("").alias("source"), "text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("dataset", "sample_id")


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected records with their restored texts."""
    return _garbled(spark, d)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of 2,048 tokens of each document, or of each piece of a longer one."""
    return packing.containers(packing.token_counts(table(spark, d, "documents").select("doc_id", "text")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents")).where("sort <> 'prose'").selectExpr("doc_id", "sort as kind")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and sort of every document."""
    return quality.text_statistics(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The counts and shares among the statistics of every document."""
    shares = ("mean_word_length", "symbol_share", "line_end_share", "common_share")
    return quality.text_statistics(table(spark, d, "documents")).select("doc_id", "words", *(F.round(c, 6).alias(c) for c in shares))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_redacted, p3_found, p4_found, p4_new_texts, p5_found, p5_report, p6_found, p6_splits, p7_found, p7_restored, p8_containers, p9_found, p9_leaks, p9_passages, p10_found, p10_statistics, p10_shares)}
