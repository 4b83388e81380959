"""From documents to token ids: the stages of corpus preparation, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from inkwell.llm.catalog import byte_bpe_path, table
from inkwell.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from labelled ones among them, does not find toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, to="__score").where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; a document that is left without words goes."""
    clean = line_dedup.dedup_lines(docs)
    lost_all = (F.col("dropped_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("dropped_lines") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return clean.where(~lost_all).withColumn("n_chars", n_chars).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-copies.

    Rows that repeat an id and a text are one document; rows of an id with different texts are told apart by a
    hash of the text. Documents without an id or words stay.
    """
    later = jaccard.later_copies(docs).select(F.col("doc_id").alias("__k"), F.col("content").alias("__c"))
    same = (docs["doc_id"] == F.col("__k")) & (jaccard.content_of(docs["text"]) == F.col("__c"))
    return docs.join(later, same, "left_anti").dropDuplicates(["doc_id", "text"])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives the text back."""
    both = bpe.round_trip(docs, byte_bpe_path())
    return both.select(
        *[c for c in docs.columns if c != "text"],
        F.col("tokens.ids").alias("ids"),
        F.size("tokens.ids").cast("bigint").alias("n_tokens"),
        (F.col("tokens.decoded") == F.coalesce("text", F.lit(""))).alias("decodes"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("bpe", as_tokens),
]

# A trained score and a tokenizer cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
