"""The corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

1. quality rules: documents that fail the rules go;
2. line dedup: later occurrences of repeated three-line windows go, and texts of which nothing is left;
3. n-gram Jaccard join: of each group of near copies (five-word shingles, similarity 0.8) one stays;
4. mixing: each document as often as its source's target asks;
5. encoding: token ids and what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from lumenfold.llm.common import Workspace
from lumenfold.llm.queries import word_vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the rules, unchanged."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text. A text that lost all its lines goes."""
    others = F.struct(*(c for c in docs.columns if c != "text"))
    found = line_dedup.dedup_lines(docs.select(others.alias("others"), "doc_id", "text"))
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("others.n_chars"))
    made = {"text": F.col("text"), "n_chars": chars}
    return found.where(~emptied).select(*(made.get(c, F.col("others")[c]).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, unchanged."""
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeat as often as they are taken."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every row of the mix."""
    found = bpe.encode(docs, word_vocabulary(), keep=["doc_id", "source"])
    return found.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_copies), ("mixing", mixture), ("bpe", encoding)]

#: Encoding has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again by the next, which then deletes it."""
    work = Workspace(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
        if last:
            work.drop(last)
        last = name
    return docs
