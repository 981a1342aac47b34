"""Readers for the tables the queries run over, and for lists that come as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most phrases of a list; they become part of the plan.
MOST_PHRASES = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` to as many tasks as the session's shuffles have at most.

    The aggregate that follows sorts or hashes nothing before the shuffle, and a task's share isn't merged with others: Spark
    joins parts up to 64 MB, which are gigabytes where they are sorted. For keys that repeat little.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def phrases(spark: SparkSession, path: str) -> list[str]:
    """A JSON list of phrases, in order, such as trends; an error beyond MOST_PHRASES."""
    listed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("phrase"))
    found = [r.phrase for r in listed.limit(MOST_PHRASES + 1).collect()]
    if len(found) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    return found
