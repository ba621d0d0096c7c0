"""Rank-and-keep operators. Every order ends in an explicit sequence, so ties never depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: finding dedup, alias collapse, upsert of the strongest."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def best_or_null(rows: DataFrame, key: list[str], score: Column, answer: str, seq: Column) -> DataFrame:
    """(key, answer, score) of the best score; the answer is null if rows with different answers tie for it."""
    w = Window.partitionBy(*key).orderBy(score.desc())
    top = rows.withColumn("__score", score).withColumn("__r", F.rank().over(w)).where("__r = 1")
    one = F.min(answer) == F.max(answer)
    return top.groupBy(*key).agg(F.when(one, F.min(answer)).alias(answer), F.max("__score").alias("score"), F.count("*").alias("candidates"))


def versions(rows: DataFrame, site: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with `version` (0, 1, ... in each site) and `object_id`, site@vN."""
    w = Window.partitionBy(*site).orderBy(*order)
    return rows.withColumn("version", F.row_number().over(w).cast("long") - 1).withColumn("object_id", F.concat(F.col(name), F.lit("@v"), F.col("version") + 1))


def top_per_key(rows: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def has_anchor(rows: DataFrame, key: list[str], anchor: Column) -> DataFrame:
    """Rows that are anchors, or whose key has none: fallbacks give way to anchored rows."""
    w = Window.partitionBy(*key)
    return rows.withColumn("__a", F.max(anchor.cast("int")).over(w)).where(anchor | (F.col("__a") == 0)).drop("__a")


def unique_alias(rows: DataFrame, short: str, scoped: str) -> DataFrame:
    """(short, scoped) of the short names that one scoped name alone owns."""
    return rows.groupBy(short).agg(F.min(scoped).alias(scoped), F.max(scoped).alias("__hi")).where(F.col(scoped) == F.col("__hi")).drop("__hi")


def consensus(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value) where the value is null unless all rows of the key agree."""
    return rows.groupBy(*key).agg(F.when((F.min(value) == F.max(value)) & (F.count(value) == F.count("*")), F.min(value)).alias(value))
