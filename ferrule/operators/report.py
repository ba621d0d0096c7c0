"""Rollups of findings and the reports' text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import LEVELS, unknown_reason


def by_severity(findings: DataFrame, keys: list[str], level: str = "severity") -> DataFrame:
    """One row per key with a count for each level: one shuffle, partial sums before it."""
    return findings.groupBy(*keys).agg(F.count("*").alias("findings"), *[F.count_if(F.col(level) == x).alias(x) for x in LEVELS])


def rollup(findings: DataFrame, folder: str, file: str, level: str = "severity") -> DataFrame:
    """Counts per (folder, file, severity), per (folder, file), per folder and in all."""
    return findings.rollup(folder, file, level).agg(F.count("*").alias("n"))


def unknown_reasons(findings: DataFrame, profile: str) -> DataFrame:
    """Histogram of why findings have no concrete profile."""
    return findings.withColumn("reason", unknown_reason(F.col(profile))).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def locations(findings: DataFrame, key: str, place: str) -> DataFrame:
    """(key, n, places): places in order, each once."""
    return findings.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(place)), ", ").alias("places"))


def folder_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files by status, files with findings, findings by level."""
    a = files.agg(F.count("*").alias("files"), *[F.count_if(F.col("status") == s).alias(f"files_{s}") for s in ("ok", "skipped", "error")])
    b = findings.agg(F.count_distinct("file_path").alias("files_with_findings"), F.count("*").alias("findings"), *[F.count_if(F.col("severity") == x).alias(x) for x in LEVELS])
    return a.crossJoin(b)


def json_lines(findings: DataFrame) -> DataFrame:
    """One JSON text per finding, without null fields and empty wrapper chains."""
    rows = findings.withColumn("wrapper_chain", F.when(F.size("wrapper_chain") > 0, F.col("wrapper_chain"))) if "wrapper_chain" in findings.columns else findings
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value"))


def markdown(findings: DataFrame) -> DataFrame:
    """Lines of a Markdown report: a heading per severity, worst first, and a bullet per finding, in a sorted table of (section, seq, value)."""
    section = F.lit(len(LEVELS)) - F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("severity"))
    heads = findings.select("severity", section.alias("section")).distinct().select("section", F.lit("").alias("seq"), F.concat(F.lit("## "), F.initcap("severity")).alias("value"))
    bullet = F.format_string("- `%s:%d` %s (%s): %s", "file_path", "line", "symbol", F.coalesce("profile_id", F.lit("unknown")), F.coalesce("reason", F.lit("")))
    rows = findings.select(section.alias("section"), F.format_string("%s:%09d:%s", "file_path", "line", "symbol").alias("seq"), bullet.alias("value"))
    return heads.unionByName(rows).orderBy("section", "seq", "value")


def dot(edges: DataFrame) -> DataFrame:
    """Lines of a Graphviz file, edges in order."""
    body = edges.select("src", "dst").distinct().select(F.lit(1).alias("part"), F.format_string('  "%s" -> "%s";', "src", "dst").alias("value"))
    spark = edges.sparkSession
    ends = spark.createDataFrame([(0, "digraph calls {"), (2, "}")], "part int, value string")
    return body.unionByName(ends).orderBy("part", "value")


def migration(findings: DataFrame) -> DataFrame:
    """(profile_id, n, migrate_to, places) of what must be replaced."""
    rows = findings.withColumn("place", F.format_string("%s:%d", "file_path", "line"))
    return rows.groupBy("profile_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("migrate_to")))), ", ").alias("migrate_to"), F.array_join(F.array_sort(F.collect_set("place")), ", ").alias("places"))
