"""Report sinks. Each writes a folder of text or Parquet files with Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import report


def save_json(findings: DataFrame, path: str) -> None:
    report.json_lines(findings).write.mode("overwrite").text(path)


def save_markdown(findings: DataFrame, path: str) -> None:
    """Sorted lines; the files' names keep their order."""
    report.markdown(findings).select("value").write.mode("overwrite").text(path)


def save_dot(edges: DataFrame, path: str) -> None:
    report.dot(edges).select("value").coalesce(1).write.mode("overwrite").text(path)


def save_contracts(contracts: DataFrame, path: str, merge: bool = False, key: str = "api_id") -> None:
    """Overwrite, or merge: rows of the same key are replaced, others stay. The merged table is written beside and read back first, so the folder is never
    read and overwritten at once."""
    from .shared import cut

    if merge:
        old = contracts.sparkSession.read.parquet(path).join(contracts.select(key).distinct(), key, "left_anti")
        contracts = cut(old.unionByName(contracts, allowMissingColumns=True))
    contracts.write.mode("overwrite").parquet(path)


def ranked(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file_path", "line", "symbol", F.col("profile_id"))
