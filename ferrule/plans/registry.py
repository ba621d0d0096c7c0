"""The extension surface: analyzers over the fact tables, readers of further languages, the matchers by name, switches and validators."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match, resolve

Progress = Callable[[int, int, str], None]
#: Rule matchers: (calls, rules) -> calls with the rules that meet them.
MATCHERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "precise": resolve.precise_match,
    "legacy": resolve.legacy_match,
    "suffix": lambda calls, rules: match.suffix_join(calls, rules, "symbol", "rule_symbol"),
}
#: Parts of a scan that a caller or the session's setting ferrule.skip (names between commas) leaves out.
SWITCHES = ("wrappers", "noise", "imports")


class Analyzer(Protocol):
    """What `analyze` returns has the columns of FINDING; missing ones are null."""

    name: str

    def analyze(self, facts: dict[str, DataFrame]) -> DataFrame: ...


FINDING = "file_path string, line int, symbol string, profile_id string, severity string, reason string"


def run(analyzers: Iterable[Analyzer], facts: dict[str, DataFrame], progress: Progress | None = None) -> DataFrame:
    """All analyzers' findings, with `analyzer`. progress(done, of, name) is called as each one's plan is made."""
    analyzers = list(analyzers)
    spark = next(iter(facts.values())).sparkSession
    out = spark.createDataFrame([], FINDING + ", analyzer string")
    for i, a in enumerate(analyzers):
        out = out.unionByName(a.analyze(facts).withColumn("analyzer", F.lit(a.name)), allowMissingColumns=True)
        if progress:
            progress(i + 1, len(analyzers), a.name)
    return out


def valid(findings: DataFrame, validators: Iterable[Callable[[DataFrame], Column]]) -> DataFrame:
    """Findings for which every validator holds (null doesn't)."""
    for v in validators:
        findings = findings.where(F.coalesce(v(findings), F.lit(False)))
    return findings


def skipped(spark: SparkSession, asked: Iterable[str] = ()) -> set[str]:
    names = set(asked) | {x.strip() for x in (spark.conf.get("ferrule.skip", "") or "").split(",") if x.strip()}
    if unknown := names - set(SWITCHES):
        raise ValueError(f"unknown switches: {sorted(unknown)}")
    return names
