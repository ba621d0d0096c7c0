"""Wrapper report and graph helpers."""

import os

from ferrule.operators import graph
from ferrule.plans import extract, wrappers
from ferrule.sources import files
from ferrule.sources.shared import cut

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_report(spark):
    f = extract.facts(cut(extract.extract(files.scan(spark, HERE, langs=["python"]))))
    targets = spark.createDataFrame([("generate",)], "node string")
    got = wrappers.report(f["functions"], f["calls"], targets)
    assert "main>make_key_bytes>make_key>generate" in [r.path for r in got["chains"].collect()] or rows(got["chains"], "path")[0] == ("main>generate",)
    assert rows(got["constants"], "line", "value") == []
    assert rows(got["ignored"], "name", "param") == []


def test_levels_and_contexts(spark):
    e = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "a"), ("d", "b")], "src string, dst string")
    seeds = spark.createDataFrame([("t",)], "node string")
    assert rows(graph.caller_levels(e, seeds, 1, 2), "node", "level") == [("a", 1), ("c", 2)]
    dep = spark.createDataFrame([("t", "x"), ("r", "p")], "node string, on string")
    calls = spark.createDataFrame([("x", "r", "s1"), ("p", "r", "s1")], "node string, on string, site string")
    got = rows(graph.context_slice(dep, calls, seeds), "node", "context")
    assert got == [("p", ["s1"]), ("r", ["s1"]), ("t", []), ("x", [])]


def test_stats(spark):
    n = spark.createDataFrame([("a", "ENTRY"), ("b", "PRUNED"), ("c", "PRUNED")], "node string, status string")
    s = graph.propagation_stats(n).first()
    assert (s.nodes, s.pruned, s.entry, s.suspect) == (3, 2, 1, 0)
