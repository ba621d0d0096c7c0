"""Report on wrappers of insecure targets: call chains from roots, constants that reach them, and parameters that are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import graph, interval


def call_graph(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(file_path, src, dst): the innermost function that holds each call's line, else <global>, to the callee's tail."""
    held = interval.owner(calls.select("file_path", "call_id", F.col("line").alias("at"), "symbol"), functions.select("file_path", F.col("name").alias("func"), "line", "end_line", "seq"), ["file_path"], ["call_id"], "at", "line", "end_line", 64, "innermost", "seq")
    owned = calls.join(held.select("call_id", "func"), "call_id", "left")
    return owned.select("file_path", names.function_tail(F.coalesce("func", F.lit("<global>"))).alias("src"), names.function_tail(F.col("symbol")).alias("dst")).distinct()


def report(functions: DataFrame, calls: DataFrame, targets: DataFrame, per_target: int = 2, total: int = 10, depth: int = 8) -> dict[str, DataFrame]:
    """chains: up to per_target shortest chains from roots to each target (node), `total` in all; constants: literal arguments of calls to
    targets; ignored: parameters that a function on a chain never mentions in its return expression or passes on."""
    edges = call_graph(functions, calls).select("src", "dst").distinct()
    roots = graph.roots(edges)
    paths = graph.shortest_paths(edges, roots, targets, per_target, depth)
    chains = paths.orderBy("length", "path").limit(total)  # a report's fixed limit
    tail = names.function_tail(F.col("symbol"))
    to_target = calls.withColumn("node", tail).join(targets, "node", "left_semi")
    constants = to_target.select("file_path", "line", "symbol", F.posexplode("args").alias("index", "value")).where(F.col("value").rlike(r"^\s*(?:\d+|b?['\"].*['\"])\s*$"))
    passed = calls.select("file_path", F.col("owner_function").alias("name"), F.explode_outer(F.transform("args", lambda a: names.identifiers(a))).alias("ids")).groupBy("file_path", "name").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("used"))
    own = functions.join(passed, ["file_path", "name"], "left")
    used = F.array_union(F.coalesce("used", F.array().cast("array<string>")), F.coalesce(names.identifiers(F.col("return_expression")), F.array().cast("array<string>")))
    ignored = own.select("file_path", "name", F.explode(F.array_except("params", used)).alias("param")).where("param <> 'self'")
    return {"chains": chains, "constants": constants, "ignored": ignored}
