"""Graph operators over edge tables: closure, paths, components, contract propagation, wrapper fixpoints.

Loops are level-synchronous and semi-naive: a round joins the frontier alone, and what it finds is anti-joined with what is
known. Every round's result is cut to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def roots(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes that no edge leads to."""
    return edges.select(F.col(src).alias("node")).distinct().join(edges.select(F.col(dst).alias("node")).distinct(), "node", "left_anti")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int, include_seeds: bool = False) -> DataFrame:
    """(node, depth) of the nodes within max_depth steps of any seed, each at its least depth. Seeds are at 0 and left out unless asked for."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long")))
    front = seen
    for depth in range(1, max_depth + 1):
        nxt = front.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut(nxt.withColumn("depth", F.lit(depth).cast("long")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen if include_seeds else seen.where("depth > 0")


def between(edges: DataFrame, sources: DataFrame, targets: DataFrame, forward_depth: int = 8, backward_depth: int = 12) -> DataFrame:
    """Nodes that sources reach and that reach targets: the part of the graph that paths may use."""
    ahead = closure(edges, sources, forward_depth, include_seeds=True).select("node")
    behind = closure(reverse(edges), targets, backward_depth, include_seeds=True).select("node")
    return ahead.join(behind, "node", "left_semi")


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, k: int, max_depth: int) -> DataFrame:
    """(target, path, length, rank): the k shortest simple paths to each target over all sources, ties by the path itself. Edges are first cut
    down to what lies between, so only paths that can arrive are grown; a step keeps the k best of each (source, node)."""
    keep = cut(between(edges, sources, targets, max_depth, max_depth))
    live = edges.select("src", "dst").distinct().join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")
    live = cut(live)
    front = sources.join(keep, "node", "left_semi").select(F.col("node").alias("at"), F.array("node").alias("path"))
    found = None
    for _ in range(max_depth):
        step = front.join(live, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        w = Window.partitionBy(F.get("path", F.lit(0)), "at").orderBy(F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))
        front = cut(step.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r"))
        here = front.join(targets.withColumnRenamed("node", "at"), "at", "left_semi")
        found = here if found is None else found.unionByName(here)
        if front.isEmpty():
            break
    text = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    w = Window.partitionBy("at").orderBy(F.size("path"), text)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("at").alias("target"), text.alias("path"), (F.size("path") - 1).alias("length"), "rank")


def prefixes(edges: DataFrame, vias: DataFrame, k: int, max_depth: int) -> DataFrame:
    """(via, path): up to k paths from roots to each via, shortest first, then by text. From one root every node is visited once, by its first path.
    A root that isn't among the k first of a node isn't among those of the nodes after it, so that k roots a node are all that is kept, and a node that has them is left."""
    edges = cut(edges.select("src", "dst").distinct())
    text = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    front = cut(roots(edges).select(F.col("node").alias("root"), F.col("node").alias("at"), F.array("node").alias("path")))
    seen = front
    for depth in range(1, max_depth + 1):
        full = seen.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        live = edges.join(full.select(F.col("at").alias("dst")), "dst", "left_anti") if depth > 1 else edges
        step = front.join(live, F.col("at") == F.col("src")).select("root", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        first = step.groupBy("root", "at").agg(F.min_by("path", text).alias("path"))
        new = first.join(seen.select("root", "at"), ["root", "at"], "left_anti")
        w = Window.partitionBy("at").orderBy(text)
        front = cut(new.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    w = Window.partitionBy("at").orderBy(F.size("path"), text)
    own = seen.join(vias.select(F.col("node").alias("at")).distinct(), "at", "left_semi")
    return own.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).select(F.col("at").alias("via"), "path")


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int) -> DataFrame:
    """(source, target, path): every path without a repeated node, of max_depth edges at most, also on from a target. A path only grows to nodes from which a target is
    still within reach, so that what is grown arrives but for repeated nodes; the number of paths is the result's own."""
    edges = cut(edges.select("src", "dst").distinct())
    far = closure(reverse(edges), targets, max_depth, include_seeds=True).select(F.col("node").alias("dst"), F.col("depth").alias("left"))
    live, found = cut(edges.join(far, "dst")), None
    front = sources.select(F.col("node").alias("at"), F.array("node").alias("path"))
    for depth in range(1, max_depth + 1):
        step = front.join(live.where(F.col("left") <= max_depth - depth), F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        front = cut(step.select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")))
        here = front.join(targets.select(F.col("node").alias("at")).distinct(), "at", "left_semi")
        found = here if found is None else found.unionByName(here)
        if front.isEmpty():
            break
    return found.select(F.get("path", F.lit(0)).alias("source"), F.col("at").alias("target"), "path")


def join_prefixes(prefixes: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(via, path): every prefix (root..via) with every suffix (via..target), via once."""
    return prefixes.select("via", F.col("path").alias("__p")).join(suffixes.select("via", F.col("path").alias("__s")), "via").select("via", F.concat("__p", F.slice("__s", 2, F.greatest(F.size("__s") - 1, F.lit(0)))).alias("path"))


def path_trie(paths: DataFrame) -> DataFrame:
    """(prefix, node, n_paths, children): every prefix of the paths with its count and number of different next nodes."""
    parts = paths.select("path", F.posexplode("path").alias("i", "node")).select(F.array_join(F.slice("path", 1, F.col("i") + 1), ">").alias("prefix"), "node", F.get("path", F.col("i") + 1).alias("next"))
    return parts.groupBy("prefix", "node").agg(F.count("*").alias("n_paths"), F.count_distinct("next").alias("children"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that undirected edges connect, by min-label rounds with pointer jumping."""
    both = edges.select("src", "dst").unionByName(reverse(edges)).where("src <> dst").distinct()
    both = cut(both)
    label = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("__n"))
        step = label.join(near, "node").select("node", F.least("component", "__n").alias("component"), F.col("component").alias("__old"))
        jump = step.join(step.select(F.col("node").alias("component"), F.col("component").alias("__up")), "component", "left")
        new = cut(jump.select("node", F.least("component", F.coalesce("__up", "component")).alias("component"), "__old"))
        label = new.select("node", "component")
        if new.where("component <> __old").isEmpty():
            return label


def entry_points(edges: DataFrame, targets: DataFrame, max_depth: int) -> DataFrame:
    """Roots among the nodes that reach targets."""
    up = closure(reverse(edges), targets, max_depth, include_seeds=True)
    return up.join(roots(edges), "node", "left_semi").select("node", "depth")


def propagate_contract(callsites: DataFrame, sinks: DataFrame, verdict: Column, max_depth: int = 10) -> DataFrame:
    """(node, caller_of, depth, status) of a contract going up from its sinks along call sites (src calls dst, with the columns that
    `verdict` reads). verdict: true SAT (the site is PRUNED and nothing goes on), false UNSAT (PROPAGATED), null UNKNOWN (SUSPECT). Nodes without a call site
    above are ENTRY. A node is visited once, by its least depth, worst verdict first."""
    callsites = cut(callsites)
    seen = cut(sinks.select("node").distinct().select("node", F.lit(0).cast("long").alias("depth"), F.lit("SENSITIVE").alias("status")))
    front = seen
    for depth in range(1, max_depth + 1):
        met = callsites.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), F.when(verdict, "PRUNED").when(~verdict, "PROPAGATED").otherwise("SUSPECT").alias("status"))
        order = F.when(F.col("status") == "PROPAGATED", 0).when(F.col("status") == "SUSPECT", 1).otherwise(2)
        w = Window.partitionBy("node").orderBy(order)
        new = met.withColumn("__r", F.row_number().over(w)).where("__r = 1").join(seen, "node", "left_anti").select("node", F.lit(depth).cast("long").alias("depth"), "status")
        new = cut(new)
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        front = new.where("status <> 'PRUNED'")
    called = callsites.select(F.col("dst").alias("node")).distinct().withColumn("__called", F.lit(True))
    out = seen.join(called, "node", "left")
    return out.select("node", "depth", F.when(F.col("__called").isNull() & F.col("status").isin("PROPAGATED", "SUSPECT"), "ENTRY").otherwise(F.col("status")).alias("status"))


def wrapper_fixpoint(calls: DataFrame, known: DataFrame, max_rounds: int = 8) -> DataFrame:
    """(name, profile, chain, level): a caller of a known name becomes known, with the profile of the best call (profile priority: see the
    `priority` of known; then the smallest callee). calls: (caller, callee); known: (name, profile, priority)."""
    seen = cut(known.select("name", "profile", "priority", F.array("name").alias("chain"), F.lit(0).cast("long").alias("level")))
    front = seen
    for level in range(1, max_rounds + 1):
        met = calls.join(front.withColumnRenamed("name", "callee"), "callee").join(seen.select(F.col("name").alias("caller")), "caller", "left_anti")
        w = Window.partitionBy("caller").orderBy(F.col("priority").desc(), "callee", "profile")
        new = met.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(F.col("caller").alias("name"), "profile", "priority", F.concat(F.array("caller"), "chain").alias("chain"), F.lit(level).cast("long").alias("level"))
        front = cut(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.drop("priority")


def inherit_along_chain(rows: DataFrame, key: str, chain: str, values: DataFrame, name: str, value: str) -> DataFrame:
    """rows with `inherited`: the value of the first chain item that has one."""
    items = rows.select(key, F.posexplode(chain).alias("__pos", name)).join(values.select(name, value), name)
    got = items.groupBy(key).agg(F.min_by(value, "__pos").alias("inherited"))
    return rows.join(got, key, "left")


def expand_alias(defs: DataFrame, max_hops: int = 8) -> DataFrame:
    """(scope, name, value, hops): each variable's value after following alias definitions in its scope; a cycle or the bound stops at the name
    reached."""
    cur = cut(defs.select("scope", "name", "value", F.lit(0).cast("long").alias("hops"), F.array("name").alias("__seen")))
    nxt = defs.select("scope", F.col("name").alias("value"), F.col("value").alias("__next"))
    for _ in range(max_hops):
        step = cur.join(nxt, ["scope", "value"], "left")
        go = F.col("__next").isNotNull() & ~F.array_contains("__seen", F.col("value"))
        new = cut(step.select("scope", "name", F.when(go, F.col("__next")).otherwise(F.col("value")).alias("value"), (F.col("hops") + go.cast("long")).alias("hops"), F.when(go, F.concat("__seen", F.array("value"))).otherwise(F.col("__seen")).alias("__seen"), go.alias("__go")))
        cur = new.drop("__go")
        if new.where("__go").isEmpty():
            break
    return cur.drop("__seen")


def backward_slice(steps: DataFrame, seeds: DataFrame, max_hops: int = 12) -> DataFrame:
    """(seed, node, hop) along (node -> previous) links: at most max_hops definitions back."""
    cur = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).cast("long").alias("hop"))
    out = cur
    for hop in range(1, max_hops + 1):
        cur = cut(cur.join(steps, "node").where("previous is not null").select("seed", F.col("previous").alias("node"), F.lit(hop).cast("long").alias("hop")))
        if cur.isEmpty():
            break
        out = out.unionByName(cur)
    return out


def caller_levels(edges: DataFrame, seeds: DataFrame, per_level: int = 5, depth: int = 2) -> DataFrame:
    """(seed, node, level): the first per_level callers of each seed on each level, by name."""
    front, out = seeds.select(F.col("node").alias("seed"), F.col("node").alias("dst")), None
    for level in range(1, depth + 1):
        met = front.join(edges.select("src", "dst").distinct(), "dst").select("seed", F.col("src").alias("node")).distinct()
        w = Window.partitionBy("seed").orderBy("node")
        here = cut(met.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_level).select("seed", "node", F.lit(level).cast("long").alias("level")))
        out = here if out is None else out.unionByName(here)
        front = here.select("seed", F.col("node").alias("dst"))
    return out


def context_slice(depends: DataFrame, calls: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(seed, node, context): what a seed depends on, across calls. depends: (node -> on) within a function; calls: (node -> on, site) where a step enters a
    callee. A context is the list of open call sites; a site isn't entered twice."""
    cur = seeds.select(F.col("node").alias("seed"), "node", F.array().cast("array<string>").alias("context"))
    steps = depends.select("node", "on", F.lit(None).cast("string").alias("site")).unionByName(calls.select("node", "on", "site"))
    seen = cut(cur)
    front = seen
    for _ in range(max_depth):
        met = front.join(steps, "node").where(F.col("site").isNull() | ~F.array_contains("context", F.coalesce("site", F.lit(""))))
        new = met.select("seed", F.col("on").alias("node"), F.when(F.col("site").isNull(), F.col("context")).otherwise(F.concat("context", F.array("site"))).alias("context")).distinct().join(seen, ["seed", "node", "context"], "left_anti")
        front = cut(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def propagation_stats(nodes: DataFrame) -> DataFrame:
    """One row: nodes by status."""
    return nodes.agg(F.count("*").alias("nodes"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("SENSITIVE", "PROPAGATED", "PRUNED", "SUSPECT", "ENTRY")])
