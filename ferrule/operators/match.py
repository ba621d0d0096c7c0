"""Rule matching: suffix joins, ordered tiers, relational division, alias and knowledge-base joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .rank import best


def suffix_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose names are equal or dotted suffixes of each other. Such names share their last segment, so the join is an
    equi-join on it and the suffix test a residual: no nested loop."""
    l, r = left.withColumn("__seg", names.last_segment(F.col(a))), right.withColumn("__seg", names.last_segment(F.col(b)))
    return l.join(r, "__seg").where(names.suffix_equal(F.col(a), F.col(b))).drop("__seg")


def first_tier(tiers: list[DataFrame], key: list[str], order: list[Column]) -> DataFrame:
    """The rows of each key's first tier that matched, and of those the best by order; `tier` is 1, 2, ..."""
    every = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i + 1)) for i, t in enumerate(tiers)])
    return best(every, key, [F.col("tier"), *order])


def covering(have: DataFrame, need: DataFrame, key: str, item: str) -> DataFrame:
    """Keys of `have` that have every item of `need` (relational division), by counting: no pair of key and missing item is formed."""
    wanted = need.select(item).distinct()
    n = wanted.agg(F.count("*").alias("__n"))
    got = have.select(key, item).distinct().join(wanted, item, "left_semi").groupBy(key).agg(F.count("*").alias("__c"))
    return got.crossJoin(F.broadcast(n)).where("__c = __n").select(key)


def resolve_alias(calls: DataFrame, aliases: DataFrame, file: str, symbol: str) -> DataFrame:
    """calls with `resolved`: the alias target of the symbol, else of its head with the rest kept, else the symbol."""
    head = F.substring_index(F.col(symbol), ".", 1)
    pair = lambda i: aliases.select(F.col(file).alias(f"__f{i}"), F.col("alias").alias(f"__a{i}"), F.col("target").alias(f"__t{i}"))
    got = calls.join(pair(1), (F.col(file) == F.col("__f1")) & (F.col(symbol) == F.col("__a1")), "left").join(pair(2), (F.col(file) == F.col("__f2")) & (head == F.col("__a2")), "left")
    rest = F.substring(F.col(symbol), F.length("__a2") + 1, F.length(symbol))
    return got.withColumn("resolved", F.coalesce("__t1", F.concat("__t2", rest), symbol)).drop(*[f"__{c}{i}" for c in "fat" for i in (1, 2)])


def merge_kb(apis: DataFrame, profiles: DataFrame, aliases: DataFrame, profile: str, classified: Column, placeholder: str = "ALG.DYNAMIC") -> DataFrame:
    """apis with the profile they resolve to: the classified profile, through its alias, if it is known; else the original one; else its parent; else
    the placeholder."""
    known = profiles.select(F.col("profile_id").alias("__p"))
    name = aliases.select(F.col("alias").alias("__alias"), F.col("profile_id").alias("__to"))

    def known_as(rows: DataFrame, want: Column, out: str) -> DataFrame:
        x = rows.withColumn("__want", want).join(F.broadcast(name), F.col("__want") == F.col("__alias"), "left").withColumn("__id", F.coalesce("__to", "__want"))
        return x.join(F.broadcast(known), F.col("__id") == F.col("__p"), "left").withColumn(out, F.col("__p")).drop("__want", "__alias", "__to", "__id", "__p")

    rows = known_as(apis, classified, "__r1")
    rows = known_as(rows, F.col(profile), "__r2")
    rows = known_as(rows, F.regexp_replace(F.col(profile), r"\.[^.]*$", ""), "__r3")
    return rows.withColumn("resolved_profile", F.coalesce("__r1", "__r2", "__r3", F.lit(placeholder))).drop("__r1", "__r2", "__r3")


def apply_policy(rules: DataFrame, params: DataFrame, whitelist: DataFrame, rule: str, family: str) -> DataFrame:
    """rules with `allow` (the policy of the rule itself, else of its family) and `whitelisted`. Policies are dimensions of a few rows."""
    own = F.broadcast(params.select(F.col("key").alias("__k1"), F.col("allow").alias("__a1")))
    fam = F.broadcast(params.select(F.col("key").alias("__k2"), F.col("allow").alias("__a2")))
    free = F.broadcast(whitelist.select(F.col("key").alias("__k3")).distinct())
    got = rules.join(own, F.col(rule) == F.col("__k1"), "left").join(fam, F.col(family) == F.col("__k2"), "left").join(free, F.col(rule) == F.col("__k3"), "left")
    return got.withColumn("allow", F.coalesce("__a1", "__a2")).withColumn("whitelisted", F.col("__k3").isNotNull()).drop("__k1", "__a1", "__k2", "__a2", "__k3")


def merge_wrappers(apis: DataFrame, wrappers: DataFrame, key: str, strategy: str = "api_first") -> DataFrame:
    """api_first: wrappers only where there is no api; wrapper_first: the reverse; both: all rows."""
    if strategy == "both":
        return apis.unionByName(wrappers, allowMissingColumns=True)
    first, second = (apis, wrappers) if strategy == "api_first" else (wrappers, apis)
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def bind_params(calls: DataFrame, functions: DataFrame, callee: str) -> DataFrame:
    """calls with a row for each argument that a parameter of the callee takes: name, value. functions: (callee, params)."""
    met = calls.join(functions.select(callee, "params"), callee)
    pairs = F.arrays_zip(F.slice("args", F.lit(1), F.size("params")).alias("value"), F.slice("params", F.lit(1), F.size("args")).alias("name"))
    return met.withColumn("__p", F.explode(pairs)).select(*[c for c in calls.columns if c != "args"], "__p.name", "__p.value").where("value is not null")
