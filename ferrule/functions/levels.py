"""Severity levels, range strings and the ladders that rate rules and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels from least to most severe, and the level of a constraint's own scale.
LEVELS = ["info", "low", "medium", "high", "critical"]
CONSTRAINT_LEVELS = {"critical": "high", "error": "high", "warning": "medium", "info": "low", "none": "info"}


def rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)


def worst(*levels: Column) -> Column:
    """The most severe; nulls are passed over."""
    return F.get(F.array(*[F.lit(x) for x in LEVELS]), (F.greatest(*[rank(x) for x in levels]) - 1).cast("int"))


def in_range(value: Column, text: Column) -> Column:
    """"2048", "< 2048", "<= 2048", "> 2048", ">= 2048"; anything else holds for nothing."""
    op = F.regexp_extract(text, r"^\s*([<>]=?|)\s*\d+\s*$", 1)
    bound = F.nullif(F.regexp_extract(text, r"^\s*(?:[<>]=?|)\s*(\d{1,18})\s*$", 1), F.lit("")).cast("long")
    hit = F.when(op == "<", value < bound).when(op == "<=", value <= bound).when(op == ">", value > bound).when(op == ">=", value >= bound).otherwise(value == bound)
    return F.coalesce(F.when(bound.isNotNull(), hit), F.lit(False))


def of_constraint(level: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CONSTRAINT_LEVELS.items() for x in p]), level), F.lit("medium"))


def of_rule(whitelisted: Column, quantum_secure: Column, violation: Column) -> Column:
    """Whitelisted low; strong (or true) info; weak medium; else high; a violation is high at least."""
    q = F.lower(quantum_secure.cast("string"))
    base = F.when(whitelisted, "low").when(q == "weak", "medium").when(q.isin("true", "strong"), "info").otherwise("high")
    return F.when(F.coalesce(violation, F.lit(False)), worst(base, F.lit("high"))).otherwise(base)


def of_profile(quantum_level: Column, classic_min: Column, classic_level: Column, quantum_secure: Column, q_bits: Column, key_bits: Column) -> Column:
    """The quantum constraint's level (high if the key is below the classic minimum), then the classic range's level, then the
    bands of quantum security."""
    q = F.lower(quantum_secure.cast("string"))
    first = F.when(quantum_level.isNotNull(), F.when(key_bits < classic_min, "high").otherwise(of_constraint(quantum_level)))
    second = F.when(key_bits.isNotNull() & classic_level.isNotNull(), of_constraint(classic_level))
    third = F.when(q.isin("true", "strong"), "info").when(q == "weak", "medium").when(q == "broken", "high").when(q_bits < 64, "high").when(q_bits < 128, "medium").when(q_bits >= 128, "low").otherwise("high")
    return F.coalesce(first, second, third)


def unknown_reason(profile: Column) -> Column:
    """Why a profile isn't concrete: the first of six tokens in it."""
    p = F.upper(F.coalesce(profile, F.lit("")))
    return F.when(p == "", "missing").when(p.contains("DYNAMIC"), "dynamic").when(p.contains("FACTORY"), "factory").when(p.contains("UTIL"), "utility").when(p.contains("PRIM"), "primitive").when(p.contains("UNKNOWN"), "UNKNOWN").when(p.rlike("^ALG\\."), F.lit(None)).otherwise("unmapped")
