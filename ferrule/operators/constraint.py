"""Constraint operators: profile checks, three-valued satisfaction, simplification, conflicts, derivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linear

PREDICATES = ("GEQ", "LEQ", "EQ", "NEQ", "IN")


def holds(predicate: Column, value: Column, bound: Column, members: Column | None = None) -> Column:
    """Three-valued: null if the value is unknown."""
    listed = F.array_contains(members, value) if members is not None else F.lit(None).cast("boolean")
    return F.when(predicate == "GEQ", value >= bound).when(predicate == "LEQ", value <= bound).when(predicate == "EQ", value == bound).when(predicate == "NEQ", value != bound).when(predicate == "IN", listed)


def contract_status(rows: DataFrame, key: list[str], verdict: Column, seq: str) -> DataFrame:
    """(key, status): SAT if all constraints hold; else UNSAT or UNKNOWN, as the first in order that doesn't hold says."""
    first = F.min_by(F.when(verdict.isNull(), "UNKNOWN").otherwise("UNSAT"), F.when(verdict.isNull() | ~verdict, F.col(seq)))
    bad = F.count(F.when(verdict.isNull() | ~verdict, 1))
    return rows.groupBy(*key).agg(F.when(bad == 0, "SAT").otherwise(first).alias("status"))


def simplify(rows: DataFrame, param: str, predicate: str, value: str) -> DataFrame:
    """GEQ keeps its greatest bound, LEQ its least, EQ and NEQ each different value."""
    key = F.when(F.col(predicate).isin("EQ", "NEQ"), F.col(value))
    w = rows.withColumn("__k", key).groupBy(param, predicate, "__k").agg(F.when(F.first(predicate) == "GEQ", F.max(value)).otherwise(F.min(value)).alias(value))
    return w.drop("__k")


def conflicts(rows: DataFrame, param: str) -> DataFrame:
    """Pairs (id_a < id_b) of one parameter that can't both hold. rows: id, param, predicate, value, simplified first, so a parameter has few."""
    a = rows.select(F.col(param), F.col("id").alias("id_a"), F.col("predicate").alias("p"), F.col("value").alias("x"))
    b = rows.select(F.col(param), F.col("id").alias("id_b"), F.col("predicate").alias("q"), F.col("value").alias("y"))
    p, q, x, y = (F.col(c) for c in "pqxy")
    clash = (
        ((p == "GEQ") & (q == "LEQ") & (x > y)) | ((p == "LEQ") & (q == "GEQ") & (x < y)) | ((p == "EQ") & (q == "EQ") & (x != y)) | ((p == "EQ") & (q == "NEQ") & (x == y)) | ((p == "NEQ") & (q == "EQ") & (x == y))
        | ((p == "GEQ") & (q == "EQ") & (y < x)) | ((p == "EQ") & (q == "GEQ") & (x < y)) | ((p == "LEQ") & (q == "EQ") & (y > x)) | ((p == "EQ") & (q == "LEQ") & (x > y))
    )
    return a.join(b, param).where((F.col("id_a") < F.col("id_b")) & clash).select(param, "id_a", "id_b")


def derive(rows: DataFrame, predicate: str, threshold: str, arg: str) -> DataFrame:
    """rows with the bound on the argument's source that the callee's constraint amounts to, and `confidence`: confirmed, or suspect if the
    argument isn't linear (a constant argument gives no constraint)."""
    b = linear.binding(F.col(arg))
    got = rows.withColumn("__b", b)
    bound = linear.reverse_bound(F.col(predicate), F.col(threshold), F.col("__b.mul"), F.col("__b.add"), F.col("__b.div"))
    got = got.withColumn("source", F.col("__b.source")).withColumn("derived", F.when(F.col("__b.kind").isin("variable", "linear"), bound))
    return got.withColumn("confidence", F.when(F.col("__b.kind") == "constant", "none").when(F.col("derived").isNull(), "suspect").otherwise("confirmed")).drop("__b")


#: Columns of a profile's constraint row: profile_id, mode (quantum or classic), param, min_bits, has_min, forbidden array<long>,
#: severity, severity_map map<string,string>, recommended array<string>, reason, migrate_to array<string>.
def check(candidates: DataFrame, constraints: DataFrame, numeric: dict[str, str], mode_col: str) -> DataFrame:
    """violations(candidate's columns, mode, parameter, value, level, reason). candidates: profile_id and the parameters; numeric: parameter
    name -> column. Constraints are a dimension. Each row yields no, one or two violations by an array that is exploded.

    Quantum, numeric: without a resistant minimum one violation and no more; else the severity map's entry, and a warning below the
    minimum. A missing parameter: an algorithm violation if key_bits has no resistant minimum, the algorithm's own, a fixed value's.
    Classic, numeric: forbidden values and no more, else the map's entry. Mode: outside the recommended (quantum), forbidden or mapped (classic)."""
    c = candidates.join(F.broadcast(constraints), "profile_id")
    value = F.coalesce(*[F.when(F.col("param") == p, F.col(col).cast("long")) for p, col in numeric.items()], F.lit(None).cast("long"))
    text = F.when(F.col("param") == "mode", F.upper(F.col(mode_col)))
    mapped = F.try_element_at("severity_map", F.coalesce(value.cast("string"), text))
    row = lambda level, parameter, reason, v: F.struct(level.alias("level"), parameter.alias("parameter"), v.alias("value"), reason.alias("reason"))
    quantum, given, is_number = F.col("mode") == "quantum", value.isNotNull(), F.col("param").isin(*numeric)
    level, reason, shown = F.coalesce("severity", F.lit("warning")), F.coalesce("reason", F.lit("")), F.coalesce(value.cast("string"), text)
    none = F.lit(None).cast("string")
    below = F.concat(F.col("param"), F.lit(" "), value, F.lit(" is below "), F.col("min_bits"))
    items = (
        F.when(quantum & is_number & given & ~F.col("has_min"), F.array(row(level, F.col("param"), reason, shown)))
        .when(quantum & is_number & given, F.filter(F.array(F.when(mapped != "none", row(mapped, F.col("param"), reason, shown)), F.when(value < F.col("min_bits"), row(F.lit("warning"), F.col("param"), below, shown))), lambda x: x.isNotNull()))
        .when(quantum & (F.col("param") == "key_bits") & ~F.col("has_min") & F.col("severity").isNotNull(), F.array(row(level, F.lit("algorithm"), reason, none)))
        .when((F.col("param") == "algorithm") & (F.coalesce("severity", F.lit("none")) != "none"), F.array(row(level, F.lit("algorithm"), reason, none)))
        .when(F.col("param").isin("digest_bits", "block_bits") & ~given & (F.coalesce("severity", F.lit("none")) != "none"), F.array(row(level, F.col("param"), reason, none)))
        .when(~quantum & is_number & given & F.array_contains("forbidden", value), F.array(row(F.coalesce("severity", F.lit("error")), F.col("param"), reason, shown)))
        .when(~quantum & is_number & given & (mapped != "none"), F.array(row(mapped, F.col("param"), reason, shown)))
        .when((F.col("param") == "mode") & quantum & text.isNotNull() & ~F.array_contains("recommended", text), F.array(row(level, F.lit("mode"), reason, shown)))
        .when((F.col("param") == "mode") & ~quantum & (mapped != "none"), F.array(row(mapped, F.lit("mode"), reason, shown)))
    )
    return c.select(*[F.col(x) for x in candidates.columns], "mode", F.explode(items).alias("v")).select(*candidates.columns, "mode", "v.parameter", "v.value", "v.level", "v.reason")


def policy_check(rows: DataFrame, value: str, allow: str, disallow: str) -> DataFrame:
    """rows with `policy`: allow lists win; a missing value violates an allow list; then disallow lists."""
    v = F.col(value)
    return rows.withColumn("policy", F.when(F.size(F.coalesce(allow, F.array())) > 0, F.when(v.isNull(), "missing").when(F.array_contains(allow, v), "allowed").otherwise("not allowed")).when(F.array_contains(disallow, v), "disallowed").otherwise("allowed"))
