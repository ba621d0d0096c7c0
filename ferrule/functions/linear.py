"""Linear transforms a * x + b of a parameter: parse, apply, reverse, and solve for a bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binding(arg: Column) -> Column:
    """struct(kind, source, mul, div, add, value) of an argument: constant, variable, x*k, k*x, x+k, x-k, x/k; else `complex`."""
    a = F.trim(arg)
    part = lambda pattern, g=1: F.nullif(F.regexp_extract(a, pattern, g), F.lit(""))
    ident, num = r"([A-Za-z_][A-Za-z0-9_.]*)", r"(\d{1,9})"
    const = part(rf"^(-?\d{{1,18}})$").cast("long")
    plain = part(rf"^{ident}$")
    times = [part(rf"^{ident}\s*\*\s*{num}$", 2), part(rf"^{num}\s*\*\s*{ident}$", 1)]
    source = F.coalesce(plain, part(rf"^{ident}\s*[-+*/]\s*{num}$", 1), part(rf"^{num}\s*[*+]\s*{ident}$", 2))
    mul = F.coalesce(*[t.cast("long") for t in times], F.lit(1).cast("long"))
    div = F.coalesce(part(rf"^{ident}\s*/\s*{num}$", 2).cast("long"), F.lit(1).cast("long"))
    add = F.coalesce(part(rf"^{ident}\s*\+\s*{num}$", 2).cast("long"), part(rf"^{num}\s*\+\s*{ident}$", 1).cast("long"), -part(rf"^{ident}\s*-\s*{num}$", 2).cast("long"), F.lit(0).cast("long"))
    kind = F.when(const.isNotNull(), "constant").when(plain.isNotNull(), "variable").when(source.isNotNull(), "linear").otherwise("complex")
    return F.struct(kind.alias("kind"), source.alias("source"), mul.alias("mul"), div.alias("div"), add.alias("add"), const.alias("value"))


def apply(x: Column, mul: Column, div: Column, add: Column) -> Column:
    """(x * mul) div `div` + add, with whole-number division."""
    return F.floor(F.try_divide(x * mul, div)).cast("long") + add


def reverse_exact(y: Column, mul: Column, add: Column) -> Column:
    """x of mul * x + add = y; null if it isn't whole."""
    return F.when((mul != 0) & ((y - add) % F.nullif(mul, F.lit(0)) == 0), F.floor(F.try_divide(y - add, mul)).cast("long"))


def at_least(threshold: Column, mul: Column, add: Column, div: Column | None = None) -> Column:
    """Least x with (mul * x) div `div` + add >= threshold, for mul > 0."""
    need = threshold - add
    need = need * div if div is not None else need
    return F.when(mul > 0, F.ceil(F.try_divide(need, mul)).cast("long"))


def at_most(threshold: Column, mul: Column, add: Column, div: Column | None = None) -> Column:
    """Greatest x with (mul * x) div `div` + add <= threshold, for mul > 0."""
    need = threshold - add
    need = need * div + (div - 1) if div is not None else need
    return F.when(mul > 0, F.floor(F.try_divide(need, mul)).cast("long"))


def reverse_bound(predicate: Column, threshold: Column, mul: Column, add: Column, div: Column) -> Column:
    """The bound on x that the predicate (GEQ, LEQ, EQ, NEQ) on its transform amounts to."""
    exact = F.when(div == 1, reverse_exact(threshold, mul, add)).when(mul == 1, (threshold - add) * div)
    return F.when(predicate == "GEQ", at_least(threshold, mul, add, div)).when(predicate == "LEQ", at_most(threshold, mul, add, div)).otherwise(exact)
