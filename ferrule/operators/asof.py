"""As-of lookups: the last definition at or before a place, in scope, then globally, then the last of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], seq: str) -> DataFrame:
    """left with the `values` of the last right row of the same keys at or before it (a later seq wins at one place). Both sides are
    united and scanned once in order: one shuffle on the keys and no pair is ever formed. Columns of left stay as they are."""
    own = left.columns
    held = F.struct(*[F.col(v) for v in values])
    a = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__seq"), F.struct(*own).alias("__row"), F.lit(None).cast(right.select(held.alias("s")).schema["s"].dataType).alias("__val"))
    b = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.col(seq).cast("long").alias("__seq"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), held.alias("__val"))
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__at", "__side", "__seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = a.unionByName(b).withColumn("__last", F.last("__val", ignorenulls=True).over(w)).where("__side = 1")
    return seen.select("__row.*", *[F.col("__last")[v].alias(v) for v in values])


def scoped(left: DataFrame, right: DataFrame, scope: list[str], left_at: str, right_at: str, value: str, seq: str) -> DataFrame:
    """`value` by three tiers: last in scope at or before; last in the whole table at or before; last of all. `tier` tells which."""
    in_scope = backward(left, right, scope, left_at, right_at, [value], seq).withColumnRenamed(value, "__v1")
    # the whole table has one order: bucket it by place, and carry the last value of the buckets before
    total = right.agg(F.max(F.struct(F.col(right_at), F.col(seq), F.col(value)))[value].alias("__v3"))
    days = right.withColumn("__g", F.floor(F.col(right_at).cast("double") / 86400))
    last_of = days.groupBy("__g").agg(F.max(F.struct(F.col(right_at), F.col(seq), F.col(value)))[value].alias("__before"))
    marked = in_scope.withColumn("__g", F.floor(F.col(left_at).cast("double") / 86400))
    within = backward(marked, days.withColumnRenamed(value, "__v2"), ["__g"], left_at, right_at, ["__v2"], seq)
    carried = _carry(within, last_of)
    found = carried.crossJoin(F.broadcast(total))
    glob = F.coalesce("__v2", "__before")
    return found.withColumn("tier", F.when(F.col("__v1").isNotNull(), 1).when(glob.isNotNull(), 2).otherwise(3)).withColumn(value, F.coalesce("__v1", glob, "__v3")).drop("__v1", "__v2", "__v3", "__before", "__g")


def _carry(rows: DataFrame, last_of: DataFrame) -> DataFrame:
    """rows (with bucket __g) with __before, the last value of the nearest earlier bucket. last_of has a row for each bucket (a day)."""
    w = Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.select("__g").distinct().join(last_of, "__g", "full").withColumn("__p", F.last("__before", ignorenulls=True).over(w)).select("__g", F.col("__p").alias("__before"))
    return rows.join(F.broadcast(buckets), "__g", "left")


def running_state(events: DataFrame, objects: list[str], field: str, order: list[str], value: str) -> DataFrame:
    """events with `state`: the value last written to (object, field), this event's included."""
    w = Window.partitionBy(*objects, field).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("state", F.last(value, ignorenulls=True).over(w))


def context_of(events: DataFrame, scope: list[str], order: list[str], opens: str, value: str) -> DataFrame:
    """events with `context`: the value of the last event at or before for which `opens` holds (a factory's result for later calls on
    the same receiver)."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("context", F.last(F.when(F.expr(opens), F.col(value)), ignorenulls=True).over(w))


def next_matching(rows: DataFrame, scope: list[str], order: list[str], matches: str, value: str) -> DataFrame:
    """rows with `following`: the value of the next row for which `matches` holds."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("following", F.first(F.when(F.expr(matches), F.col(value)), ignorenulls=True).over(w))
