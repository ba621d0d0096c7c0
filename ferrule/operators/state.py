"""Object state: field writes and reads with unit transforms, merges of states with confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transform_unit(value: Column, transform: Column) -> Column:
    return F.when(transform == "bytes_to_bits", value * 8).when(transform == "bits_to_bytes", F.floor(value / 8).cast("long")).otherwise(value)


def merge_states(a: DataFrame, b: DataFrame, key: list[str], decay: float = 0.9) -> DataFrame:
    """Full outer join of two states (key, values array, confidence): values unite, confidence is the lower one, times decay where both sides
    hold different values."""
    x = a.withColumnsRenamed({"values": "__va", "confidence": "__ca"})
    y = b.withColumnsRenamed({"values": "__vb", "confidence": "__cb"})
    empty = F.array().cast(a.schema["values"].dataType)
    both = F.array_sort(F.array_union(F.coalesce("__va", empty), F.coalesce("__vb", empty)))
    clash = F.col("__va").isNotNull() & F.col("__vb").isNotNull() & (F.array_sort(F.array_distinct("__va")) != F.array_sort(F.array_distinct("__vb")))
    low = F.least("__ca", "__cb")
    return x.join(y, key, "full").select(*key, both.alias("values"), F.when(clash, low * decay).otherwise(low).alias("confidence"))


def first_known(rows: DataFrame, key: list[str], fields: list[str], priority: str) -> DataFrame:
    """One row per key: each field's first non-null value by priority, the greatest confidence."""
    return rows.groupBy(*key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(priority))).alias(f) for f in fields], F.max("confidence").alias("confidence"))
