"""Interval joins: points into the spans that hold them, and nearest points in a band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def containing(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Inner join of points with spans of the same keys that hold `at` (ends included). Spans are dealt to bins of `width`, so the
    join is an equi-join on (keys, bin) with a residual, whatever the length of a file; a point has one bin and no pair repeats."""
    binned = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))
    left = points.withColumn("__bin", F.floor(F.col(at) / width).cast("long"))
    return left.join(binned, [*keys, "__bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__bin")


def owner(points: DataFrame, spans: DataFrame, keys: list[str], point_id: list[str], at: str, start: str, end: str, width: int, tie: str = "last", seq: str | None = None) -> DataFrame:
    """One span of each point that has any: `last` or `first` in list order (seq), or `innermost` (the shortest, then the later)."""
    seq_col = F.col(seq or start)
    order = {"last": [seq_col.desc()], "first": [seq_col.asc()], "innermost": [(F.col(end) - F.col(start)).asc(), seq_col.desc()]}[tie]
    w = Window.partitionBy(*keys, *point_id).orderBy(*order)
    return containing(points, spans, keys, at, start, end, width).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def band_nearest(left: DataFrame, right: DataFrame, left_id: str, at: str, band: int, key: str, value: str) -> DataFrame:
    """left (left_id, at, key) with `value` of the right row (value, at, key) within +-band: one with the same key if there is any (`preferred`), then the nearest,
    then the smallest value. Two as-of passes over bins as wide as the band, one within keys and one over all; a place is looked up once, however many rows are there, in
    three bins, and a bin is scanned once in each direction: no pair is formed, and no frame ends at the bin's end, which Spark would read anew for each row."""
    bin_ = F.floor(F.col(at) / band).cast("long")
    out = left
    for own in (True, False):
        keys = [key] if own else []
        x = "__own" if own else "__all"
        held = right.groupBy(*keys, at).agg(F.min(value).alias("__v")).select(*keys, bin_.alias("__b"), F.col(at).alias("__at"), F.struct(F.col(at).alias("at"), F.col("__v").alias("v")).alias("__r"))
        asked = left.select(*keys, at).distinct().select(*keys, F.explode(F.array(*[bin_ + d for d in (-1, 0, 1)])).alias("__b"), F.col(at).alias("__at"))
        both = asked.unionByName(held, allowMissingColumns=True)
        w = Window.partitionBy(*keys, "__b").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn("__p", F.last("__r", True).over(w.orderBy("__at"))).withColumn("__n", F.last("__r", True).over(w.orderBy(F.col("__at").desc()))).where(F.col("__r").isNull())
        found = both.select(*keys, F.explode(F.array("__p", "__n")).alias("__x"), "__at").where(F.abs(F.col("__x.at") - F.col("__at")) <= band)
        best = found.groupBy(*keys, F.col("__at").alias(at)).agg(F.min(F.struct(F.abs(F.col("__x.at") - F.col("__at")).alias("d"), F.col("__x.v").alias("v"))).alias(x))
        out = out.join(best, [*keys, at], "left")
    near = F.coalesce("__own", "__all")
    return out.where(near.isNotNull()).select(*left.columns, F.col("__own").isNotNull().alias("preferred"), near["v"].alias(value))
