"""Sharding by histogram sort.

Rows are put in shards of near-equal bytes along a key (60 bits of the text's md5, then doc_id). The splitters are found without
sorting: every round counts the exact bytes below a set of candidate boundaries over all partitions and replaces each
splitter's bracket by the two probes around its target, until a bracket is as narrow as the tolerance or one row. Then rows are
exchanged once, straight to their place. With tolerance 0 a splitter is the boundary between rows that is nearest to its share of the bytes (of two the lower).

Cases: a null text has no bytes, 16 in size and the crc of nothing; a null doc_id sorts first in its key; equal texts lie side by side, in two shards where a splitter
falls between them; rows equal in text and doc_id that outweigh the tolerance are told by a row id (their table is written once for that); an empty table gives no
rows; more shards than rows leave shards empty; extra columns pass through, but for ones named shard, slot, size and law, which the result replaces.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def splitters(keys: DataFrame, parts: int, tolerance: float, probes: int = 24) -> tuple[list[tuple[int, int]], list[tuple[int, int]], bool]:
    """keys: (k1 long, k2 long, size long). Boundaries (k1, k2) of `parts` ranges: range i holds keys >= boundary i - 1 and
    < boundary i. Also (rows, bytes) below each boundary, and whether rows of one key kept some splitter from its place. Only counts between probes reach the driver."""
    n_rows, n_bytes, k2_low, k2_high = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.min("k2"), F.lit(0)), F.coalesce(F.max("k2"), F.lit(0))).first()
    # a key is one number: k1, shifted to be non-negative, times the range of k2, plus k2's place in that range
    span = k2_high - k2_low + 1
    end = span << 64
    brackets = [[0, 0, 0, end, n_rows, n_bytes] for _ in range(1, parts)]  # low key, rows and bytes below it, high key, same
    targets = [n_bytes * i / parts for i in range(1, parts)]
    slack = tolerance * n_bytes / parts
    done, stuck = [None] * (parts - 1), False
    for i, t in enumerate(targets):
        if n_rows == 0:
            done[i] = brackets[i][:3]
    split = lambda x: (x // span - (1 << 63), x % span + k2_low) if x < end else (HIGH, HIGH)
    while any(d is None for d in done):
        asked = set()
        for i, b in enumerate(brackets):
            if done[i] is None:
                width = b[3] - b[0]
                # a group of equal k1 can outweigh the tolerance: then the bracket lies inside one k1 and k2 splits it
                asked |= {b[0] + width * j // (probes + 1) for j in range(1, probes + 1)} - {b[0]}
        asked = sorted(asked)
        counted = _count_between(keys, [split(x) for x in asked])
        below, at_rows, at_bytes = {}, 0, 0
        for j in range(len(asked)):
            r, s = counted.get(j, (0, 0))
            at_rows, at_bytes = at_rows + r, at_bytes + s
            below[asked[j]] = (at_rows, at_bytes)
        for i, b in enumerate(brackets):
            if done[i] is not None:
                continue
            own = [[b[0], b[1], b[2]], *([x, *below[x]] for x in asked[bisect_left(asked, b[0] + 1) : bisect_left(asked, b[3])]), [b[3], b[4], b[5]]]
            near = min(own, key=lambda x: abs(x[2] - targets[i]))
            k = next((j for j in range(1, len(own)) if own[j][2] >= targets[i]), len(own) - 1)
            lo, hi = own[k - 1], own[k]
            brackets[i] = [*lo, *hi]
            if abs(near[2] - targets[i]) <= slack or hi[0] - lo[0] <= 1 or hi[1] - lo[1] <= 1:
                done[i] = near
                stuck |= hi[1] - lo[1] > 1 and abs(near[2] - targets[i]) > slack
    return [split(d[0]) for d in done], [(d[1], d[2]) for d in done], stuck


#: Ranges up to which a row's own is found by compiled comparisons; beyond that by a search in Arrow batches of the keys alone.
COMPILED = 512
#: Ranges at most: their boundaries are probed from the driver.
RANGES = 1 << 16


def range_of(k1: Column, k2: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of bounds that are <= (k1, k2), by a balanced tree of comparisons: log2(bounds) of them for a row."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        a, b = bounds[mid]
        return F.when((k1 < a) | ((k1 == a) & (k2 < b)), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    if len(bounds) < COMPILED:
        return tree(0, len(bounds))
    b1, b2 = np.array([x for x, _ in bounds], np.int64), np.array([y for _, y in bounds], np.int64)

    @F.pandas_udf("int")
    def found(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_place(b1, b2, x.to_numpy(), y.to_numpy()).astype(np.int32))

    return found(k1, k2)


def _place(b1: np.ndarray, b2: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Number of the ascending bounds (b1, b2) that are <= (k1, k2)."""
    at = np.searchsorted(b1, k1, side="left")
    # equal k1: move on past the bounds whose k2 is not above
    while True:
        here = np.minimum(at, len(b1) - 1)
        go = (at < len(b1)) & (b1[here] == k1) & (b2[here] <= k2) if len(b1) else np.zeros(len(k1), bool)
        if not go.any():
            return at
        at = at + go


def _count_between(keys: DataFrame, bounds: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """(rows, bytes) of keys from bound j - 1 to below bound j. The k1 side is searched with a sorted array in Arrow batches;
    a probe table is a few thousand numbers whatever the input."""
    b1 = np.array([x for x, _ in bounds], np.int64)
    b2 = np.array([y for _, y in bounds], np.int64)

    def count(batches):
        rows, size = np.zeros(len(b1) + 1, np.int64), np.zeros(len(b1) + 1, np.int64)
        for batch in batches:
            k1, k2, s = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(3))
            at = _place(b1, b2, k1, k2)
            rows += np.bincount(at, minlength=len(b1) + 1)
            size += np.bincount(at, weights=s, minlength=len(b1) + 1).astype(np.int64)
        hit = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(rows[hit]), pa.array(size[hit])], ["j", "r", "s"])

    got = keys.select("k1", "k2", "size").mapInArrow(count, "j long, r long, s long").groupBy("j").agg(F.sum("r"), F.sum("s")).collect()
    return {j: (r, s) for j, r, s in got}


def text_key(text: Column) -> Column:
    """60 bits of the text's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def histogram_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.0, key: Column | None = None, sub_bytes: int = 128 << 20) -> DataFrame:
    """docs with shard, slot (gapless from 0 in each shard, in key order), size and law added. Shards are near equal in
    bytes (`tolerance` of a shard's share, or as near as whole rows allow).

    Each shard is dealt to several tasks if it is above `sub_bytes`, to RANGES / shards at most: the histogram has the exact row count below every cut,
    so a slot is that count plus the row's place in its task."""
    cols = docs.columns
    tag = "__hs"
    k1 = key if key is not None else text_key(F.col("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    keyed = docs.select(*[F.col(f"`{c}`") for c in cols], k1.alias(f"{tag}k1"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias(f"{tag}k2"), size.alias(f"{tag}size"))
    own = [F.col(f"{tag}{c}").alias(c) for c in ("k1", "k2", "size")]
    keys = materialize(keyed.select(*own), "keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sub = max(1, min(-(-total // (shards * sub_bytes)), RANGES // shards))
    bounds, below, stuck = splitters(keys, shards * sub, tolerance * (1 if sub == 1 else 1 / sub))
    if stuck:
        keyed = materialize(keyed.withColumn(f"{tag}k2", F.monotonically_increasing_id()), "rows")
        bounds, below, _ = splitters(keyed.select(*own), shards * sub, tolerance * (1 if sub == 1 else 1 / sub))
    base = [0, *(r for r, _ in below)]
    placed = keyed.withColumn(f"{tag}p", range_of(F.col(f"{tag}k1"), F.col(f"{tag}k2"), bounds))
    place = Window.partitionBy(f"{tag}p").orderBy(f"{tag}k1", f"{tag}k2")
    numbered = placed.withColumn(f"{tag}n", F.row_number().over(place).cast("long") - 1)
    first = [base[p] - base[p // sub * sub] for p in range(shards * sub)]
    if len(first) <= COMPILED:
        slot = F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col(f"{tag}p") + 1)
    else:
        numbered = numbered.join(F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(first)), f"{tag}p int, {tag}first long")), f"{tag}p")
        slot = F.col(f"{tag}first")
    return numbered.select(*[F.col(f"`{c}`") for c in cols if c not in ("shard", "slot", "size", "law")], F.floor(F.col(f"{tag}p") / sub).cast("int").alias("shard"), (F.col(f"{tag}n") + slot).alias("slot"), F.col(f"{tag}size").alias("size"), F.lit("bytes").alias("law"))
