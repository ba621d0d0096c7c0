"""Exact top-k search in Hamming space by incremental multi-index hashing.

Codes of 64 bits are indexed by each of their m segments (4 of 16 bits; 3 of 21 or 22 bits above MANY codes, so that buckets stay small). Queries probe, for radius
0, 1, 2, ..., every segment value at just that distance from their own; where the index has fewer segment values than there are masks of that
distance, its values are looked through instead. After radius r all codes up to distance m (r + 1) - 1 have been seen (a nearer one would agree better in
some segment), so a query is done when its k-th verified distance is within that; only the others go on.

Equal codes are one indexed code with its k + 1 smallest different ids and how often each occurs (no others can be in a top-k ordered by
distance and id, whichever id is the query's own), so neither a very common vector nor a bucket of equal codes grows a result. A query code
keeps its k + 1 nearest different ids, of each the nearest k rows: without the query's own id k rows are left, however often that id
occurs. A pair met in several segments is taken in the first of its nearest ones: no distinct is needed.

Cases: null embeddings and null ids are neither indexed nor asked; vectors of more than 64 values are an error (their code would leave some out), of shorter ones the
missing bits are 0; a row is not its own neighbour, but an equal row is; repeated ids are rows of their own; ties go to the smaller id; fewer than k
other rows give fewer; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, partitions

BITS = 64
#: Distinct codes from which there are 3 segments instead of 4.
MANY = 1 << 22


def sign_code(vector: Column) -> Column:
    """Bit i is set if value i (of 64 at most) is above 0."""
    whole = F.when(F.size(vector) <= BITS, vector).otherwise(F.raise_error(F.lit(f"a vector of more than {BITS} values")))
    bits = F.transform(whole, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _segments(m: int) -> list[tuple[int, int]]:
    """(first bit, bits) of m segments."""
    first = [BITS * s // m for s in range(m + 1)]
    return [(a, b - a) for a, b in zip(first[:-1], first[1:])]


def _segment(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _nearest_ids(met: DataFrame, k: int) -> DataFrame:
    """met: (q, id, n rows, distance). The entries of each q's k + 1 nearest different ids, of each id those of its k nearest rows."""
    of_id = Window.partitionBy("q", "id").orderBy("distance")
    nearer = F.coalesce(F.sum("n").over(of_id.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = met.repartition("q").withColumns({"nearer": nearer, "first": F.first("distance").over(of_id)}).where(F.col("nearer") < k)
    ids = F.dense_rank().over(Window.partitionBy("q").orderBy("first", "id"))
    return kept.withColumn("r", ids).where(F.col("r") <= k + 1).select("q", "id", "n", "distance")


def _probes(asked: DataFrame, values: DataFrame, n_values: int, radius: int, segments: list[tuple[int, int]]) -> DataFrame:
    """(q, limit, seg, value) of the segment values at distance `radius`; both tables that are broadcast have a fixed bound, 2 ** 22 rows and as many as segments have values."""
    own = F.posexplode(F.array(*[_segment(F.col("q"), *s) for s in segments])).alias("seg", "own")
    probes = asked.repartition(partitions(asked.sparkSession), "q").select("q", "limit", own)
    if radius == 0:
        return probes.withColumnRenamed("own", "value")
    width = max(w for _, w in segments)
    if n_values <= min(len(segments) * comb(width, radius), 1 << 18):
        return probes.join(F.broadcast(values), "seg").where(F.bit_count(F.col("own").bitwiseXOR(F.col("value"))) == radius).drop("own")
    masks = asked.sparkSession.range(1 << width).select(F.col("id").cast("int").alias("mask")).where(F.bit_count("mask") == radius)
    fits = F.element_at(F.array(*[F.lit(1 << w) for _, w in segments]), F.col("seg") + 1)
    # a keyed join with one key, not a cross join of tables: each probe row meets the fixed masks of its radius
    return probes.join(F.broadcast(masks)).where(F.col("mask") < fits).select("q", "limit", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, m: int | None = None) -> DataFrame:
    """rows, queries: (id long, code long). (query_id, rank, id, distance) of each query's k nearest other rows; m: number of segments."""
    rows = rows.where(F.col("id").isNotNull() & F.col("code").isNotNull())
    queries = queries.where(F.col("id").isNotNull() & F.col("code").isNotNull())
    smallest = Window.partitionBy("code").orderBy("id")
    entries = rows.groupBy("code", "id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))  # no top-k holds more of one
    members = materialize(entries.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1).select("code", "id", "n"), "members")
    codes = members.select("code").distinct()
    segments = _segments(m or (4 if codes.count() < MANY else 3))
    index = materialize(codes.select("code", F.posexplode(F.array(*[_segment(F.col("code"), *s) for s in segments])).alias("seg", "value")), "index")
    values = materialize(index.select("seg", "value").distinct(), "values")
    n_values = values.count()
    asked = materialize(queries.select(F.col("code").alias("q"), F.lit(BITS).alias("limit")).distinct(), "asked")
    best, found = None, []
    for radius in range(max(w for _, w in segments) + 1):
        probes = _probes(asked, values, n_values, radius, segments)
        pairs = probes.join(index, ["seg", "value"])
        apart = [_distance(_segment(F.col("q"), *s), _segment(F.col("code"), *s)) for s in segments]
        # in the first of the segments at this radius, and none is nearer
        for s in range(len(segments)):
            pairs = pairs.where((apart[s] > radius) | ((apart[s] == radius) & (F.col("seg") <= s)))
        # what is farther than the k + 1 best ids so far can't be among them
        pairs = pairs.where(_distance(F.col("q"), F.col("code")) <= F.col("limit"))
        met = pairs.select("q", "code", _distance(F.col("q"), F.col("code")).alias("distance")).join(members, "code").select("q", "id", "n", "distance")
        best = _nearest_ids(met if best is None else met.unionByName(best), k)
        best = materialize(best, "best")
        sure = len(segments) * (radius + 1) - 1
        done = best.where(F.col("distance") <= sure).groupBy("q").agg(F.count_distinct("id").alias("ids")).where(F.col("ids") >= k + 1).select("q")
        if sure >= BITS:
            found.append(best)
            break
        found.append(best.join(done, "q", "left_semi"))
        nearest = best.groupBy("q", "id").agg(F.min("distance").alias("distance"))
        worst = nearest.groupBy("q").agg(F.max("distance").alias("far"), F.count("*").alias("ids")).where(F.col("ids") >= k + 1)
        asked = asked.join(done, "q", "left_anti").join(worst, "q", "left")
        last, asked = asked, materialize(asked.select("q", F.coalesce("far", "limit").alias("limit")), "asked")
        discard(last)
        best = best.join(done, "q", "left_anti")
        if asked.isEmpty():
            break
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    own = Window.partitionBy("query_row").orderBy("distance", "id")
    each = queries.select(F.monotonically_increasing_id().alias("query_row"), F.col("id").alias("query_id"), F.col("code").alias("q"))
    others = each.join(near, "q").where(F.col("id") != F.col("query_id")).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    out = others.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias("neighbor_id"), "distance")
