"""Pieces that the operators of this subpackage share: shared tables, Arrow text buffers, word hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles, so that a worker's memory doesn't follow the Arrow batch's size.
STEP_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and everything runs on one machine (tests) one of our own. A cluster
    without the setting is an error: its machines would each write to a folder of their own."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="ferrule-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, fixes row ids."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ferrule/{uuid.uuid4().hex}/{name}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ferrule_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what materialize wrote. Only for tables that no frame still to be run reads."""
    for t in tables:
        path = getattr(t, "_ferrule_path", None)
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(off: np.ndarray, most: int = STEP_BYTES, rows: int = 60_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes and `rows` rows each, but one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi
        lo = hi


def cut_rows(buf: np.ndarray, off: np.ndarray, most: int, *ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows above `most` bytes in pieces of at most that: offsets, and the row of each piece. A piece ends after the last byte of the first of ends' classes that its
    second half has; failing all, between two characters."""
    if not (np.diff(off) > most).any():
        return off, np.arange(len(off) - 1)
    cuts, owner = [int(off[0])], []
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        while b - a > most:
            half = buf[a + most // 2 : a + most]
            for kind in (*ends, None):
                at = np.flatnonzero(kind[half]) if kind is not None else np.flatnonzero((buf[a + most // 2 + 1 : a + most + 1] & 0xC0) != 0x80)
                if len(at):
                    a += most // 2 + int(at[-1]) + 1
                    break
            else:
                a += most
            cuts.append(a)
            owner.append(i)
        cuts.append(b)
        owner.append(i)
    return np.array(cuts, np.int64), np.array(owner, np.int64)


def release() -> None:
    """Give memory that numpy and Arrow have freed back to the system: workers live on between stages, and several share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def with_text(docs: DataFrame, keep: list) -> tuple[DataFrame, int, int]:
    """docs with keep's columns, and the text last if it isn't among them: the frame, the text's place, the number of kept columns."""
    given = docs.select(*keep)
    if "text" in given.columns:
        return given, given.columns.index("text"), len(given.columns)
    return docs.select(*keep, F.col("text").alias("__text")), len(given.columns), len(given.columns)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (murmur3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_LUT = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        for name, base in (("up", BASE), ("down", _INVERSE)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each span; values are already random 64-bit words."""
    n = len(values)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each row: start, end, row."""
    n = len(buf)
    space = _SPACE[buf]
    inner = off[(off > 0) & (off < n)]
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    before[inner] = True
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    after[inner - 1] = True
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(after & ~space) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles (A-Z lower-cased) of each row, one after another, and
    len + 1 offsets. A row with fewer words than k has its whole word sequence as one; one without words none."""
    rows = len(off) - 1
    start, end, row = words(buf, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    w = spans_hash(_LUT[LOWER[buf]], start, end)
    per = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(per)])
    h = np.zeros(len(w), np.uint64)
    reach = len(w) - k + 1
    if reach > 0:
        for j in range(k):
            h[:reach] = h[:reach] * np.uint64(0xD6E8FEB86659FD93) + w[j : reach + j]
        h = mix(h)
    out, sizes = [], np.zeros(rows, np.int64)
    for i in np.flatnonzero(per):
        a, m = first[i], per[i]
        if m >= k:
            got = np.sort(h[a : a + m - k + 1])
            if len(got) > 1:
                got = got[np.concatenate([[True], got[1:] != got[:-1]])]
        else:
            x = np.uint64(m)
            for j in range(a, a + m):
                x = mix(np.array([x]) * np.uint64(0xD6E8FEB86659FD93) + w[j])[0]
            got = np.array([x], np.uint64)
        sizes[i] = len(got)
        out.append(got)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components (node, component: the smallest node) by alternating large-star and small-star steps.

    Each step is one shuffle on the node and its result is written to the shared folder; the number of steps follows
    the logarithm of the longest path, and a hub's neighbours are only aggregated by min, never gathered."""
    cur = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    # done when every component is a star: no centre has an edge to a smaller node
    while not cur.join(cur.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() or not cur.groupBy("u").count().where("count > 1").isEmpty():
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least.withColumn("m", F.least("m", "u")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, cur = cur, materialize(small, "cc")
        discard(last)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))


def folded(doc_id: str, folds: int) -> "F.Column":
    """crc32 of doc_id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of about `rows` rows of each class at most: those whose hash of doc_id is least. The bound is a
    parameter of the fitted model; labels are counted over all rows, and only the chosen rows' texts are read out."""
    own = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y")).withColumn("o", F.xxhash64("doc_id", F.lit(7)))
    n = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    cut = {y: 2**63 - 1 if n.get(y, 0) <= rows else int(rows / n[y] * 2**64) - 2**63 for y in (0, 1)}
    chosen = own.where(F.col("o") <= F.when(F.col("y") == 1, F.lit(cut[1])).otherwise(F.lit(cut[0])))
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").toArrow()
    got = got.sort_by("doc_id")
    return [x or "" for x in got["text"].to_pylist()], got["y"].to_numpy().astype(np.int64)
