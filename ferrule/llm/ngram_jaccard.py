"""N-gram Jaccard self-join of documents with a count-vector R-tree.

A document's set is its distinct 5-word shingles. Documents link at Jaccard >= 0.75, which is 100 * intersection >=
75 * union. The result is each document's connected component.

1. Candidates. A set of n shingles may miss at most n - ceil(0.75 n) of its own in a partner, so a document with more shingles
   that no other document has can't link. Shingles are dealt to buckets in packed blobs, one entry for each shingle and step
   of about 2 MB of text (a shingle that occurs twice in a step is one flagged entry, so a hot shingle costs one entry a step); a
   bucket answers each step with counts of unique shingles.
2. Equal sets are one class from here on. Step 1 is repeated among class representatives, and from here on a set is its size and its
   shared shingles: one that no other representative has is in no intersection, but would loosen every bound below.
3. The shared shingles are ordered by a fixed-size table of counts (rare first) after the others, and a set's first
   n - ceil(0.75 n) + 1 are its prefix: linked sets share a prefix shingle. Sets meet in the groups of these shingles.
4. Group counts (shared shingles fall into 512 groups) are points of a bulk-loaded R-tree. The sum of the coordinates' minima bounds
   the overlap of a set with a node and with a point; what survives is verified on the whole shared sets.
   Rounds: each set's likeliest partner in another component is verified and links contract components, first among neighbours in
   the tree's order, until a round links little, then over whole trees, until a round links nothing. There a round is only over sets for which the round before
   has left any partner in another component. What is left over between components is verified pair by pair.

Groups above BLOCK sets are dealt to several tasks: in the first rounds by a hash that changes with the round, later so that each set outside the
group's largest component meets every block; two sets of one component are never compared. Shingles and sets are known by 64-bit hashes.

Cases: null or empty texts and texts without words have an empty set, size 0,
and are their own component; a null doc_id never is a component's name unless all its members lack one; repeated rows are one class; ties
take the smallest doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, components, discard, materialize, mix, partitions, release, shingle_sets, steps

NUMERATOR, DENOMINATOR = 75, 100
GROUPS, LEAF, SLOTS = 512, 32, 1 << 20
#: In the first rounds, so many neighbours in a tree's order are looked at, in the groups of a set's first so many shared prefix shingles.
NEAR, PLACES = 32, 8
#: The first rounds end with one that links less than this part of what the largest has linked: whole trees find the rest in fewer rounds.
FEW = 100
#: Sets of a group that meet in one task.
BLOCK = 256
#: Rows of two numbers that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 250_000
_MANY = 0xFFFF


def prefix_length(n):
    """Shingles of which a linked partner must have one: n - ceil(0.75 n) + 1."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def _sets_of_text(column: pa.Array):
    buf, off = buffers(column)
    for lo, hi in steps(off):
        tok, at = shingle_sets(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        yield lo, hi, tok, at


def _sets_of_blob(column: pa.Array):
    buf, off = buffers(column)
    for lo, hi in steps(off, 2 << 20):
        yield lo, hi, buf[off[lo] : off[hi]].view(np.uint64) if off[hi] > off[lo] else np.zeros(0, np.uint64), (off[lo : hi + 1] - off[lo]) // 8


def _fingerprint(tok: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tok ^ np.uint64(0x5851F42D4C957F2D)))])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def _keys(tok: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each shingle: shingles that fall together here only look shared."""
    return ((tok >> np.uint64(32)) % np.uint64(n_buckets)) << np.uint64(32) | (tok & np.uint64(0xFFFFFFFF))


def _unique_in_steps(df: DataFrame, read, whole: bool, settle, schema: str) -> DataFrame:
    """df: (doc_id long, h long, content). Which of each step's shingles no other row of df has, told to settle(table of one step's rows): `meta` is what the
    step has sent to itself, and each bucket's `counts` are unique shingles by row, or with `whole` a bit for each entry (1: unique)."""
    n_buckets = partitions(df.sparkSession)

    def emit(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, hs = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, tok, at in read(batch.column(2)):
                step, n = task << 32 | seq, np.diff(at)
                seq += 1
                key = _keys(tok, n_buckets)
                order = np.argsort(key, kind="stable")
                key, row = key[order], np.repeat(np.arange(hi - lo), n)[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                many = np.diff(np.append(first, len(key))) > 1
                key, row = key[first], np.where(many, _MANY, row[first]).astype(np.uint16)
                edge = np.searchsorted(key >> np.uint64(32), np.arange(n_buckets + 1, dtype=np.uint64))
                rem = key.astype(np.uint32)
                full = np.flatnonzero(edge[1:] > edge[:-1])
                load = [rem[edge[b] : edge[b + 1]].tobytes() + row[edge[b] : edge[b + 1]].tobytes() for b in full]
                meta = b"".join(x.tobytes() for x in (ids[lo:hi].astype(np.int64), hs[lo:hi].astype(np.int64), _fingerprint(tok, at), n.astype(np.int64), known[lo:hi].astype(np.int64)))
                if whole:
                    meta = np.int64(hi - lo).tobytes() + meta + tok.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([*full.tolist(), seq % n_buckets], pa.int32()), pa.array([step] * (len(full) + 1), pa.int64()), pa.array([*full.tolist(), -1], pa.int32()), pa.array([*load, None], pa.binary()), pa.array([None] * len(full) + [meta], pa.binary())], ["bucket", "step", "part", "load", "meta"])
            release()

    def answer(t: pa.Table) -> pa.Table:
        release()
        steps_, parts, loads, metas = (t[c].to_pylist() for c in ("step", "part", "load", "meta"))
        own = [i for i, x in enumerate(loads) if x is not None]
        sizes = np.array([len(loads[i]) // 6 for i in own], np.int64)
        rem = np.concatenate([np.frombuffer(loads[i], np.uint32, n) for i, n in zip(own, sizes)]) if own else np.zeros(0, np.uint32)
        row = np.concatenate([np.frombuffer(loads[i], np.uint16, n, 4 * n) for i, n in zip(own, sizes)]) if own else np.zeros(0, np.uint16)
        order = np.argsort(rem, kind="stable")
        rem = rem[order]
        alone = np.ones(len(rem), bool)
        same = rem[1:] == rem[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        unique = np.zeros(len(rem), bool)
        unique[order] = alone
        unique &= row != _MANY
        edge = np.concatenate([[0], np.cumsum(sizes)])
        out = []
        for j, i in enumerate(own):
            flags = unique[edge[j] : edge[j + 1]]
            told = np.packbits(flags) if whole else np.bincount(row[edge[j] : edge[j + 1]][flags]).astype(np.uint16)
            out.append((steps_[i], parts[i], int(sizes[j]), told.tobytes(), None))
        out += [(s, -1, 0, None, m) for s, m in zip(steps_, metas) if m is not None]
        return pa.table([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["step", "part", "size", "counts", "meta"])

    sent = df.mapInArrow(emit, "bucket int, step long, part int, load binary, meta binary")
    told = sent.groupBy("bucket").applyInArrow(answer, "step long, part int, size int, counts binary, meta binary")
    return told.groupBy("step").applyInArrow(settle, schema)


def _unique_counts(df: DataFrame, read) -> DataFrame:
    """Rows (doc_id, h, fp, n, risky): the set's fingerprint and size, and whether few enough of its shingles are unique among df's rows for a link."""
    def settle(t: pa.Table) -> pa.Table:
        meta = next(m for m in t["meta"].to_pylist() if m is not None)
        ids, h, fp, n, known = np.frombuffer(meta, np.int64).reshape(5, -1)
        unique = np.zeros(len(n), np.int64)
        for c in t["counts"].to_pylist():
            if c is not None:
                c = np.frombuffer(c, np.uint16)
                unique[: len(c)] += c
        risky = (n > 0) & (unique < prefix_length(n))
        return pa.table([pa.array(ids, mask=known == 0), pa.array(h), pa.array(fp), pa.array(n), pa.array(risky)], ["doc_id", "h", "fp", "n", "risky"])

    return _unique_in_steps(df, read, False, settle, "doc_id long, h long, fp long, n long, risky boolean")


def _shared_sets(sets: DataFrame) -> DataFrame:
    """sets: (fp, toks). (fp, n, toks) of those that may link; toks: the shingles, ascending, that another set has too."""
    n_buckets = partitions(sets.sparkSession)

    def settle(t: pa.Table) -> pa.Table:
        meta = next(m for m in t["meta"].to_pylist() if m is not None)
        rows = int(np.frombuffer(meta, np.int64, 1)[0])
        _, fp, _, n, _ = np.frombuffer(meta, np.int64, 5 * rows, 8).reshape(5, -1)
        tok = np.frombuffer(meta, np.uint64, -1, 8 + 40 * rows)
        key = _keys(tok, n_buckets)
        order = np.argsort(key, kind="stable")
        key = key[order]
        entry = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1 if len(key) else np.zeros(0, np.int64)
        got = sorted((p, s, c) for p, s, c in zip(*(t[c].to_pylist() for c in ("part", "size", "counts"))) if c is not None)
        unique = np.concatenate([np.unpackbits(np.frombuffer(c, np.uint8), count=s) for _, s, c in got]) if got else np.zeros(0, np.uint8)
        shared = np.zeros(len(tok), bool)
        shared[order] = unique[entry] == 0
        left = np.concatenate([[0], np.cumsum(shared)])[np.concatenate([[0], np.cumsum(n)])]
        held = np.flatnonzero((n > 0) & (n - np.diff(left) < prefix_length(n)))
        tok = tok[shared]
        return pa.table([pa.array(fp[held]), pa.array(n[held]), pa.array([tok[left[i] : left[i + 1]].tobytes() for i in held], pa.binary())], ["fp", "n", "toks"])

    return _unique_in_steps(sets.select(F.lit(None).cast("long").alias("doc_id"), F.col("fp").alias("h"), "toks"), _sets_of_blob, True, settle, "fp long, n long, toks binary")


def _within(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Semi-join; small is broadcast only if it is counted to be small."""
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, "left_semi")


def _count_table(sets: DataFrame) -> np.ndarray:
    """Rows with a shingle, summed over the shingles of each of SLOTS slots: 4 MB whatever the input."""
    piece = SLOTS // 64

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            buf, _ = buffers(batch.column(0))
            tok = buf.view(np.uint64)
            for i in range(0, len(tok), 1 << 20):
                total += np.bincount((tok[i : i + (1 << 20)] >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(64)), pa.array([total[i * piece : (i + 1) * piece].astype(np.uint32).tobytes() for i in range(64)], pa.binary())], ["piece", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in t["counts"].to_pylist())
        return pa.table([t["piece"].slice(0, 1), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], ["piece", "counts"])

    got = sets.select("toks").mapInArrow(count, "piece long, counts binary").groupBy("piece").applyInArrow(add, "piece long, counts binary").toArrow().sort_by("piece")
    return np.concatenate([np.frombuffer(x, np.uint32) for x in got["counts"].to_pylist()]) if got.num_rows else np.zeros(SLOTS, np.uint32)


def _prefixes(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """(tok, place, rank, fp, n) of each set's shared prefix: its place there, and its rank among all of the set's shingles, of which the ones that
    no other set has come first, the others by rising count (in powers of two), then hash."""
    level = sets.sparkSession.sparkContext.broadcast(np.log2(1 + counts.astype(np.float64)).astype(np.uint8))

    def run(batches):
        for batch in batches:
            fp, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, tok, at in _sets_of_blob(batch.column(2)):
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                order = np.lexsort((tok, level.value[(tok >> np.uint64(44)).astype(np.int64)], row))
                place = np.arange(len(tok)) - np.repeat(at[:-1], np.diff(at))
                rank = place + np.repeat(n[lo:hi] - np.diff(at), np.diff(at))
                keep = rank < np.repeat(prefix_length(n[lo:hi]), np.diff(at))
                r = row[keep]
                yield pa.RecordBatch.from_arrays([pa.array(tok[order][keep].view(np.int64)), pa.array(place[keep].astype(np.int32)), pa.array(rank[keep].astype(np.int32)), pa.array(fp[lo:hi][r]), pa.array(n[lo:hi][r])], ["tok", "place", "rank", "fp", "n"])

    return sets.select("fp", "n", "toks").mapInArrow(run, "tok long, place int, rank int, fp long, n long")


def _by_group(rows: DataFrame, function, schema: str) -> DataFrame:
    """function(group array, record batch) over whole groups (rows of equal `g`, by size); a partition is streamed in that order, and
    only the group that a batch ends in waits for the next."""
    def run(batches):
        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([left, t]).combine_chunks() if left is not None else t
            g = t["g"].to_numpy()
            if not len(g):
                continue
            last = int(np.searchsorted(g, g[-1]))
            left = t.slice(last)
            if last:
                yield from function(g[:last], t.slice(0, last))
        if left is not None and left.num_rows:
            yield from function(left["g"].to_numpy(), left)
        release()

    return rows.repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g", "n", "fp").mapInArrow(run, schema)


def _runs(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return first, np.diff(np.append(first, len(g)))


def _near(n1, n2):
    """Sizes of which a link is possible."""
    return DENOMINATOR * np.minimum(n1, n2) >= NUMERATOR * np.maximum(n1, n2)


def group_counts(tok: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shingles of each set in each group, one byte each; 255 stands for any larger number."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    c = np.bincount(row * GROUPS + (tok >> np.uint64(55)).astype(np.int64), minlength=(len(at) - 1) * GROUPS)
    return np.minimum(c, 255).astype(np.uint8).reshape(-1, GROUPS)


def _points(column) -> np.ndarray:
    """Counts as numbers in which 255 is larger than any: a minimum with it never bounds too low."""
    buf, _ = buffers(column)
    c = buf.reshape(-1, GROUPS).astype(np.uint16)
    c[c == 255] = 60_000
    return c


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(-1, dtype=np.int64)


def _likely(a: np.ndarray, b: np.ndarray, like: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(like)], ["a", "b", "likeness"])


def _nearest(g, t):
    """(a, b, likeness) of each set's likeliest partner of another component in each group, among its neighbours in the tree's order."""
    fp, n, c = (t[x].to_numpy() for x in ("fp", "n", "component"))
    points = _points(t["counts"])
    best, with_ = np.zeros(len(fp)), np.full(len(fp), -1)
    for d in range(1, NEAR + 1):
        i = np.flatnonzero((g[d:] == g[:-d]) & (c[d:] != c[:-d]) & _near(n[d:], n[:-d])) if len(g) > d else np.zeros(0, np.int64)
        if not len(i):
            if len(g) <= d or not (g[d:] == g[:-d]).any():
                break
            continue
        for lo in range(0, len(i), 2048):
            x = i[lo : lo + 2048]
            both = _bound(points[x], points[x + d])
            like = both / (n[x] + n[x + d])
            for own, other in ((x, x + d), (x + d, x)):
                more = like > best[own]
                best[own[more]], with_[own[more]] = like[more], other[more]
    hit = np.flatnonzero(best * (NUMERATOR + DENOMINATOR) >= NUMERATOR)
    if len(hit):
        yield _likely(fp[hit], fp[with_[hit]], best[hit])


class CountRTree:
    """Two-level R-tree of group counts, bulk-loaded from points in order of set size."""

    def __init__(self, counts: np.ndarray, n: np.ndarray):
        self.counts, self.n = counts, n  # n ascending
        self.edge = np.append(np.arange(0, len(n), LEAF), len(n))
        self.high = np.maximum.reduceat(counts, self.edge[:-1], axis=0)
        self.low_n, self.high_n = n[self.edge[:-1]], n[self.edge[1:] - 1]

    def query(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Points whose overlap with a set of n shingles and counts q may be large enough, 7 * overlap >= 3 * (n + n_j), and its bounds."""
        leaves = np.flatnonzero((NUMERATOR * self.low_n <= DENOMINATOR * n) & (DENOMINATOR * self.high_n >= NUMERATOR * n))
        bound = _bound(q, self.high[leaves])
        leaves = leaves[(NUMERATOR + DENOMINATOR) * bound >= NUMERATOR * (n + np.maximum(self.low_n[leaves], -(-NUMERATOR * n // DENOMINATOR)))]
        if not len(leaves):
            return leaves, leaves
        at = np.concatenate([np.arange(self.edge[k], self.edge[k + 1]) for k in leaves])
        at = at[_near(self.n[at], n)]
        bound = _bound(q, self.counts[at])
        ok = (NUMERATOR + DENOMINATOR) * bound >= NUMERATOR * (n + self.n[at])
        return at[ok], bound[ok]


def _found(g, t):
    """For each set outside its group's largest component, the places of all points of other components that the R-tree leaves, and their bounds. The first
    shingle that two linked sets share comes early in both: at most n - overlap shingles are before it, so in later groups the pair needn't be found again."""
    n, c, main, rank = (t[x].to_numpy() for x in ("n", "component", "main", "rank"))
    points = _points(t["counts"])
    for lo, size in zip(*_runs(g)):
        foreign = np.flatnonzero(c[lo : lo + size] != main[lo])
        if not len(foreign) or (c[lo : lo + size] == c[lo]).all():
            continue
        tree = CountRTree(points[lo : lo + size], n[lo : lo + size])
        for i in foreign + lo:
            at, bound = tree.query(points[i], n[i])
            at = at + lo
            least = -(-NUMERATOR * (n[i] + n[at]) // (NUMERATOR + DENOMINATOR))
            ok = (c[at] != c[i]) & (rank[i] <= n[i] - least) & (rank[at] <= n[at] - least)
            if ok.any():
                yield i, at[ok], bound[ok]


def _best(g, t):
    """(a, b, likeness) of the likeliest partner that _found has for each set and group, and (a, null, null) of every set that is some set's partner."""
    fp, n = t["fp"].to_numpy(), t["n"].to_numpy()
    out, met = [], np.zeros(len(fp), bool)
    for i, at, bound in _found(g, t):
        like = bound / (n[i] + n[at])
        k = like.argmax()
        out.append((fp[i], fp[at[k]], like[k]))
        met[at] = True
    if out:
        a, b, like = (np.array(x) for x in zip(*out))
        yield _likely(a, b, like)
        a = np.unique(fp[met])
        yield _likely(a, pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.float64()))


def _every(g, t):
    """(a, b) of all pairs that _found has."""
    fp = t["fp"].to_numpy()
    a, b = [], []
    for i, at, _ in _found(g, t):
        a.append(np.full(len(at), fp[i]))
        b.append(fp[at])
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _counts(sets: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, hi, tok, at in _sets_of_blob(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in group_counts(tok, at)], pa.binary())], ["fp", "counts"])

    return sets.select("fp", "toks").mapInArrow(run, "fp long, counts binary")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sizes and shared shingles."""
    def run(batches):
        for batch in batches:
            n1, n2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            x, xo = buffers(batch.column(4))
            y, yo = buffers(batch.column(5))
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = x[xo[i] : xo[i + 1]].view(np.uint64), y[yo[i] : yo[i + 1]].view(np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                ok[i] = DENOMINATOR * both >= NUMERATOR * (n1[i] + n2[i] - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])
            release()

    x = pairs.join(sets.select(F.col("fp").alias("a"), F.col("n").alias("n1"), F.col("toks").alias("x")), "a")
    x = x.join(sets.select(F.col("fp").alias("b"), F.col("n").alias("n2"), F.col("toks").alias("y")), "b")
    return x.select("a", "b", "n1", "n2", "x", "y").mapInArrow(run, "a long, b long")


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (fp, component; a set that names its component has no row) after links between sets: components are contracted first."""
    if labels is None:
        return components(links).withColumnRenamed("node", "fp")
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("fp").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(end, F.coalesce(f"of_{end}", end)).drop(f"of_{end}")
    moved = components(links).select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = labels.join(moved, "component", "left").select("fp", F.coalesce("to", "component").alias("component"))
    out = materialize(known.unionByName(moved.select(F.col("component").alias("fp"), F.col("to").alias("component"))), "labels")
    discard(moved, labels)
    return out


def _dealt(shared: DataFrame, labels: DataFrame | None, counts: DataFrame, turn: int | None) -> DataFrame | None:
    """Rows (g, ..., component, counts) of the groups in which components meet, or None if there is no such group. turn: the number of a first round, which deals
    large groups by a hash; else every set outside its group's largest component (`main`) goes to each of its group's blocks."""
    named = shared.withColumn("component", F.col("fp")) if labels is None else shared.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    if turn is not None:
        named = named.where(F.col("place") < PLACES)
    named = materialize(named, "named")
    each = named.groupBy("tok", "component").agg(F.count("*").alias("c")).groupBy("tok")
    mixed = each.agg(F.count("*").alias("kinds"), F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("m")).where("kinds > 1")
    rows = materialize(named.join(mixed.select("tok", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.col("m.component").alias("main")), "tok"), "rest")
    discard(named)
    if rows.isEmpty():
        discard(rows)
        return None
    own = F.pmod(F.xxhash64("fp", F.lit(turn or 0)), "blocks").cast("int")
    block = own if turn is not None else F.explode(F.when(F.col("component") == F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rows.withColumn("block", block).select(F.xxhash64("tok", "block").alias("g"), "fp", "n", "component", "main", "rank")
    out = dealt.join(counts, "fp")
    out._ferrule_path = rows._ferrule_path
    return out


def _linked(sets: DataFrame) -> DataFrame:
    """(fp, component) of the sets that link, but for those that name their component."""
    prefix = materialize(_prefixes(sets, _count_table(sets)), "prefix")
    shared = materialize(prefix.join(prefix.groupBy("tok").agg(F.count("*").alias("size")).where("size > 1").select("tok"), "tok", "left_semi"), "shared")
    discard(prefix)
    counts = materialize(_counts(sets.join(shared.select("fp").distinct(), "fp", "left_semi")), "counts")
    labels, turn, rounds, left, most, within = None, 0, [(_nearest, True), (_best, False)], True, 0, shared
    while rounds and left:
        function, first = rounds[0]
        rows, links = _dealt(within, labels, counts, turn if first else None), None
        turn += 1
        if rows is not None:
            likely = _by_group(rows, function, "a long, b long, likeness double")
            if not first:  # components only grow: who has no possible partner now has none later
                likely = materialize(likely, "likely")
                met = materialize(within.join(likely.select(F.col("a").alias("fp")).distinct(), "fp", "left_semi"), "met")
                if within is not shared:
                    discard(within)
                within = met
            forest = materialize(likely.where("b is not null").groupBy("a").agg(F.max(F.struct("likeness", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct(), "forest")
            discard(rows, None if first else likely)
            left = first or not forest.isEmpty()
            links = materialize(_verify(forest, sets), "links") if not forest.isEmpty() else None
            discard(forest)
        else:
            left = first
        n = links.count() if links is not None else 0
        if n:
            labels = _relabel(labels, links)
        discard(links)
        most = max(most, n)
        if n <= (most // FEW if first else 0):  # look over whole trees, then at each pair
            rounds.pop(0)
    rows = _dealt(within, labels, counts, None) if left else None
    if rows is not None:
        links = materialize(_verify(_by_group(rows, _every, "a long, b long").distinct(), sets), "links")
        discard(rows)
        labels = labels if links.isEmpty() else _relabel(labels, links)
        discard(links)
    discard(shared, counts, None if within is shared else within)
    return labels if labels is not None else sets.sparkSession.createDataFrame([], "fp long, component long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    given = docs.select(doc_id, F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    seen = materialize(_unique_counts(given, _sets_of_text), "seen")
    # of equal sets, one row's text is read again
    chosen = seen.where("risky").groupBy("fp").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), "h")).alias("x")).select("fp", "x.k", "x.h")
    again = _within(given.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63)))), materialize(chosen.select("k", "h"), "chosen"), ["k", "h"])

    def sets(batches):
        for batch in batches:
            for _, _, tok, at in _sets_of_text(batch.column(0)):
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays([pa.array(_fingerprint(tok, at)), pa.array(n), pa.array([tok[at[i] : at[i + 1]].tobytes() for i in range(len(n))], pa.binary())], ["fp", "n", "toks"])

    wide = materialize(again.select("text").mapInArrow(sets, "fp long, n long, toks binary").dropDuplicates(["fp"]), "sets")
    held = materialize(_shared_sets(wide), "held")
    discard(wide)
    named = _linked(held)
    discard(held)
    risky = seen.where("risky").join(named, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = risky.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = risky.join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(seen.where("not risky").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
