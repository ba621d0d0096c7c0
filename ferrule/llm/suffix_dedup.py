"""Suffix-array dedup: removes every byte that a 200-byte string covers which also starts anywhere else.

1. Every 200-byte window has one anchor: the 64-byte gram in it with the least hash, the leftmost of equals. Equal windows have
   equal anchors, so windows that can be equal meet in their anchor's group. Consecutive windows with one anchor are one context: the
   bytes they cover, 336 at most. Anchors go to buckets in packed blobs (a context that recurs in a step of about 1 MB
   is one entry, so a hot one costs one entry a step), and each step is told which of its contexts are alone (anchor seen
   once), whole (the same context occurs elsewhere: pre-aggregated to one string with multiplicity) or mixed (their group has different contexts).
2. Only groups with different contexts need suffix order. Their contexts are dealt by anchor and gathered in units; a unit is two
   or more shards, each with the Burrows-Wheeler transform of its own contexts over an alphabet of 40-byte blocks (the symbol before suffix
   p is the block that starts at p - 40). Shards are merged two by two by refining their interleave: pass h takes the interleave that is
   right for h blocks, pulls each suffix's preceding block and deals the shard bits into the blocks' buckets (two passes over 16-bit digits, no
   comparison), which is right for h + 1. No suffix is sorted again. The classes met on the way give the common prefix in blocks; after 5 passes (200 bytes) the classes of two or more
   occurrences are the repeated intervals.
3. Window starts in repeated intervals, and those of whole contexts, become byte spans of each text.

Texts are known by two 64-bit hashes of their bytes, contexts and blocks by 64-bit hashes. Cases: a null text is empty; texts below 200 bytes keep all;
equal texts of 200 bytes or more lose all; overlapping repeats (one byte a thousand times) count; null or repeated doc_ids
are rows of their own; an empty table gives no rows; extra columns pass by.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LUT, buffers, materialize, mix, partitions, release, spans_hash, steps

WINDOW, GRAM, BLOCK = 200, 64, 40
PASSES = WINDOW // BLOCK
STEP, UNIT = 1 << 20, 1 << 19
#: Bits of an anchor's comparison key that hold its place: texts and steps up to 256 MB.
_POSITION = 28


def _grams(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position; only the first len - GRAM + 1 hold."""
    h = _LUT[buf]
    for width, factor in zip((1, 2, 4, 8, 16, 32), (0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
        h[:-width] = h[:-width] * np.uint64(factor) + h[width:]
    return mix(h)


def contexts(buf: np.ndarray, off: np.ndarray):
    """Of rows' windows: per context row, first start, number of starts, anchor hash, context hash (in text order)."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    g = _grams(buf)
    bits = np.uint64(max(_POSITION, n.bit_length()))
    x = (g >> bits << bits) | np.arange(n, dtype=np.uint64)
    span, reach = 1, WINDOW - GRAM + 1
    while span * 2 <= reach:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < reach:
        x = np.minimum(x[: len(x) - (reach - span)], x[reach - span :])
    anchor = (x[: n - WINDOW + 1] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    start = np.arange(n - WINDOW + 1)
    row = np.searchsorted(off, start, side="right") - 1
    ok = start + WINDOW <= off[row + 1]
    start, anchor, row = start[ok], anchor[ok], row[ok]
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    count = np.diff(np.append(new, len(start)))
    first, anchor, row = start[new], anchor[new], row[new]
    whole = spans_hash(_LUT[buf], first, first + count - 1 + WINDOW)
    return row, first - off[row], count, g[anchor], mix(whole + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(11), text, F.octet_length(text))})


def _seen(given: DataFrame) -> DataFrame:
    """given: (k1, k2, text). For texts with a context that isn't alone: `full`, the (start, starts) of whole contexts, and `emit`, the
    (anchor, start, starts, several) of mixed ones."""
    n_buckets = partitions(given.sparkSession)

    def emit(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            buf, off = buffers(batch.column(2))
            for lo, hi in steps(off, STEP):
                row, first, count, anchor, ctx = contexts(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                if not len(row):
                    continue
                step, seq = task << 32 | seq, seq + 1
                bucket, rem = (anchor >> np.uint64(32)) % np.uint64(n_buckets), anchor & np.uint64(0xFFFFFFFF)
                key = bucket << np.uint64(32) | rem
                order = np.lexsort((ctx, key))
                key_s, ctx_s = key[order], ctx[order]
                new = np.concatenate([[True], (key_s[1:] != key_s[:-1]) | (ctx_s[1:] != ctx_s[:-1])])
                entry = np.empty(len(order), np.int64)
                entry[order] = np.cumsum(new) - 1
                at = np.flatnonzero(new)
                times = np.minimum(np.diff(np.append(at, len(order))), 2).astype(np.uint8)
                key_s, ctx_s = key_s[at], ctx_s[at]
                edge = np.searchsorted(key_s >> np.uint64(32), np.arange(n_buckets + 1, dtype=np.uint64))
                full = np.flatnonzero(edge[1:] > edge[:-1])
                rem = key_s.astype(np.uint32)
                load = [rem[a:b].tobytes() + ctx_s[a:b].tobytes() + times[a:b].tobytes() for a, b in zip(edge[full], edge[full + 1])]
                meta = np.array([hi - lo, len(row)], np.int64).tobytes() + b"".join(x.tobytes() for x in (k1[lo:hi].astype(np.int64), k2[lo:hi].astype(np.int64), anchor, row.astype(np.int32), first.astype(np.int32), entry.astype(np.int32), count.astype(np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array([*full.tolist(), seq % n_buckets], pa.int32()), pa.array([step] * (len(full) + 1), pa.int64()), pa.array([*full.tolist(), -1], pa.int32()), pa.array([*load, meta], pa.binary())], ["bucket", "step", "part", "load"])
            release()

    def answer(t: pa.Table) -> pa.Table:
        release()
        steps_, parts, loads = (t[c].to_pylist() for c in ("step", "part", "load"))
        own = [i for i, p in enumerate(parts) if p >= 0]
        m = [len(loads[i]) // 13 for i in own]
        rem = np.concatenate([np.frombuffer(loads[i], np.uint32, k) for i, k in zip(own, m)]) if own else np.zeros(0, np.uint32)
        ctx = np.concatenate([np.frombuffer(loads[i], np.uint64, k, 4 * k) for i, k in zip(own, m)]) if own else np.zeros(0, np.uint64)
        times = np.concatenate([np.frombuffer(loads[i], np.uint8, k, 12 * k) for i, k in zip(own, m)]).astype(np.int64) if own else np.zeros(0, np.int64)
        order = np.lexsort((ctx, rem))
        r, c, w = rem[order], ctx[order], times[order]
        new_r = np.ones(len(r), bool)
        new_r[1:] = r[1:] != r[:-1]
        new_c = new_r.copy()
        new_c[1:] |= c[1:] != c[:-1]
        code = np.zeros(len(r), np.uint8)
        if len(r):
            kind = np.cumsum(new_c) - 1
            group = np.cumsum(new_r) - 1
            several = (np.bincount(kind, weights=w) >= 2)[kind]
            group_of_kind = group[new_c]
            kinds = np.bincount(group_of_kind)
            lonely = np.bincount(group, weights=~several) > 0
            mixed = (kinds[group] > 1) & lonely[group]
            code[order] = several * 1 + mixed * 2
        edge = np.concatenate([[0], np.cumsum(m)]).astype(np.int64)
        out = [(steps_[i], parts[i], code[edge[j] : edge[j + 1]].tobytes()) for j, i in enumerate(own)] + [(steps_[i], -1, loads[i]) for i, p in enumerate(parts) if p < 0]
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["step", "part", "load"])

    def settle(t: pa.Table) -> pa.Table:
        got = dict(zip(t["part"].to_pylist(), t["load"].to_pylist()))
        meta = got.pop(-1)
        rows, m = np.frombuffer(meta, np.int64, 2)
        at, out = 16, []
        for kind, n in ((np.int64, rows), (np.int64, rows), (np.uint64, m), (np.int32, m), (np.int32, m), (np.int32, m), (np.uint8, m)):
            out.append(np.frombuffer(meta, kind, n, at))
            at += n * np.dtype(kind).itemsize
        k1, k2, anchor, row, first, entry, count = out
        code = np.frombuffer(b"".join(got[p] for p in sorted(got)), np.uint8)[entry]
        hit = np.flatnonzero(np.bincount(row[code > 0], minlength=rows))
        full, emit_ = [], []
        for i in hit:
            own = slice(*np.searchsorted(row, [i, i + 1]))
            c = code[own]
            whole, mixed = (c & 1) > 0, c >= 2
            full.append(np.stack([first[own][whole], count[own][whole].astype(np.int32)], 1).astype(np.int32).tobytes())
            emit_.append(np.stack([anchor[own][mixed].view(np.int64), first[own][mixed].astype(np.int64), count[own][mixed].astype(np.int64), (c[mixed] & 1).astype(np.int64)], 1).tobytes())
        return pa.table([pa.array(k1[hit]), pa.array(k2[hit]), pa.array(full, pa.binary()), pa.array(emit_, pa.binary())], ["k1", "k2", "full", "emit"])

    told = given.mapInArrow(emit, "bucket int, step long, part int, load binary").groupBy("bucket").applyInArrow(answer, "step long, part int, load binary")
    return told.groupBy("step").applyInArrow(settle, "k1 long, k2 long, full binary, emit binary")


class Shard:
    """The block-wise Burrows-Wheeler transform of some contexts: suffix order, the block before each suffix (-1: none), and the blocks of
    the suffixes shorter than a block after them (`tail`, in text order)."""

    def __init__(self, order: np.ndarray, before: np.ndarray, tail: np.ndarray):
        self.order, self.before, self.tail = order, before, tail


def _deal(symbol: np.ndarray) -> np.ndarray:
    """Places in the order of small non-negative numbers, equal ones in their own order: dealt by their low 16 bits, then by the high ones."""
    order = np.argsort((symbol & 0xFFFF).astype(np.uint16), kind="stable")  # of 16-bit numbers: a radix pass
    high = (symbol >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if len(high) and high.max() else order


def build_shard(symbol: np.ndarray, has_next: np.ndarray, ids: np.ndarray, previous: np.ndarray) -> Shard:
    """ids: the suffixes (positions of a unit's bytes) of this shard, in text order. symbol: block rank at each position;
    has_next: whether position + BLOCK is in the same context; previous: position - BLOCK or -1."""
    order = ids
    tails = ids[~has_next[ids]]
    for _ in range(PASSES):
        p = previous[order]
        p = np.concatenate([tails, p[p >= 0]])
        order = p[_deal(symbol[p])]
    p = previous[order]
    return Shard(order, np.where(p >= 0, symbol[np.maximum(p, 0)], -1), symbol[tails])


def merge(a: Shard, b: Shard) -> tuple[Shard, np.ndarray]:
    """The transform of both shards' contexts, and the class of each merged suffix by its first PASSES blocks (equal classes: equal
    blocks). Only shard bits and classes move; each shard's own order stands."""
    from_b = np.concatenate([np.zeros(len(a.order), bool), np.ones(len(b.order), bool)])
    virtual = np.concatenate([np.zeros(len(a.tail), bool), np.ones(len(b.tail), bool)])
    tails = np.concatenate([a.tail, b.tail])
    klass = np.zeros(len(from_b), np.int64)
    for depth in range(PASSES):
        pulled = np.empty(len(from_b), a.before.dtype)
        pulled[~from_b], pulled[from_b] = a.before, b.before
        has = pulled >= 0
        block = np.concatenate([tails, pulled[has]])
        bit = np.concatenate([virtual, from_b[has]])
        # one block is the same whether the text ends after it or not; more blocks are not
        after = np.concatenate([np.full(len(tails), -1 if depth else 0), klass[has]])
        to = _deal(block)
        from_b, block, after = bit[to], block[to], after[to]
        klass = np.cumsum(np.concatenate([[0], (block[1:] != block[:-1]) | (after[1:] != after[:-1])]))
    order = np.empty(len(from_b), np.int64)
    before = np.empty(len(from_b), a.before.dtype)
    order[~from_b], order[from_b] = a.order, b.order
    before[~from_b], before[from_b] = a.before, b.before
    return Shard(order, before, tails), klass


def repeated(buf: np.ndarray, size: np.ndarray, weights: np.ndarray, shards: int = 2) -> np.ndarray:
    """For each byte of the contexts in buf, one after another, whether the WINDOW bytes from it (they must lie in its context) occur twice at least in
    all contexts, weights counted."""
    edge = np.concatenate([[0], np.cumsum(size)])
    pos = np.arange(len(buf), dtype=np.int32)
    text = np.repeat(np.arange(len(size), dtype=np.int32), size)
    left = (edge[1:].astype(np.int32))[text] - pos
    width = np.minimum(left, BLOCK)
    block = spans_hash(_LUT[buf], pos, pos + width) + width.astype(np.uint64)
    symbol = np.unique(block, return_inverse=True)[1].astype(np.int32)
    del block, width
    has_next = left > BLOCK
    previous = np.where(pos - BLOCK >= (edge[:-1].astype(np.int32))[text], pos - BLOCK, np.int32(-1))
    cuts = np.searchsorted(edge, np.linspace(0, len(buf), min(shards, len(size)) + 1)[1:-1])
    cuts = np.unique(np.concatenate([[0], edge[cuts], [len(buf)]]))
    parts = [build_shard(symbol, has_next, pos[a:b], previous) for a, b in zip(cuts[:-1], cuts[1:])]
    if len(parts) == 1:
        parts.append(build_shard(symbol, has_next, pos[:0], previous))
    del symbol, has_next, previous, left
    while len(parts) > 1:
        nxt, klass = [], None
        for i in range(0, len(parts) - 1, 2):
            merged, klass = merge(parts[i], parts[i + 1])
            nxt.append(merged)
        parts = nxt + parts[len(parts) // 2 * 2 :]
    order = parts[0].order
    total = np.bincount(klass, weights=weights[text[order]])
    twice = np.zeros(len(buf), bool)
    twice[order] = total[klass] >= 2
    return twice


def _unit(t: pa.Table) -> pa.RecordBatch | None:
    """Spans (k1, k2, spans) of the rows of whole anchor groups. Equal contexts are one string with their summed weight."""
    buf, off = buffers(t["bytes"])
    first, count, several = (t[c].to_numpy() for c in ("first", "count", "several"))
    size = np.diff(off)
    known = mix(spans_hash(_LUT[buf], off[:-1], off[1:]) + t["anchor"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    _, own, kind = np.unique(known, return_index=True, return_inverse=True)
    weights = np.bincount(kind, weights=1 + several)
    at = np.concatenate([[0], np.cumsum(size[own])])
    twice = repeated(buf[np.repeat(off[own] - at[:-1], size[own]) + np.arange(at[-1])], size[own], weights)
    # runs of repeated window starts in each kind of context; what lies after its starts is no start
    start = np.arange(at[-1]) - np.repeat(at[:-1], size[own])
    twice &= start < np.repeat(count[own], size[own])
    lead, stop = twice.copy(), twice.copy()
    lead[1:] &= ~twice[:-1] | (start[1:] == 0)
    stop[:-1] &= ~twice[1:] | (start[1:] == 0)
    lead, stop = np.flatnonzero(lead), np.flatnonzero(stop) + 1
    per = np.bincount(np.searchsorted(at, lead, side="right") - 1, minlength=len(own))
    run = np.concatenate([[0], np.cumsum(per)])
    hit = np.flatnonzero(per[kind])
    if not len(hit):
        return None
    n = per[kind[hit]]
    to = np.concatenate([[0], np.cumsum(n)])
    pick = np.repeat(run[kind[hit]] - to[:-1], n) + np.arange(to[-1])
    spans = np.stack([start[lead[pick]] + np.repeat(first[hit], n), stop[pick] - lead[pick]], 1).astype(np.int32)
    blobs = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer((to * 8).astype(np.int32)), pa.py_buffer(spans)])
    return pa.RecordBatch.from_arrays([t["k1"].combine_chunks().take(pa.array(hit)), t["k2"].combine_chunks().take(pa.array(hit)), blobs], ["k1", "k2", "spans"])


def _solve(batches):
    """(anchor, k1, k2, first, count, several, bytes) sorted by anchor -> (k1, k2, spans). Whole anchor groups are gathered to units."""
    left = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([left, t]).combine_chunks() if left is not None else t
        if not t.num_rows:
            continue
        anchor, done = t["anchor"].to_numpy(), 0
        size = np.cumsum(np.diff(buffers(t["bytes"])[1]))
        ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1  # of all groups but the last
        while True:
            k = np.searchsorted(size[ends - 1], (size[done - 1] if done else 0) + UNIT) if len(ends) else 0
            if k >= len(ends):
                break
            out = _unit(t.slice(done, ends[k] - done))
            done = int(ends[k])
            if out is not None:
                yield out
            release()
        left = t.slice(done)
    if left is not None and left.num_rows:
        out = _unit(left)
        if out is not None:
            yield out
    release()


def _emit(batches):
    """Mixed contexts with their bytes. One that is known to occur several times only serves as a partner, so a task emits it once."""
    done: set = set()
    for batch in batches:
        buf, off = buffers(batch.column(2))
        raw = memoryview(np.ascontiguousarray(buf))
        rows = []
        for i, (k1, k2, blob) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
            for anchor, first, count, several in np.frombuffer(blob, np.int64).reshape(-1, 4).tolist():
                a = int(off[i]) + first
                text = bytes(raw[a : a + count - 1 + WINDOW])
                if several:
                    if (anchor, text) in done:
                        continue
                    if len(done) >= 20_000:
                        done.clear()
                    done.add((anchor, text))
                rows.append((anchor, k1, k2, first, count, several, text))
            if len(rows) > 4000 or i == batch.num_rows - 1:
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["anchor", "k1", "k2", "first", "count", "several", "bytes"])
                rows = []


def _joined(docs: DataFrame, small: DataFrame, how: str) -> DataFrame:
    """Texts with their rows of small (k1, k2, ...). What small holds grows with the corpus, so it is never broadcast by hand: both sides are dealt by the
    text's hashes, at any size."""
    return docs.join(small.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}).hint("merge"), ["__k1", "__k2"], how)


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(k1, k2, spans) of the texts that lose something; spans: int32 pairs (first window start, number of starts)."""
    given = keyed.where(F.octet_length("text") >= WINDOW)
    seen = _seen(given.select("__k1", "__k2", "text"))
    # equal texts answer alike: one row each
    seen = materialize(seen.groupBy("k1", "k2").agg(F.min(F.struct("full", "emit")).alias("x")).select("k1", "k2", "x.full", "x.emit"), "seen")
    mixed = seen.where(F.octet_length("emit") > 0).select("k1", "k2", "emit")
    rows = _joined(given.select("__k1", "__k2", "text"), mixed, "inner").select("__k1", "__k2", "text", "emit").mapInArrow(_emit, "anchor long, k1 long, k2 long, first int, count int, several int, bytes binary")
    rows = rows.repartition(partitions(keyed.sparkSession), "anchor").sortWithinPartitions("anchor")
    part = rows.mapInArrow(_solve, "k1 long, k2 long, spans binary")
    both = seen.where(F.octet_length("full") > 0).select("k1", "k2", F.col("full").alias("spans")).unionByName(part)
    return materialize(both.groupBy("k1", "k2").agg(F.array_distinct(F.collect_list("spans")).alias("s")).select("k1", "k2", F.expr("aggregate(s, X'', (a, b) -> a || b)").alias("spans")), "spans")


def _removed(spans: bytes | None, n: int) -> np.ndarray:
    """Maximal removed byte runs (start, end) of a text of n bytes."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    x = np.frombuffer(spans, np.int32).reshape(-1, 2).astype(np.int64)
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, x[:, 0], 1)
    np.add.at(delta, x[:, 0] + x[:, 1] - 1 + WINDOW, -1)
    return _runs_of_cover(np.cumsum(delta[:-1]) > 0)


def _runs_of_cover(cover: np.ndarray) -> np.ndarray:
    x = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
    return np.stack([x[::2], x[1::2]], 1)


def without_repeats(docs: DataFrame, characters: bool = False) -> DataFrame:
    """docs (with doc_id and text) with n_bytes, n_removed, n_spans, kept_sha256 and `kept`, the remaining bytes. `characters`: spans
    shrink to whole UTF-8 characters, so that kept is text again."""
    keyed = _keyed(docs)
    spans = repeated_spans(keyed)
    given = _joined(keyed, spans.withColumnRenamed("spans", "__spans"), "left")
    own = [f for f in docs.schema if f.name not in ("text", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")]
    cols = [f"`{f.name}`" for f in own]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own) + "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches):
        for batch in batches:
            buf, off = buffers(batch.column(0))
            blobs = batch.column(1).to_pylist()
            out = []
            for i, blob in enumerate(blobs):
                raw = buf[off[i] : off[i + 1]]
                gone = _removed(blob, len(raw))
                if characters and len(gone):
                    inside = (raw & 0xC0) == 0x80
                    fixed = []
                    for a, b in gone.tolist():
                        while a < b and inside[a]:
                            a += 1
                        while b > a and b < len(raw) and inside[b]:
                            b -= 1
                        if b > a:
                            fixed.append((a, b))
                    gone = np.array(fixed, np.int64).reshape(-1, 2)
                kept, at = [], 0
                for a, b in gone.tolist():
                    kept.append(raw[at:a].tobytes())
                    at = b
                kept = b"".join([*kept, raw[at:].tobytes()])
                out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            x = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.array(v, kind) for v, kind in zip(x, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], [*(f.name for f in own), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return given.select("text", "__spans", *cols).mapInArrow(run, schema)
