"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text's bytes are cut before each blank that follows something else (no piece of the vocabulary spans such a place), and each
distinct segment of a step gets its lattice once: a walk of all places at once down a byte trie finds the pieces, and a forward
pass gives every place the log of the summed weight of all its segmentations. Backward, every occurrence draws its own
last piece, the one before, and so on, in proportion to forward weights; the draws come from a counter hash of (row key,
segment, draw), so that a row's result depends on its key, its text and the seed alone, and not on partitions or retries.

Pieces hold a blank where the vocabulary writes U+2581; every byte has a byte piece, so a text's own U+2581, line
breaks and any other character survive: decoding gives the very bytes back.

Cases: null and empty texts have no pieces; a null key is a key of its own; equal rows with equal keys get equal pieces; very long
segments are handled place by place; bytes that aren't valid UTF-8 are byte pieces and come back as they were; a model with a piece that holds a blank
after another character is rejected (a text is cut there); an empty table gives no rows; extra columns pass by.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LUT, buffers, mix, release, spans_hash, steps

_models: dict = {}


class Vocabulary:
    """Byte trie and weights of a SentencePiece model. The log-weight of a piece is its score if scores are log-probabilities, and
    -log(2 - score) if they are merge ranks (a BPE model); a byte piece weighs less than any other."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, np.int32)
        logw = np.zeros(n)
        plain = []
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
                self.byte_ids[self.bytes[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = sp.id_to_piece(i).replace("▁", " ").encode()
                if b" " in raw.lstrip(b" "):
                    raise ValueError(f"piece {i} holds a blank after another character: texts can't be cut there")
                self.bytes[i] = raw
                plain.append(i)
                logw[i] = sp.get_score(i)
        ranks = min(logw[plain]) < -1000
        logw[plain] = -np.log(2 - logw[plain]) if ranks else logw[plain]
        self.floor = float(min(logw[plain]) - 4)
        self.logw = logw
        # children of each inner node in a dense row; node 0 is the root
        nodes: list[dict] = [{}]
        ends: list[int] = [-1]
        for i in plain:
            at = 0
            for b in self.bytes[i]:
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = nodes[at][b]
            ends[at] = i
        self.piece = np.array(ends, np.int32)
        inner = [j for j, kids in enumerate(nodes) if kids]
        self.row = np.full(len(nodes), -1, np.int32)  # where an inner node's row of children starts
        self.row[inner] = np.arange(len(inner)) * 256
        self.child = np.full(len(inner) * 256, -1, np.int32)
        for r, j in enumerate(inner):
            self.child[r * 256 + np.array(list(nodes[j]))] = list(nodes[j].values())
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    @staticmethod
    def load(path: str) -> "Vocabulary":
        if path not in _models:
            _models[path] = Vocabulary(path)
        return _models[path]

    def lattice(self, buf: np.ndarray, off: np.ndarray):
        """Lattices of segments, longest first. Node i of segment s is off[s] + s + i. Edges are sorted by end node, then by length, so their
        order doesn't depend on the other segments: source node, piece, and a whole number: the node's in the upper bits, and in the lower 32 the edge's
        share of its end node's weight, summed up over the node's edges so far, so that no bit of it depends on other nodes."""
        n, segs = len(buf), len(off) - 1
        size = np.diff(off)
        seg = np.repeat(np.arange(segs, dtype=np.int32), size)
        stop = off[1:].astype(np.int32)[seg]
        start = np.arange(n, dtype=np.int32)
        base = np.zeros(n, np.int32)
        # (end node, length, 1 for a byte piece) is one number and no two edges share it
        keys, ids = [(start.astype(np.int64) + seg + 1) << 8 | 3], [self.byte_ids[buf]]
        at = start
        while len(start):
            state = self.child.take(base + buf.take(at))
            ok = np.flatnonzero(state >= 0)
            start, state, at = start.take(ok), state.take(ok), at.take(ok) + np.int32(1)
            piece = self.piece.take(state)
            hit = np.flatnonzero(piece >= 0)
            own, end = start.take(hit), at.take(hit)
            keys.append((end.astype(np.int64) + seg.take(own)) << 8 | (end - own) << 1)
            ids.append(piece.take(hit))
            base = self.row.take(state)
            go = np.flatnonzero((at < stop.take(start)) & (base >= 0))
            start, base, at = start.take(go), base.take(go), at.take(go)
        del seg, stop  # what edges no longer need is let go of at once: a worker's peak is here
        key = np.concatenate(keys)
        del keys
        order = np.argsort(key)
        key = key.take(order)
        ids = np.concatenate(ids).take(order)
        del order
        w = np.where(key & 1, self.floor, self.logw.take(ids))
        dst = (key >> 8).astype(np.int32)
        src = dst - ((key & 255) >> 1).astype(np.int32)
        del key
        first = np.searchsorted(dst, np.arange(n + segs + 1, dtype=np.int32))
        alpha, share = np.zeros(n + segs), np.empty(len(src))
        root = off[:-1] + np.arange(segs)
        alive = np.searchsorted(-size, -np.arange(1, (size[0] if segs else 0) + 1), side="right")
        for level, m in enumerate(alive.tolist(), 1):
            node = root[:m] + level
            per = first[node + 1] - first[node]
            cut = np.cumsum(per) - per
            e = np.repeat(first[node] - cut, per) + np.arange(cut[-1] + per[-1])
            x = alpha.take(src.take(e)) + w.take(e)
            top = np.maximum.reduceat(x, cut)
            x = np.exp(x - np.repeat(top, per))
            total = np.add.reduceat(x, cut)
            alpha[node] = top + np.log(total)
            share[e] = x / np.repeat(total, per)
        del w, alpha, first
        lead = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if n else np.zeros(0, np.int64)
        per = np.diff(np.append(lead, len(dst)))
        for j in range(1, int(per.max()) if n else 0):  # summed within each node, edge by edge
            e = lead[per > j] + j
            share[e] += share[e - 1]
        cum = (dst.astype(np.int64) << 32) + np.minimum(share * 2.0**32, 2.0**32 - 1).astype(np.int64)
        cum[lead + per - 1] = (dst[lead].astype(np.int64) + 1) << 32
        return src, ids, cum

    def sample(self, buf: np.ndarray, off: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of rows, and len + 1 offsets. keys: a 64-bit word of each row."""
        rows, n = len(off) - 1, len(buf)
        if not n:
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        blank = buf == 32
        cut = np.zeros(n, bool)
        cut[1:] = blank[1:] & ~blank[:-1]
        cut[off[:-1][off[:-1] < n]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        row = np.searchsorted(off, start, side="right") - 1
        _, index, kind = np.unique(spans_hash(_LUT[buf], start, end), return_index=True, return_inverse=True)
        size = (end - start)[index]
        longest = np.argsort(-size, kind="stable")
        place = np.empty(len(size), np.int64)
        place[longest] = np.arange(len(size))
        index, size, kind = index[longest], size[longest], place[kind]
        seg_off = np.concatenate([[0], np.cumsum(size)])
        seg_buf = buf[np.repeat(start[index] - seg_off[:-1], size) + np.arange(seg_off[-1])]
        src, ids, cum = self.lattice(seg_buf, seg_off)
        first_of_row = np.searchsorted(row, np.arange(rows))
        ordinal = (np.arange(len(row)) - first_of_row[row]).astype(np.uint64)
        stream = mix(keys[row] + np.uint64(seed)) + ordinal * np.uint64(0x9E3779B97F4A7C15)
        root = seg_off[:-1] + np.arange(len(size))
        occ = np.argsort(kind, kind="stable")  # equal segments side by side: draws look up neighbouring edges
        node = (root + size)[kind[occ]]
        root = root[kind]
        drawn, who = [], []
        k = 0
        while len(occ):
            u = (mix(stream[occ] + np.uint64(k * 0xD1B54A32D192ED03 % (1 << 64))) >> np.uint64(32)).astype(np.int64)
            e = np.searchsorted(cum, (node.astype(np.int64) << 32) + u, side="right")
            drawn.append(ids[e])
            who.append(occ)
            node = src[e]
            go = np.flatnonzero(node > root[occ])
            occ, node, k = occ[go], node[go], k + 1
        count = np.zeros(len(row), np.int64)
        for o in who:
            count[o] += 1
        at = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(at[-1], np.int32)
        for k, (o, d) in enumerate(zip(who, drawn)):
            out[at[o + 1] - 1 - k] = d
        return out, np.concatenate([[0], np.cumsum(np.bincount(row, weights=count, minlength=rows).astype(np.int64))])

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of rows of ids, and len + 1 offsets."""
        size = self.size[ids]
        to = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.first[ids] - to[:-1], size) + np.arange(to[-1])], to[off]


def encode(docs: DataFrame, path: str, keep: list[str | Column], key: Column | None = None, seed: int = 0) -> DataFrame:
    """keep's columns with ids, n_pieces, ids_crc32 (ids as little-endian 32-bit words) and lossless (the decoded ids are the text's bytes); one
    narrow pass."""
    key = F.xxhash64(F.col("doc_id")) if key is None else key
    given = docs.select(*keep, key.alias("__key"), F.col("text").alias("__text"))
    own = given.schema[:-2]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own) + "n_pieces long, ids_crc32 long, lossless boolean, ids array<int>"

    def run(batches):
        vocabulary = Vocabulary.load(path)
        for batch in batches:
            k = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            buf, off = buffers(batch.column(batch.num_columns - 1))
            for lo, hi in steps(off, 1 << 19):
                part = buf[off[lo] : off[hi]]
                ids, at = vocabulary.sample(part, off[lo : hi + 1] - off[lo], k[lo:hi], seed)
                back, back_at = vocabulary.decode(ids, at)
                same = np.ones(hi - lo, bool)
                if len(back) != len(part) or not np.array_equal(back, part) or not np.array_equal(back_at, off[lo : hi + 1] - off[lo]):
                    for i in range(hi - lo):
                        same[i] = np.array_equal(back[back_at[i] : back_at[i + 1]], part[off[lo + i] - off[lo] : off[lo + i + 1] - off[lo]])
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-2]), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(same), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], [*(f.name for f in own), "n_pieces", "ids_crc32", "lossless", "ids"])
            release()

    return given.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, keep: list[str | Column]) -> DataFrame:
    """keep's columns with the text of `ids`."""
    given = coded.select(*keep, F.coalesce("ids", F.array().cast("array<int>")).alias("__ids"))
    own = given.schema[:-1]

    def run(batches):
        vocabulary = Vocabulary.load(path)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            at = ids.offsets.to_numpy().astype(np.int64)
            out, to = vocabulary.decode(ids.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0])
            # the very bytes, whether they are valid UTF-8 or not
            text = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], [*(f.name for f in own), "text"])

    return given.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own) + "text string")
