"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of 8 bytes slide over the whole text (every 4 bytes), each filter's response is max-pooled
over chunks of 512 bytes that overlap by 128, and the chunks' pooled vectors are combined (their mean and maximum) into one logistic
output. Training is plain backpropagation with Adam, seeded, on classes of equal weight; the output's bias is then moved to the classes' real shares.

Cases: null and empty texts are one chunk of zero bytes; a short text is padded with zero bytes; one above PIECE bytes is read
whole, piece after piece, and its chunks' sums and maxima are carried; repeated rows score equally; empty tables give no rows; without labels of both classes the
score is the share of class 1 (0.5 if there are none); extra columns pass by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import buffers, release, steps, with_text

#: Labelled rows of each class that the network is fitted on, at most about.
FIT_ROWS = 1500
EMBED, WIDTH, STRIDE, FILTERS = 6, 8, 4, 20
BLOCK = 32  # positions in a pooled block: 128 bytes
CHUNK, HOP = 4, 3  # blocks in a chunk, and from one chunk to the next
#: Bytes of one text that are read at once, about.
PIECE = 1 << 19


def _init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    return {
        "emb": (rng.normal(0, 0.5, (256, EMBED))).astype(np.float32),
        "conv": (rng.normal(0, (1 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS))).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": (rng.normal(0, 0.1, 2 * FILTERS)).astype(np.float32),
        "c": np.zeros(1, np.float32),
    }


def _respond(m: dict, padded: np.ndarray) -> np.ndarray:
    """Filter responses at every STRIDE-th byte of padded (its length: positions * STRIDE + WIDTH - STRIDE)."""
    x = m["emb"][padded]
    n = (len(padded) - WIDTH) // STRIDE + 1
    win = np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))
    return win @ m["conv"] + m["bias"]


def _chunks(m: dict, buf: np.ndarray, off: np.ndarray, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pooled vectors of the rows' chunks, and where each row's begin. Every row starts on a block of its own, padded with zero bytes. last: of one row that is a piece,
    the chunks that count."""
    rows = len(off) - 1
    size = np.diff(off)
    blocks = np.maximum(1, -(-size // (BLOCK * STRIDE)))
    first = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.zeros(int(first[-1]) * BLOCK * STRIDE + WIDTH - STRIDE, np.uint8)
    at = np.arange(int(off[-1])) - np.repeat(off[:-1], size) + np.repeat(first[:-1] * BLOCK * STRIDE, size)
    padded[at] = buf
    response = _respond(m, padded)
    # a row's last window ends in zero bytes, not in the next row
    end = first[1:] * BLOCK * STRIDE - STRIDE
    window = padded[end[:, None] + np.arange(WIDTH)]
    window[:, STRIDE:] = 0
    response[end // STRIDE] = m["emb"][window].reshape(rows, -1) @ m["conv"] + m["bias"]
    pooled = response.reshape(-1, BLOCK, FILTERS).max(1)
    # chunks of CHUNK blocks, one each HOP blocks, not past the row's last block
    n_chunks = np.maximum(1, -(-(blocks - CHUNK) // HOP) + 1)
    if last is not None:
        n_chunks[:] = last
    row = np.repeat(np.arange(rows), n_chunks)
    k = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n_chunks)[:-1]]), n_chunks)
    top = None
    for j in range(CHUNK):
        x = pooled[first[row] + np.minimum(k * HOP + j, blocks[row] - 1)]
        top = x if top is None else np.maximum(top, x)
    return np.maximum(top, 0), np.concatenate([[0], np.cumsum(n_chunks)])


def _combine(m: dict, mean: np.ndarray, high: np.ndarray) -> np.ndarray:
    z = mean @ m["out"][:FILTERS] + high @ m["out"][FILTERS:] + m["c"][0]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def predict(m: dict, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probabilities of rows."""
    if len(off) == 2 and off[1] - off[0] > 2 * PIECE:
        return _predict_long(m, buf[off[0] : off[1]])
    top, edge = _chunks(m, buf, off)
    return _combine(m, np.add.reduceat(top, edge[:-1], axis=0) / np.diff(edge)[:, None], np.maximum.reduceat(top, edge[:-1], axis=0))


def _predict_long(m: dict, buf: np.ndarray) -> np.ndarray:
    """Probability of one text, in pieces of whole chunks; a piece sees the bytes that its last chunk needs of the next."""
    block = BLOCK * STRIDE
    chunks = max(1, -(-(-(-len(buf) // block) - CHUNK) // HOP) + 1)
    each = max(1, PIECE // (HOP * block))
    total, high = np.zeros(FILTERS, np.float64), np.zeros(FILTERS, np.float32)
    for c in range(0, chunks, each):
        n = min(each, chunks - c)
        part = buf[c * HOP * block : ((c + n - 1) * HOP + CHUNK) * block + WIDTH - STRIDE]
        top, _ = _chunks(m, part, np.array([0, len(part)]), n)
        total += top.sum(0, dtype=np.float64)
        high = np.maximum(high, top.max(0))
    return _combine(m, (total / chunks)[None].astype(np.float32), high[None])


def fit(texts: list[str], y: np.ndarray, epochs: int = 14, batch: int = 32, chunks: int = 6, seed: int = 5) -> dict | float:
    """Adam on the logistic loss; classes weigh equally in a batch's draw, and in the end the bias is moved by the log of their shares among the rows. A step sees up
    to `chunks` of a row's chunks, drawn anew each time."""
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    rng = np.random.default_rng(seed)
    m = _init(rng)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    long, t = CHUNK * BLOCK * STRIDE, 0
    by = [np.flatnonzero(y == k) for k in (0, 1)]
    n_pos = long // STRIDE
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for _ in range(max(1, 2 * max(len(by[0]), len(by[1])) // batch)):
            pick = np.concatenate([rng.choice(b, batch // 2) for b in by])
            x, row = [], []
            for i, d in enumerate(pick):
                r = raw[d]
                total = max(1, -(-(-(-len(r) // (BLOCK * STRIDE)) - CHUNK) // HOP) + 1)
                for c in np.arange(total) if total <= chunks else np.sort(rng.choice(total, chunks, replace=False)):
                    s = np.zeros(long + WIDTH - STRIDE, np.uint8)
                    part = r[c * HOP * BLOCK * STRIDE :][: len(s)]
                    s[: len(part)] = part
                    x.append(s)
                    row.append(i)
            x, row = np.stack(x), np.array(row)
            e = m["emb"][x]
            win = np.lib.stride_tricks.as_strided(e, (len(x), n_pos, WIDTH * EMBED), (e.strides[0], STRIDE * EMBED * 4, 4))
            h = win.reshape(-1, WIDTH * EMBED) @ m["conv"] + m["bias"]
            h = h.reshape(len(x), n_pos, FILTERS)
            arg = h.argmax(1)
            top = np.maximum(np.take_along_axis(h, arg[:, None], 1)[:, 0], 0)
            n = np.bincount(row, minlength=batch).astype(np.float32)
            edge = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
            mean, high = np.add.reduceat(top, edge) / n[:, None], np.maximum.reduceat(top, edge)
            z = mean @ m["out"][:FILTERS] + high @ m["out"][FILTERS:] + m["c"][0]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            d = ((p - y[pick]) / batch).astype(np.float32)
            g = {"out": np.concatenate([mean.T @ d, high.T @ d]), "c": d.sum(keepdims=True)}
            back = (d / n)[row][:, None] * m["out"][:FILTERS] + np.where(top == high[row], d[row][:, None] * m["out"][FILTERS:], 0)
            back = np.where(top > 0, back, 0).astype(np.float32)
            g["bias"] = back.sum(0)
            got = win[np.arange(len(x))[:, None], arg]  # chunk, filter, window
            g["conv"] = np.einsum("cfw,cf->wf", got, back)
            into = back[:, :, None] * m["conv"].T[None]  # chunk, filter, window * embed
            at = x[np.arange(len(x))[:, None, None], arg[:, :, None] * STRIDE + np.arange(WIDTH)]
            flat, into = at.reshape(-1), into.reshape(-1, EMBED)
            g["emb"] = np.stack([np.bincount(flat, weights=into[:, k], minlength=256) for k in range(EMBED)], 1).astype(np.float32)
            t += 1
            for k in m:
                a, b = state[k]
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] ** 2 - b)
                m[k] -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    m["c"] += np.float32(np.log(len(by[1]) / len(by[0])))
    return m


def score(docs: DataFrame, model: dict | float, keep: list[Column]) -> DataFrame:
    """keep's columns with score and predicted (score >= 0.5); one narrow pass over whole texts."""
    given, at_text, kept = with_text(docs, keep)
    names = given.columns[:kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:kept]) + ", score double, predicted int"

    def run(batches):
        for batch in batches:
            buf, off = buffers(batch.column(at_text))
            p = np.full(batch.num_rows, model if isinstance(model, float) else 0.0)
            if not isinstance(model, float):
                for lo, hi in steps(off, PIECE):
                    p[lo:hi] = predict(model, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])
            release()

    return given.mapInArrow(run, schema)
