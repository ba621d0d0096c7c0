"""Language ID with a bit-sliced n-gram Bloom filter.

One filter serves all languages: each slot holds a mask of languages (a 64-bit word for each 64 of them), and the AND of an n-gram's slots is the set of
languages that may contain it. A text's n-grams are looked up once; the per-language counts of set bits are corrected for each
language's false-positive rate (its share of set bits to the power of the number of hashes), and the largest corrected count
decides.

Cases: a null text, or one without a letter, is `und` with score 0; ties go to the language that sorts first; a text shorter
than an n-gram is padded with spaces; one above PIECE bytes is counted in pieces cut at blanks, each padded so; repeated rows get equal results; empty tables give no rows; without a labelled row
every text is `und`; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, cut_rows, mix, release, steps

#: The filter is fitted on about so many labelled rows of a language (those with the least hash of doc_id), whole texts: a
#: documented bound, so that fitting needs bounded memory.
FIT_ROWS = 600
PIECE = 1 << 20
N_GRAM, SLOTS, HASHES, SHARE = 5, 1 << 21, 3, 0.3


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each byte n-gram (A-Z lower-cased; digits, punctuation and white space as one space) and its row.
    Grams start inside their row and see spaces after its end."""
    table = LOWER.copy()
    ascii_ = np.arange(128)
    table[ascii_[~np.array([chr(c).isalpha() for c in range(128)])]] = 32
    rows = len(off) - 1
    size = np.diff(off)
    padded = np.full(int(off[-1]) + rows * (N_GRAM - 1), 32, np.uint8)
    row = np.repeat(np.arange(rows, dtype=np.int32), size)
    at = np.arange(int(off[-1]), dtype=np.int64) + row.astype(np.int64) * (N_GRAM - 1)
    padded[at] = table[buf]
    h = np.zeros(len(at), np.uint64)
    for j in range(N_GRAM):
        h = (h << np.uint64(8)) | padded[at + j]
    # a gram that starts with two spaces says nothing
    keep = ~((padded[at] == 32) & (padded[at + 1] == 32))
    return h[keep], row[keep]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True


def _slots(h: np.ndarray) -> list[np.ndarray]:
    x = mix(h)
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(SLOTS)).astype(np.int64) for i in range(HASHES)]


def fit(labelled: DataFrame, least: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """labelled: (doc_id, text, lang). Languages, the slots' masks, and each language's false-positive rate.

    An n-gram enters a language's filter if it occurs in `least` of its fitted rows, and in a share of them that is at least
    SHARE of the largest share in any language, so that quoted foreign lines and noise stay out."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("doc_id", F.lit(9)).alias("o"), "text")
    # a bounded top-k of each language: partial aggregation keeps FIT_ROWS in each task, never a whole language
    threshold = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = {r["lang"]: min(1.0, FIT_ROWS / r["n"]) for r in threshold.collect()}
    langs = sorted(share)
    masks, fp = np.zeros((max(1, -(-len(langs) // 64)), SLOTS), np.uint64), np.zeros(len(langs))
    if not langs:
        return langs, masks, fp
    cut = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(share[k] * (2**63 - 1)) * 2 - 2**63 if share[k] < 1 else 2**63 - 1))]), F.col("lang"))
    got = rows.where(F.col("lang").isin(langs) & (F.col("o") <= cut)).select("lang", "text").toArrow()
    names = np.array(got["lang"].to_pylist())
    buf, off = buffers(got["text"])
    shares = []
    for lang in langs:
        own = np.flatnonzero(names == lang)
        seen = [np.unique(_grams(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))[0]) for i in own]
        grams, times = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0))
        keep = times >= min(least, len(seen))
        shares.append((grams[keep], times[keep] / max(1, len(seen))))
    grams = np.unique(np.concatenate([g for g, _ in shares]))
    most = np.zeros(len(grams))
    for g, x in shares:
        at = np.searchsorted(grams, g)
        most[at] = np.maximum(most[at], x)
    for k, (g, x) in enumerate(shares):
        g = g[x >= SHARE * most[np.searchsorted(grams, g)]]
        for s in _slots(g):
            masks[k // 64, s] |= np.uint64(1 << k % 64)
        fp[k] = np.mean((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)) ** HASHES
    return langs, masks, fp


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[Column]) -> DataFrame:
    """keep's columns with lang_pred and score for every row; one pass, no shuffle. The model is 16 MB for each 64 languages."""
    langs, masks, fp = model
    spark = docs.sparkSession
    slots = spark.sparkContext.broadcast(masks.view(np.int64) if len(langs) > 8 else masks.astype(np.uint8))
    letter = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    given = docs.select(*keep, F.when(letter, F.col("text")).alias("__text"))
    names = [c for c in given.columns if c != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "__text") + ", lang_pred string, score double"

    def run(batches):
        table = slots.value
        for batch in batches:
            n, text = batch.num_rows, batch.column(batch.num_columns - 1)
            buf, off = buffers(text)
            total, hits = np.zeros(n), np.zeros((len(langs), n))
            cut, owner = cut_rows(buf, off, PIECE, _BLANK)
            for lo, hi in steps(cut):
                g, piece = _grams(buf[cut[lo] : cut[hi]], cut[lo : hi + 1] - cut[lo])
                if not len(g) or not langs:
                    continue
                first, rows = owner[lo], owner[hi - 1] - owner[lo] + 1
                row = owner[lo + piece] - first
                a, b, c = _slots(g)
                seen = [word[a] & word[b] & word[c] for word in table]
                total[first : first + rows] += np.bincount(row, minlength=rows)
                for k in range(len(langs)):
                    hits[k, first : first + rows] += np.bincount(row, weights=(seen[k // 64] >> table.dtype.type(k % 64)) & table.dtype.type(1), minlength=rows)
            best, score = np.full(n, -1), np.zeros(n)
            if langs:
                true = np.clip((hits - total * fp[:, None]) / (1 - fp[:, None]), 0, None)
                top = true.argmax(0)
                best = np.where(total > 0, top, -1)
                score = np.where(total > 0, true[top, np.arange(n)] / np.maximum(true.sum(0), 1e-9), 0)
            valid = text.is_valid().to_numpy(zero_copy_only=False)
            best = np.where(valid & (best >= 0), best, len(langs))
            pred = pa.array([*langs, "und"]).take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pred, pa.array(np.where(best == len(langs), 0.0, np.clip(score, 0, 1)))], [*names, "lang_pred", "score"])
            release()

    return given.mapInArrow(run, schema)
