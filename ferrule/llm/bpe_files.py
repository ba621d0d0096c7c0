"""Token ids in Parquet files: one list column beside plain metadata columns.

Texts are encoded with a byte-level BPE of the tokenizers library. Files hold rows in ascending doc_id order, one range of
doc_ids and text hashes a task; row groups and pages have set sizes, lists are dictionary encoded (or delta encoded: encoding="delta"), and Parquet's
column and page indexes let a reader fetch the metadata, or the tokens of a few doc_ids, without the rest.

Texts are cut in pre-tokens by the vocabulary's own pattern, in numpy over code points, and only a step's distinct pre-tokens
that were not seen before are given to the tokenizer, which treats pre-tokens independently: the ids are those of the whole text.

Cases: a null text is empty; each document gets end_id (also an empty one); equal doc_ids lie side by side in the order of
their texts' hashes, in several files if there are many; null doc_ids come first; an empty table gives no rows; special tokens' strings in a text are ordinary text; bytes that are
no UTF-8 count as U+FFFD; extra columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, mix, partitions, shared_dir, spans_hash, steps

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 2_000
_state: dict = {}


def _tokenizer(path: str):
    if path not in _state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer, pre_tokenizers

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # pretokens() has cut already
        _state[path] = t
    return _state[path]


def _id_bytes(path: str) -> np.ndarray:
    """Bytes of each id: in a byte-level vocabulary, the characters of its token."""
    if f"bytes {path}" not in _state:
        vocabulary = _tokenizer(path).get_vocab(with_added_tokens=False)
        size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            size[i] = len(token)
        _state[f"bytes {path}"] = size
    return _state[f"bytes {path}"]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: 0 other, 1 letter, 2 number, 3 white space; and a random 64-bit word."""
    if "classes" not in _state:
        import regex

        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "�" for c in range(0x110000))
        kind = np.zeros(0x110000, np.uint8)
        for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(pattern, every):
                kind[m.start() : m.end()] = k
        kind[0xD800:0xE000] = 0
        _state["classes"] = kind, mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x51ED27)) | np.uint64(1)
    return _state["classes"]


def pretokens(chars: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens of rows of code points (off: len + 1 row offsets), and the row of each. The pattern is
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space not before a character|white space."""
    n = len(chars)
    kind = _classes()[0][chars]
    row_start = np.zeros(n, bool)
    row_start[off[:-1][off[:-1] < n]] = True
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= row_start
    cut = new.copy()
    row_end = np.zeros(n, bool)
    row_end[off[1:][off[1:] > 0] - 1] = True
    space = kind == 3
    # the last white space before a character stands alone (and, if it is a blank, with what follows)
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:]
    last &= ~row_end
    cut |= last
    follows = np.zeros(n, bool)
    follows[1:] = last[:-1] & (chars[:-1] == 32)
    cut &= ~follows
    # contractions: an apostrophe that begins a pre-token
    for i in np.flatnonzero((chars == 39) & cut & new):
        end = int(off[np.searchsorted(off, i, side="right")])
        tail = chars[i + 1 : min(i + 3, end)].tolist()
        size = 2 if tail[:1] and tail[0] in (115, 116, 109, 100) else 3 if tail in ([114, 101], [118, 101], [108, 108]) else 0
        if size:
            cut[i + 1 : i + size] = False
            if i + size < end:
                cut[i + size] = True
    at = np.flatnonzero(cut)
    return at, np.searchsorted(off, at, side="right") - 1


class PretokenIds:
    """Ids of pre-tokens by hash, in sorted arrays (about 20 bytes a pre-token); emptied beyond `most` pre-tokens."""

    def __init__(self, most: int = 1_500_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        keys, first, size = np.concatenate([self.keys, keys]), np.concatenate([self.first, self.used + np.cumsum(size) - size]), np.concatenate([self.size, size.astype(np.int32)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.size = keys[order], first[order], size[order]
        self.used += len(ids)


def encode(path: str, buf: np.ndarray, off: np.ndarray, end_id: int, cache: PretokenIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each row (UTF-8) with end_id after it: values and len + 1 offsets. The cache is the caller's, to be kept."""
    rows = len(off) - 1
    try:
        text = buf.tobytes().decode("utf-8")
    except UnicodeDecodeError:  # U+FFFD for what is no UTF-8, row by row
        raw = [buf[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(off[:-1], off[1:])]
        buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        text = buf.tobytes().decode("utf-8")
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    char_off = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
    at, row = pretokens(chars, char_off)
    end = np.append(at[1:], len(chars)) if len(at) else at
    kinds, index, inverse = np.unique(spans_hash(_classes()[1][chars], at, end), return_index=True, return_inverse=True)
    if len(cache.keys) + len(kinds) > cache.most:
        cache.clear()
    new = np.flatnonzero(cache.find(kinds) < 0)
    if len(new):
        given = [text[a:b] for a, b in zip(at[index[new]].tolist(), end[index[new]].tolist())]
        ids = np.array(_tokenizer(path).encode_batch_fast([given], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
        # a byte-level id stands for a fixed number of bytes, which tells where each pre-token's ids end
        done = np.searchsorted(np.cumsum(_id_bytes(path)[ids]), np.cumsum([len(w.encode()) for w in given]), side="right")
        cache.add(kinds[new], np.diff(np.concatenate([[0], done])), ids)
    place = cache.find(kinds)[inverse]
    # the end id is one more pre-token after each row's own
    per_row = np.bincount(row, minlength=rows)
    n = cache.size[place].astype(np.int64)
    here = np.concatenate([[0], np.cumsum(n)]) + 0
    edge = np.concatenate([[0], np.cumsum(per_row)])
    total = here[edge[1:]] - here[edge[:-1]] + 1
    out_at = np.concatenate([[0], np.cumsum(total)])
    values = np.empty(out_at[-1], np.int32)
    values[out_at[1:] - 1] = end_id
    own = np.ones(out_at[-1], bool)
    own[out_at[1:] - 1] = False
    values[own] = cache.flat[np.repeat(cache.first[place] - here[:-1], n) + np.arange(here[-1])]
    return values, out_at


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = 2, encoding: str = "dictionary") -> None:
    """Write (part, place, doc_id, n_tokens, ids) of docs to the folder `out`, sorted by doc_id; part is the file's place in that
    order, and place the row's in its file."""
    parts = partitions(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ranged = ranged.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches):
        cache = _state.setdefault(f"cache {path}", PretokenIds())  # a worker's, over its tasks
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            buf, off = buffers(batch.column(1))
            for lo, hi in steps(off):
                values, at = encode(path, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], end_id, cache)
                ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, part, np.int32)), pa.array(np.arange(place, place + hi - lo)), batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), ids], ["part", "place", "doc_id", "n_tokens", "ids"])
                place += hi - lo

    rows = ranged.mapInArrow(run, "part int, place long, doc_id long, n_tokens long, ids array<int>")
    writer = rows.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
    if encoding == "delta":
        writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    writer.parquet(out)


def read_tokens(spark, out: str, least: int, most: int) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents with least <= doc_id <= most, in order. The bounds are pushed to the reader: files and row groups go by their statistics,
    pages by the column index, so that other documents' lists aren't decoded."""
    rows = spark.read.parquet(out).where(F.col("doc_id").between(least, most))
    return rows.orderBy("doc_id", "part", "place").select("doc_id", "n_tokens", "ids")


def read_ids(spark, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files' rows; start: the ids of all documents before. Sums over whole files
    need the metadata columns only, and a row for each file."""
    files = spark.read.parquet(out)
    before = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = before.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            at = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(crc, pa.int64())], ["part", "place", "doc_id", "n_tokens", "ids_crc32"])

    digests = files.select("part", "place", "doc_id", "ids", "n_tokens").mapInArrow(run, "part int, place long, doc_id long, n_tokens long, ids_crc32 long")
    order = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    within = digests.withColumn("within", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    return within.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write docs' ids to the shared folder and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    import uuid

    out = f"{shared_dir(docs.sparkSession)}/ferrule/{uuid.uuid4().hex}/ids"
    write_ids(docs, path, out, end_id)
    return read_ids(docs.sparkSession, out)
