"""Operators with exact results against brute force."""

import hashlib
import re
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from ferrule.llm import bpe_files, decontaminate, hamming_topk, histogram_sort, ngram_jaccard, piece_sampling, suffix_dedup

from .conftest import vocabulary


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_components(corpus, rows, wide, empty):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))
    assert Counter(map(tuple, ngram_jaccard.jaccard_components(corpus).collect())) == want
    assert Counter(map(tuple, ngram_jaccard.jaccard_components(wide).collect())) == want
    assert ngram_jaccard.jaccard_components(empty).count() == 0


def test_jaccard_later_rounds_are_over_sets_with_partners_left(spark, monkeypatch):
    part = lambda *key: " ".join(f"w{key}{i}".replace(" ", "") for i in range(40))
    texts = []
    for t in range(12):  # all their shingles are shared, none links
        a, b, c = part(t, 0), part(t, 1), part(t, 2)
        texts += [f"{a} {b}", f"{b} {c}", f"{a} {c}"]
    far = len(texts)
    for t in range(3):  # near copies
        words = (part("n", t) + " " + part("m", t)).split()
        texts += [" ".join([*words[:j], f"x{j}", *words[j + 1 :]]) for j in (20, 45, 70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, deal = [], ngram_jaccard._dealt
    monkeypatch.setattr(ngram_jaccard, "PLACES", 0)  # nothing is found in the first rounds
    monkeypatch.setattr(ngram_jaccard, "_dealt", lambda shared, labels, counts, turn: (turn is None and seen.append(shared.select("fp").distinct().count()), deal(shared, labels, counts, turn))[1])
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(docs).collect()}
    assert got == {i: i if i < far else far + (i - far) // 3 * 3 for i in range(len(texts))}
    assert seen[0] == len(texts) and len(seen) > 1 and max(seen[1:]) <= len(texts) - far


def test_tree_bound_keeps_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = []
    for _ in range(150):
        keep = base[rng.random(400) < 0.5] if rng.random() < 0.5 else base[rng.random(400) < 0.93]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(1, 40), dtype=np.uint64)])))
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    counts = ngram_jaccard.group_counts(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]))
    tree = ngram_jaccard.CountRTree(counts.astype(np.uint16), n)
    linked = 0
    for i in range(len(sets)):
        left = set(tree.query(counts[i].astype(np.uint16), n[i])[0].tolist())
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (n[i] + n[j] - both):
                linked += 1
                assert j in left
    assert linked > 100


def repeats(rows):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[k : k + 200] for r in raws for k in range(len(r) - 199))
    for (d, _), r in zip(rows, raws):
        gone = bytearray(len(r) + 1)
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield d, len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def test_repeats(corpus, rows, wide, empty):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = Counter(repeats(rows))
    assert sum(x[2] for x in want) > 1000
    assert Counter(map(tuple, suffix_dedup.without_repeats(corpus).select(cols).collect())) == want
    assert Counter(map(tuple, suffix_dedup.without_repeats(wide).select(cols).collect())) == want
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_repeats_in_whole_characters(corpus):
    got = suffix_dedup.without_repeats(corpus, characters=True).select("kept").collect()
    assert all(bytes(r.kept).decode() is not None for r in got)


def test_merge_is_suffix_order():
    rng = np.random.default_rng(1)
    a = bytes(rng.integers(97, 99, 900).astype(np.uint8))
    texts = [a[:600], a[100:700], a[300:900], b"z" * 450]
    counts = np.array([len(t) - 199 for t in texts])
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    buf, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    edge = np.concatenate([[0], np.cumsum(size)])
    for shards in (1, 2, 3, 4):
        got = suffix_dedup.repeated(buf, size, np.ones(4), shards)
        for t, a, c in zip(texts, edge, counts):
            flags = got[a : a + c]
            assert flags.tolist() == [seen[t[k : k + 200]] > 1 for k in range(len(t) - 199)]


def test_shards(corpus, rows, wide, empty):
    for shards in (1, 4, 100):
        got = histogram_sort.histogram_shards(corpus, shards=shards).select("shard", "slot", "size").collect()
        by = {}
        for s, slot, size in got:
            by.setdefault(s, []).append((slot, size))
        assert len(got) == len(rows) and all(0 <= s < shards for s in by)
        assert all(sorted(x for x, _ in v) == list(range(len(v))) for v in by.values())
        if shards == 4:
            sizes = [sum(x for _, x in v) for v in by.values()]
            most = max(len((t or "").encode()) for _, t in rows) + 16
            assert max(sizes) - min(sizes) <= most + 0.01 * sum(sizes)
    parts = histogram_sort.histogram_shards(corpus, shards=3, sub_bytes=4000).select("shard", "slot").collect()
    assert all(sorted(x for s, x in parts if s == k) == list(range(sum(s == k for s, _ in parts))) for k in range(3))
    assert histogram_sort.histogram_shards(wide, shards=4).count() == len(rows)
    assert histogram_sort.histogram_shards(empty, shards=4).count() == 0


def test_many_ranges(corpus, rows, monkeypatch):
    want = sorted(map(tuple, histogram_sort.histogram_shards(corpus, shards=3).select("doc_id", "size", "shard", "slot").collect()), key=repr)
    monkeypatch.setattr(histogram_sort, "COMPILED", 2)
    assert sorted(map(tuple, histogram_sort.histogram_shards(corpus, shards=3).select("doc_id", "size", "shard", "slot").collect()), key=repr) == want


def test_equal_rows_are_split(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, "same text") for i in range(400)] + [(i, f"other {i}") for i in range(40)], "doc_id long, text string")
    got = histogram_sort.histogram_shards(df, shards=4)
    sizes = [r[0] for r in got.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 60
    by = {}
    for s, slot in got.select("shard", "slot").collect():
        by.setdefault(s, []).append(slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and sum(map(len, by.values())) == 440


def test_one_heavy_key_is_split(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(400)], "doc_id long, text string")
    got = histogram_sort.histogram_shards(df, shards=4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [100, 100, 100, 100]


def test_top_k(spark):
    rng = np.random.default_rng(2)
    codes = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    codes[40:90] = codes[3]  # a common vector
    codes[90:130] = codes[:40] ^ (1 << rng.integers(0, 60, 40))
    rows = [(int(i), int(c)) for i, c in enumerate(codes)] + [(7, int(codes[8])), (None, 5), (9, None)]
    df = spark.createDataFrame(rows, "id long, code long").repartition(3)
    asked = df.where("id % 20 = 0")
    got = {}
    for q, rank, n, d in hamming_topk.top_k(df, asked, 5).select("query_id", "rank", "neighbor_id", "distance").collect():
        got.setdefault(q, []).append((rank, d, n))
    clean = [(i, c) for i, c in rows if i is not None and c is not None]
    for q, c in clean:
        if q % 20 == 0:
            want = sorted((bin((c ^ o) & (2**64 - 1)).count("1"), i) for i, o in clean if i != q)[:5]
            assert [(d, n) for _, d, n in sorted(got[q])] == want
    assert hamming_topk.top_k(df.limit(0), asked, 5).count() == 0
    three = {}
    for q, rank, n, d in hamming_topk.top_k(df, asked, 5, m=3).select("query_id", "rank", "neighbor_id", "distance").collect():
        three.setdefault(q, []).append((rank, d, n))
    assert {q: sorted(x) for q, x in three.items()} == {q: sorted(x) for q, x in got.items()}


def test_probes_by_masks_and_by_values_are_the_same(spark):
    asked = spark.createDataFrame([(0x1234_5678_9ABC_DEF0, 64), (-1, 64)], "q long, limit int")
    every = spark.range(4).select(F.col("id").cast("int").alias("seg")).crossJoin(spark.range(1 << 16).select(F.col("id").cast("int").alias("value")))
    for m, radius in ((4, 0), (4, 2), (3, 1)):
        segments = hamming_topk._segments(m)
        got = hamming_topk._probes(asked, every, 1 << 30, radius, segments)
        assert got.count() == got.distinct().count() == 2 * sum(__import__("math").comb(w, radius) for _, w in segments)
    a = hamming_topk._probes(asked, every, 1 << 30, 3, hamming_topk._segments(4)).select("q", "seg", "value")
    b = hamming_topk._probes(asked, every, 0, 3, hamming_topk._segments(4)).select("q", "seg", "value")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_longer_vectors_are_an_error(spark):
    import pytest

    df = spark.createDataFrame([([1.0] * 65,)], "v array<double>")
    with pytest.raises(Exception, match="more than 64"):
        df.select(hamming_topk.sign_code(F.col("v"))).collect()


def test_top_k_of_repeated_query_ids(spark):
    rng = np.random.default_rng(5)
    codes = [int(c) for c in rng.integers(-(2**63), 2**63, 60, dtype=np.int64)]
    rows = list(enumerate(codes)) + [(20, codes[20])]  # a repeated row
    rows += [(40, codes[40])] * 9  # more often than k + 1
    rows += [(0, codes[0] ^ (1 << i)) for i in range(12)]  # one id, many codes
    rows += [(21, codes[20] ^ 1)] * 3 + [(22, codes[20] ^ 2)]  # a neighbour that is repeated
    df = spark.createDataFrame(rows, "id long, code long").repartition(3)
    got = Counter((q, rank, d, n) for q, rank, n, d in hamming_topk.top_k(df, df.where("id % 20 = 0"), 5).select("query_id", "rank", "neighbor_id", "distance").collect())
    want = Counter()
    for q, c in rows:
        if q % 20 == 0:
            near = sorted((bin((c ^ o) & (2**64 - 1)).count("1"), i) for i, o in rows if i != q)[:5]
            want.update((q, r + 1, d, i) for r, (d, i) in enumerate(near))
    assert got == want


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def leaks(docs, items):
    """Every item laid on every text at every diagonal, without seeds."""
    for d, t in docs:
        w = words(t)
        for i, m in items:
            x = words(m)
            if not x:
                continue
            n, best = min(13, len(x)), None
            for diagonal in range(-len(x) + 1, len(w)):
                off = [0 if 0 <= diagonal + k < len(w) and w[diagonal + k] == x[k] else 1 for k in range(len(x))]
                miss = [sum(off[a : a + n]) for a in range(len(x) - n + 1)]
                good = [a for a in range(len(miss)) if miss[a] <= (decontaminate.MISSES if len(x) >= 8 else 0)]
                if good:
                    first = max(0, diagonal + good[0])
                    best = (min(miss), first) if best is None else (min(best[0], min(miss)), min(best[1], first))
            if best is not None:
                yield d, i, *best


def test_leaks(spark, corpus, rows, wide, empty):
    text = {d: t for d, t in rows}
    long = text[56].split()
    sub = long[5:45]
    sub[10] = sub[30] = "other"
    items = [(0, " ".join(text[20].split()[:25])), (1, " ".join(sub).title()), (2, "a b c"), (3, None), (4, ""), (5, "nothing of this is anywhere in the texts at all friend")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set(leaks([r for r in rows if r[0] is not None], items))
    for docs in (corpus, wide):
        got = {tuple(r) for r in decontaminate.overlaps(docs.where("doc_id is not null"), bench).select("doc_id", "item_id", "misses", "first_word").collect()}
        assert got == want and {x[1] for x in want} == {0, 1}
    assert decontaminate.overlaps(empty, bench).count() == 0
    assert decontaminate.overlaps(corpus, bench.limit(0)).count() == 0
    plan = decontaminate.overlaps(corpus, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_masks_hit_every_placement():
    for length, masks in ((13, decontaminate.MASKS + decontaminate.MORE), (8, decontaminate.SHORT)):
        for gone in combinations(range(length), 2):
            assert any(all(m[p - o] == "0" for p in gone if o <= p < o + len(m)) for m in masks for o in range(length - len(m) + 1)), (length, gone)


def test_leaks_without_seeds(spark):
    """Every placement of two substitutions in 13 words, and items of fewer words, against the rule alone."""
    docs, items = [], [(0, " ".join(f"w{i}" for i in range(13))), (1, "only three words"), (2, "seven words are more than three yet"), (3, " ".join(f"v{i}" for i in range(8))), (4, " ".join(f"u{i}" for i in range(11))), (5, "single")]
    for item, stem, size in ((0, "w", 13), (3, "v", 8), (4, "u", 11)):
        for gone in combinations(range(size), 2):
            docs.append((len(docs), " ".join(["before"] + ["changed" if i in gone else f"{stem}{i}" for i in range(size)] + ["after"])))
    docs += [(1000, "here are Only three words. And a single one"), (1001, "only two words"), (1002, "say seven words are more than three yet"), (1003, "seven words are more than two yet"), (1004, "single single"), (1005, None), (1006, ""), (1007, " ".join(f"w{i}" for i in range(11)))]
    docs.append((1008, " ".join(["here w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"] * 40)))  # a passage again and again
    want = set(leaks(docs, items))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.select("doc_id", "item_id", "misses", "first_word").collect()} == want and len(want) > 150


def test_token_files(spark, corpus, rows, wide, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    start, want = 0, []
    h = {r[0]: r[1] for r in corpus.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1] or ""])):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    for docs in (corpus, wide):
        got = sorted(map(tuple, bpe_files.encoded(docs, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
        assert got == want
    assert bpe_files.encoded(empty, path).count() == 0


def test_file_layout(spark, corpus, tmp_path):
    import pyarrow.parquet as pq

    path = vocabulary("byte_bpe_50k.json")
    for encoding in ("dictionary", "delta"):
        bpe_files.write_ids(corpus, path, str(tmp_path / encoding), encoding=encoding)
        name = next((tmp_path / encoding).glob("*.parquet"))
        meta = pq.ParquetFile(name).metadata
        column = next(meta.row_group(0).column(i) for i in range(meta.num_columns) if "ids" in meta.row_group(0).column(i).path_in_schema)
        assert column.has_offset_index and column.has_column_index
        assert any("DICT" in e if encoding == "dictionary" else "DELTA" in e for e in column.encodings)


def test_selected_tokens_skip_pages(spark, tmp_path):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    for encoding in ("dictionary", "delta"):
        out = str(tmp_path / encoding)
        bpe_files.write_ids(docs, vocabulary("byte_bpe_50k.json"), out, encoding=encoding)
        whole = {r.doc_id: r.ids for r in spark.read.parquet(out).where("doc_id % 1000 < 3").select("doc_id", "ids").collect()}
        got = bpe_files.read_tokens(spark, out, 5000, 5002)
        rows = got.collect()
        assert [r.doc_id for r in rows] == [5000, 5001, 5002] and all(r.ids == whole[r.doc_id] and len(r.ids) == r.n_tokens for r in rows)
        # the same condition without the order, so that the scan's own count of rows can be read
        bare = spark.read.parquet(out).where(F.col("doc_id").between(5000, 5002)).select("doc_id", "ids")
        assert len(bare.collect()) == 3
        read = bare._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()
        assert 3 <= read <= 3 * bpe_files.PAGE_ROWS  # of 40,000


def test_pretokens_follow_the_pattern():
    import public_tokenizers
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    cases = ["it's 'tis we'll  'LL x'sy ''s", "a\n\n b  ", " \t x", "12ab34 5", "don't'", "x 's", "\n's", "'", "", "é²Ⅷ 中文!!", "a'd've"]
    chars = np.frombuffer("".join(cases).encode("utf-32-le"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(c) for c in cases])])
    at, row = bpe_files.pretokens(chars, off)
    whole, ends = "".join(cases), np.append(at[1:], len(chars))
    for i, c in enumerate(cases):
        assert [whole[a:b] for a, b, r in zip(at, ends, row) if r == i] == pattern.findall(c), c


def test_pieces_round_trip(corpus, rows, wide, empty):
    path = vocabulary("piece_bpe_32k.model")
    a = piece_sampling.encode(corpus, path, ["doc_id", "text"])
    got = a.collect()
    assert len(got) == len(rows) and all(r.lossless and r.n_pieces == len(r.ids) for r in got)
    key = lambda r: (r.doc_id, r.text)
    again = {key(r): r.ids for r in piece_sampling.encode(wide.repartition(1), path, ["doc_id", "text"]).collect()}
    assert all(again[key(r)] == r.ids for r in got)
    other = {key(r): r.ids for r in piece_sampling.encode(corpus, path, ["doc_id", "text"], seed=1).collect()}
    assert any(other[key(r)] != r.ids for r in got)
    back = piece_sampling.decode(a.withColumnRenamed("text", "was"), path, ["was"]).collect()
    assert all(r.text == (r.was or "") for r in back)
    assert piece_sampling.encode(empty, path, ["doc_id"]).count() == 0


def test_samples_follow_the_lattice():
    """Shares of sampled segmentations against those of all segmentations."""
    path = vocabulary("piece_bpe_32k.model")
    v = piece_sampling.Vocabulary.load(path)
    word = b"under"
    weight = {p: v.logw[i] for i, p in enumerate(v.bytes) if p and not (len(p) == 1 and v.byte_ids[p[0]] == i)}

    def all_of(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            options = ([weight[rest[:n]]] if rest[:n] in weight else []) + ([v.floor] if n == 1 else [])
            for k, w in enumerate(options):
                for tail, t in all_of(rest[n:]):
                    yield ((rest[:n], w == v.floor), *tail), w + t

    want = {s: np.exp(t) for s, t in all_of(word)}
    total = sum(want.values())
    n = 20000
    buf, off = np.frombuffer(word * n, np.uint8), np.arange(n + 1) * len(word)
    ids, at = v.sample(buf, off, np.arange(n, dtype=np.uint64), 0)
    got = Counter(tuple((v.bytes[i], bool(len(v.bytes[i]) == 1 and v.byte_ids[v.bytes[i][0]] == i)) for i in ids[a:b]) for a, b in zip(at[:-1], at[1:]))
    for s, p in sorted(want.items(), key=lambda x: -x[1])[:5]:
        assert abs(got[s] / n - p / total) < 0.02


def test_ids_do_not_depend_on_partitions(corpus):
    one = histogram_sort.histogram_shards(corpus.repartition(1), 4).groupBy("shard").agg(F.sum("size")).collect()
    two = histogram_sort.histogram_shards(corpus.repartition(5), 4).groupBy("shard").agg(F.sum("size")).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_bytes_that_are_no_utf8(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, b"caf\xe9 \xff\xfe x"), (2, b"plain words"), (3, b"\xc3")], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"), "raw")
    path = vocabulary("piece_bpe_32k.model")
    coded = piece_sampling.encode(docs, path, ["doc_id", "raw"])
    assert coded.where("not lossless").count() == 0
    assert piece_sampling.decode(coded, path, ["raw"]).where(F.col("text").cast("binary") != F.col("raw")).count() == 0
    got = {r.doc_id: r.n_tokens for r in bpe_files.encoded(docs, vocabulary("byte_bpe_50k.json")).collect()}
    assert set(got) == {1, 2, 3} and got[2] == 3


def test_a_model_with_inner_blanks_is_rejected(monkeypatch):
    import sentencepiece

    class Model:
        def __init__(self, model_file):
            pass

        get_piece_size = lambda self: 2
        is_byte = is_control = is_unknown = is_unused = lambda self, i: False
        id_to_piece = lambda self, i: ["a", "a▁b"][i]
        get_score = lambda self, i: -1.0

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    import pytest

    with pytest.raises(ValueError):
        piece_sampling.Vocabulary("any")
