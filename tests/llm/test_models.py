"""Fitted operators: held-out accuracy on the driver's small tables, and odd rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import language_id, quality, queries, toxicity
from ferrule.llm.common import components, labelled_sample

DIR = "/root/testdata/sf0.1"
needs = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


def accuracy(spark, rows, column, truth):
    t = spark.read.parquet(f"{DIR}/{truth}.parquet")
    return rows.where("held_out").join(t, "doc_id").agg(F.avg((F.col(column[0]) == F.col(column[1])).cast("int"))).first()[0]


@needs
def test_toxicity(spark):
    out = queries.op3_toxicity(spark, DIR)
    assert accuracy(spark, out, ("predicted", "toxic"), "labels") > 0.97


@needs
def test_quality(spark):
    out = queries.op5_quality(spark, DIR)
    assert accuracy(spark, out, ("predicted", "quality"), "labels") > 0.95


@needs
def test_language(spark):
    out = queries.op9_language_id(spark, DIR)
    assert accuracy(spark, out, ("lang_pred", "lang"), "documents") > 0.98


@needs
def test_toxic_rows_are_found(spark):
    """Recall and precision on held-out rows that hold a word of the seed list (the tables also mark rows without any)."""
    out = queries.op3_toxicity(spark, DIR).where("held_out").join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"), "doc_id")
    rows = out.where(F.lower("text").rlike("(?<![a-z])(" + "|".join(toxicity.SEED_INSULTS) + ")(?![a-z])") & F.col("toxic").isNotNull()).select("toxic", "predicted").collect()
    assert sum(r.toxic for r in rows) > 20
    assert sum(r.predicted for r in rows if r.toxic) > 0.95 * sum(r.toxic for r in rows)
    clean = out.where("toxic = 0").select("predicted").collect()
    assert sum(r.predicted for r in clean) < 0.02 * len(clean)


def by_hand(kinds):
    """A clause's arcs, word by word, without any machine."""
    t, n = toxicity, [0] * 6
    near = lambda i, kind: any(kinds[j] == kind for j in range(max(0, i - t.SCOPE), i))
    for i, k in enumerate(kinds):
        if k in (t.INSULT, t.THREAT):
            n[0 if k == t.INSULT else 1] += 1
            n[2] += k == t.THREAT and near(i, t.FIRST)
            n[3] += near(i, t.TARGET) or t.TARGET in kinds[i + 1 : i + 1 + t.SCOPE]
            n[4] += near(i, t.NEGATOR)
            n[5] += near(i, t.REPORTER) or sum(x == t.QUOTE for x in kinds[:i]) % 2 == 1
    return n


def test_the_composed_machine_takes_the_paths_of_its_parts():
    from itertools import product

    for size in range(6):
        for kinds in product(range(8), repeat=size):
            assert toxicity.path(list(kinds)) == by_hand(kinds), kinds
    rng = np.random.default_rng(3)
    for _ in range(2000):
        kinds = rng.integers(0, 8, rng.integers(6, 40)).tolist()
        assert toxicity.path(kinds) == by_hand(tuple(kinds))


def scores(model, texts):
    import pyarrow as pa

    from ferrule.llm.common import buffers

    found = model[0].paths(*buffers(toxicity.folded_text(pa.array(texts))))
    return [1 / (1 + np.exp(-toxicity.text_score(found.get(i, np.zeros((0, 6))), model[1]))) for i in range(len(texts))]


def test_unlabelled_grammar_scores():
    model = toxicity.fit([], np.zeros(0, np.int64))
    attacks = scores(model, ["you are an idiot", "I will kill you", "ICH WERDE DICH TÖTEN", "Idiot, you!", "shut up, you pathetic clown"])
    others = scores(model, ["the clown kill switch pathetic trash scum", "he said you are an idiot", "you are not an idiot", "I will never hurt you", 'she wrote "you idiot" on it', "a fine day", "you", "kill the process"])
    assert min(attacks) > 0.5 > max(others)
    assert len(set(scores(model, ["", "a fine day", "the clown kill switch pathetic trash scum", "kill the process"]))) == 1  # nothing matched, nothing added


def test_long_texts_are_read_in_pieces(monkeypatch):
    model = toxicity.fit([], np.zeros(0, np.int64))
    text = "words go on here. " * 300 + "you are an idiot. " + "and more without an end " * 200 + "du bist ein clown"
    whole = scores(model, [text, "x", text[:3000], ""])
    monkeypatch.setattr(toxicity, "PIECE", 700)
    assert scores(model, [text, "x", text[:3000], ""]) == whole and whole[0] > 0.5


def test_odd_rows(spark, corpus, wide, empty, rows):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for docs in (corpus, wide):
        texts, y = labelled_sample(docs, labels, "toxic", 100)
        out = toxicity.score(docs, toxicity.fit(texts, y), ["doc_id"])
        assert out.count() == len(rows) and out.where("not (score between 0 and 1)").count() == 0
        texts, y = labelled_sample(docs, labels, "quality", 100)
        out = quality.score(docs, quality.fit(texts, y, epochs=1), ["doc_id"])
        assert out.count() == len(rows) and out.where("not (score between 0 and 1)").count() == 0
        out = language_id.predict(docs, language_id.fit(docs), ["doc_id", "text"])
        assert out.count() == len(rows)
        assert out.where("(text is null or not text rlike '\\\\p{L}') and (lang_pred <> 'und' or score <> 0)").count() == 0
    model = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(corpus, model, ["doc_id"]).collect()} == {"und"}
    assert quality.fit([], np.zeros(0, np.int64)) == 0.5
    assert toxicity.score(empty, toxicity.fit([], np.zeros(0, np.int64)), ["doc_id"]).count() == 0
    assert quality.score(empty, 0.5, ["doc_id"]).count() == 0


def test_network_sees_the_end_of_long_texts():
    m = quality._init(np.random.default_rng(1))
    base = np.frombuffer(b"plain words here " * 3000, np.uint8)
    changed = base.copy()
    changed[-40:] = np.random.default_rng(2).integers(128, 256, 40)
    p = quality.predict(m, np.concatenate([base, changed]), np.array([0, len(base), 2 * len(base)]))
    assert p[0] != p[1]


def naive(m, raw):
    """The network on one text by plain loops."""
    q, block = quality, quality.BLOCK * quality.STRIDE
    blocks = max(1, -(-len(raw) // block))
    raw = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(blocks * block + q.WIDTH, np.uint8)])
    pooled = []
    for b in range(blocks):
        best = np.full(q.FILTERS, -np.inf)
        for p in range(b * block, (b + 1) * block, q.STRIDE):
            window = np.concatenate([m["emb"][x] for x in raw[p : p + q.WIDTH]])
            best = np.maximum(best, window @ m["conv"] + m["bias"])
        pooled.append(best)
    chunks, at = [], 0
    while True:
        chunks.append(np.maximum(np.max(pooled[at : at + q.CHUNK], axis=0), 0))
        if at + q.CHUNK >= blocks:
            break
        at += q.HOP
    z = np.mean(chunks, axis=0) @ m["out"][: q.FILTERS] + np.max(chunks, axis=0) @ m["out"][q.FILTERS :] + m["c"][0]
    return 1 / (1 + np.exp(-z))


def test_network_against_plain_loops(monkeypatch):
    rng = np.random.default_rng(8)
    m = quality._init(rng)
    m["c"][0] = 0.3
    raw = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (0, 1, 127, 128, 129, 512, 513, 900, 3000)]
    want = [naive(m, r) for r in raw]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    assert np.abs(quality.predict(m, np.frombuffer(b"".join(raw), np.uint8), off) - want).max() < 1e-5
    for r, w in zip(raw, want):
        assert abs(quality.predict(m, np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] - w) < 1e-5
    monkeypatch.setattr(quality, "PIECE", 800)
    assert abs(quality.predict(m, np.frombuffer(raw[-1], np.uint8), np.array([0, len(raw[-1])]))[0] - want[-1]) < 1e-5


def test_language_against_sets(spark, monkeypatch):
    """Predictions of the Bloom filters against exact sets of n-grams, and long texts in pieces."""
    rng = np.random.default_rng(9)
    words = {x: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(30)] for x in ("aa", "bb", "cc")}
    rows = [(i, " ".join(rng.choice(words[x], 40)), x) for i, x in enumerate(list(words) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    model = language_id.fit(docs)
    grams = lambda t: [t[i : i + 5] for i in range(len(t))]
    sets = {}
    for x in words:
        seen = [set(grams(t + "    ")) for _, t, y in rows if y == x]
        sets[x] = {g for s in seen for g in s if sum(g in o for o in seen) >= 3}
    for _, t, x in rows:
        n = {y: sum(g in sets[y] for g in grams(t + "    ")) for y in words}
        assert max(n, key=n.get) == x
    got = {r.text: (r.lang_pred, r.lang) for r in language_id.predict(docs, model, ["text", "lang"]).collect()}
    assert all(a == b for a, b in got.values())
    buf = np.frombuffer(" ".join(t for _, t, x in rows if x == "bb").encode(), np.uint8)
    from ferrule.llm.common import cut_rows

    cut, owner = cut_rows(buf, np.array([0, len(buf)]), 500, language_id._BLANK)
    assert len(owner) > 5 and max(np.diff(cut)) <= 500 and all(buf[c - 1] == 32 for c in cut[1:-1]) and not owner.any()


def test_components(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_more_than_64_languages(spark):
    rng = np.random.default_rng(6)
    langs = [f"l{k:02d}" for k in range(70)]
    vocabulary = {x: ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(12)] for x in langs}
    rows = [(i, " ".join(rng.choice(vocabulary[x], 20)), x) for i, x in enumerate(langs * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    got = language_id.predict(docs, language_id.fit(docs), ["lang"]).collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred for r in got)


def test_a_frequent_insult_is_induced_at_every_size():
    """In half of the toxic and 1 in 125 of the clean rows, each time after another word."""
    for rows in (250, 3000):
        toxic = [f"before{i} blockhead" if i % 2 else f"plain{i} words" for i in range(rows)]
        clean = [f"quoted{i} blockhead" if i % 125 == 0 else f"plain{i} words" for i in range(rows)]
        words, _ = toxicity.induce(toxic + clean, np.array([1] * rows + [0] * rows))
        assert "blockhead" in words, rows
