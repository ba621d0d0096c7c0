"""The corpus pipeline, stage by stage, against brute force."""

import importlib

import pytest

from .test_exact import leaks, repeats, shingles

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    corpus.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in (4, 8))) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    first = next(r.text for r in corpus.where("doc_id = 20").collect())
    spark.createDataFrame([(0, " ".join(first.split()[:25]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, corpus, rows, folder):
    stages = dict(pipeline.STAGES)
    docs = stages["toxicity"](spark, corpus, folder)
    assert docs.columns == pipeline.COLUMNS and docs.count() == len(rows)

    kept = stages["ngram_jaccard_join"](spark, corpus, folder).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids))
    sets = {r.doc_id: shingles(r.text) for r in kept if r.doc_id is not None}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert not pairs
    gone = {d for d, _ in rows if d is not None} - set(ids)
    assert all(any(shingles(t) & shingles(u) for d, u in rows if d in ids) for e, t in rows if e in gone)

    cut = stages["suffix_array_dedup"](spark, corpus, folder).collect()
    size = sorted((x[0] or -1, x[1] - x[2]) for x in repeats(rows))
    got = sorted((r.doc_id or -1, len(r.text.encode())) for r in cut)
    assert len(got) == len(size) and all(0 <= g[1] - s[1] <= 12 for g, s in zip(got, size))
    assert all(r.n_chars == len(r.text) for r in cut)

    clean = {r.doc_id for r in stages["benchmark_decontamination"](spark, corpus, folder).collect()}
    items = [(0, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {x[0] for x in leaks(rows, items)}
    assert clean == {d for d, _ in rows} - hit


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert out.where("not lossless").count() == 0 and out.count() > 20


def test_near_copies_among_null_and_repeated_ids(spark, folder):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = lambda k: text(k) + " end"
    given = [(1, text(0)), (1, text(1)), (1, near(2)), (0, text(2)), (None, text(3)), (None, near(3)), (None, near(0)), (None, text(4)), (5, text(4)), (6, text(5)), (6, text(5)), (None, text(6)), (7, ""), (7, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [(r.doc_id, r.text) for r in dict(pipeline.STAGES)["ngram_jaccard_join"](spark, docs, folder).collect()]
    three = [x for x in kept if x[1] in (text(3), near(3))]
    assert len(three) == 1 and three[0][0] is None
    want = [(1, text(0)), (1, text(1)), (0, text(2)), (5, text(4)), (6, text(5)), (None, text(6)), (7, ""), (7, ""), (None, None)]
    assert sorted(map(repr, kept)) == sorted(map(repr, want + three))
