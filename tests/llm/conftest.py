import random

import pytest

from ferrule.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use inside.
CLASHING = ["h", "k", "k1", "w", "words", "place", "bucket", "step", "a", "b", "size", "shard", "slot", "kept", "n_bytes", "score", "x", "toks", "fp", "n", "at", "item", "part", "component", "ids", "spans"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha beta gamma delta river stone cloud seven green walk quick under lamp paper north".split()) + rng.choice(["", "s", "ed", "ly", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Small texts with copies, near copies, shared passages, odd characters, empty and null values, repeated rows and null ids."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(1, 160)) for _ in range(40)]
    passage = prose(rng, 45)
    for i in range(12):
        words = texts[i].split()
        if words:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], texts[5], prose(rng, 30) + " " + passage + " " + prose(rng, 9), passage + ". " + prose(rng, 60), "", None, "   ", "a" * 2500, "ab" * 900, "é" * 400 + " ü ▁ <0x0A>\n\t \x00 tail", "Schöne 中文 text 'll we've it's don't  two   blanks \n\n end ", "one two", "One TWO", prose(rng, 4000)]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, texts[9], None, None, None), (None, None, None, None, None), (500, texts[2].upper(), "fr", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def wide(corpus):
    from pyspark.sql import functions as F

    return corpus.withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows(corpus):
    return [(r.doc_id, r.text) for r in corpus.collect()]


def vocabulary(name: str) -> str:
    public = pytest.importorskip("public_tokenizers")
    return str(public.path(name))


__all__ = ["common", "vocabulary"]
