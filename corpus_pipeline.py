"""The corpus pipeline: STAGES of the training-data operators over documents, each written as Parquet and read again.

Every stage but the last returns the columns of documents. Rows with null or repeated doc_ids pass through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import decontaminate, ngram_jaccard, piece_sampling, suffix_dedup, toxicity
from ferrule.llm.common import folded, labelled_sample, materialize, table
from ferrule.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of keys that an anti-join may broadcast; beyond it texts are shuffled.
BROADCAST_ROWS = 250_000
ORACLE_SQL = None  # a fitted grammar, a sampled segmentation


def _without(docs: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    keys = materialize(keys, "dropped")
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted as for its query, doesn't reject."""
    labels = table(spark, sf_dir, "labels").where(folded("doc_id", 5) != 0)
    texts, y = labelled_sample(docs, labels, "toxic", toxicity.FIT_ROWS)
    return toxicity.score(docs, toxicity.fit(texts, y), COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram Jaccard join: the one with the smallest doc_id (null last). Rows are told by an id of their own,
    so doc_ids may be null or repeated; a row without words is its own component and stays."""
    keyed = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")), "keyed")
    groups = ngram_jaccard.jaccard_components(keyed.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    groups = materialize(groups, "groups")
    several = groups.where(F.col("__row") != F.col("component_id")).select("component_id").distinct()
    members = materialize(groups.join(several, "component_id", "left_semi").join(keyed.select("__row", "doc_id"), "__row"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("x")).select(F.col("x.__row").alias("__row"))
    return _without(keyed, members.select("__row").join(first, "__row", "left_anti"), ["__row"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that a repeated 200-byte string covers (whole characters); every row stays."""
    out = suffix_dedup.without_repeats(docs.select(*COLUMNS), characters=True).withColumn("text", F.col("kept").cast("string"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. They are told by their text, so ids may be null or repeated."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(*COLUMNS).withColumns({"__h": F.xxhash64(text), "__m": F.octet_length(text)})
    hit = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), ["__h", "__m"]).select("__h", "__m").distinct()
    return _without(keyed, hit, ["__h", "__m"]).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document."""
    return piece_sampling.encode(docs, vocabulary("piece_bpe_32k.model"), ["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("sentencepiece_encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
