"""Queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_files, decontaminate, hamming_topk, histogram_sort, language_id, ngram_jaccard, piece_sampling, quality, suffix_dedup, toxicity
from .common import folded, labelled_sample, table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), hamming_topk.sign_code(F.col("embedding")).alias("code"))
    return hamming_topk.top_k(rows, rows.where(F.col("id") % 20 == 0), k=10)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    texts, y = labelled_sample(docs, labels.where(folded("doc_id", 5) != 0), "toxic", toxicity.FIT_ROWS)
    return toxicity.score(docs, toxicity.fit(texts, y), ["doc_id", (folded("doc_id", 5) == 0).alias("held_out")])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    texts, y = labelled_sample(docs, labels.where(folded("doc_id", 3) != 1), "quality", quality.FIT_ROWS)
    return quality.score(docs, quality.fit(texts, y), ["doc_id", (folded("doc_id", 3) == 1).alias("held_out")])


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), ["doc_id"])


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_sort.histogram_shards(table(spark, sf_dir, "documents"), shards=40)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "size", F.crc32(text.cast("binary")).alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(folded("doc_id", 3) != 1))
    return language_id.predict(docs, model, ["doc_id", (folded("doc_id", 3) == 1).alias("held_out")])


def op10_bpe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_files.encoded(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming_topk": op1_hamming_topk,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_piece_sampling": op6_piece_sampling,
    "op7_histogram_sort": op7_histogram_sort,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_id": op9_language_id,
    "op10_bpe_files": op10_bpe_files,
}
_WORDS = r"list_filter(regexp_split_to_array({}, '{}'), lambda x: x <> '')"

SQL: dict[str, str] = {
    "op1_hamming_topk": """WITH c AS (SELECT vec_id, [x > 0 FOR x IN embedding[1:64]] AS s FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_sum([(a.s[i] <> b.s[i])::INT FOR i IN range(1, 65)])::INT AS distance FROM c a JOIN c b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank, neighbor_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM p) WHERE rank <= 10""",
    "op2_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "[ \\t-\\r]+")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(doc, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(root) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc = d.doc_id GROUP BY 1, 2""",
    # the rule alone, without seeds: a diagonal needs as many equal words as a stretch may not miss
    "op4_decontaminate": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("lower(text)", "[^\\p{L}\\p{N}]+")} AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, len(w) AS m, w FROM (SELECT item_id, {_WORDS.format("lower(text)", "[^\\p{L}\\p{N}]+")} AS w FROM benchmark)),
dw AS (SELECT r, generate_subscripts(w, 1) AS p, unnest(w) AS x FROM d), bw AS (SELECT i, generate_subscripts(w, 1) AS q, unnest(w) AS x FROM b),
g AS (SELECT r, i, p - q AS diag, count(*) AS n FROM dw JOIN bw USING (x) GROUP BY 1, 2, 3),
o AS (SELECT doc_id, item_id, diag, m, CASE WHEN m < {decontaminate.SPAN} THEN 0 ELSE {decontaminate.MISSES} END AS most, least({decontaminate.STRETCH}, m) AS s, [CASE WHEN diag + k >= 0 AND d.w[diag + k + 1] = b.w[k + 1] THEN 0 ELSE 1 END FOR k IN range(m)] AS miss
 FROM g JOIN d USING (r) JOIN b USING (i) WHERE n >= least({decontaminate.STRETCH}, m) - CASE WHEN m < {decontaminate.SPAN} THEN 0 ELSE {decontaminate.MISSES} END),
v AS (SELECT *, [list_sum(miss[a + 1:a + s]) FOR a IN range(m - s + 1)] AS per FROM o)
SELECT doc_id, item_id, min(greatest(diag + list_position([x <= most FOR x IN per], true) - 1, 0))::BIGINT AS first_word, min(list_min(per))::BIGINT AS misses FROM v WHERE list_min(per) <= most GROUP BY 1, 2""",
    # crc32 by its table, byte by byte; shards end at the boundary between rows that is nearest to their share of the bytes
    "op7_histogram_sort": """WITH RECURSIVE c(i, k, x) AS (SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM c WHERE k < 8),
lut AS (SELECT list(x ORDER BY i) AS t FROM c WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, len(h) // 2 + 16 AS size, ('0x' || substr(md5(text), 1, 15))::BIGINT AS k1,
 xor(list_reduce([4294967295] || [('0x' || b)::BIGINT FOR b IN regexp_extract_all(h, '..')], lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM d, lut),
p AS (SELECT *, (sum(size) OVER (ORDER BY k1, doc_id) - size)::BIGINT AS below, (sum(size) OVER ())::BIGINT AS total FROM s),
cuts AS (SELECT below AS x FROM p UNION SELECT total FROM p), targets AS (SELECT i, (SELECT any_value(total) FROM p) * i / 40 AS target FROM range(1, 40) t(i)),
bounds AS (SELECT i, arg_min(x, (abs(x - target), x)) AS bound FROM targets, cuts GROUP BY i),
placed AS (SELECT *, (SELECT count(*) FROM bounds WHERE bound <= below)::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k1, doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM placed""",
    # windows are told by md5; a text's hex digits are cut in pieces first, so that taking a window doesn't walk the whole text
    "op8_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, h, unnest(list_transform(regexp_extract_all(h, '.{1,1000}'), lambda x, k: {'k': k - 1, 'x': x})) AS part FROM d WHERE len(h) >= 400),
joined AS (SELECT doc_id, len(h) // 2 AS n, part.k AS k, part.x || coalesce(lead(part.x) OVER (PARTITION BY doc_id ORDER BY part.k), '') AS x, len(part.x) // 2 AS own FROM parts),
w AS (SELECT doc_id, k * 500 + i AS pos, md5(substr(x, 2 * i + 1, 400)) AS v FROM (SELECT *, unnest(range(own)) AS i FROM joined) WHERE k * 500 + i + 200 <= n),
twice AS (SELECT v FROM w GROUP BY v HAVING count(*) > 1), r AS (SELECT doc_id, pos FROM w JOIN twice USING (v)),
gaps AS (SELECT *, CASE WHEN pos > lag(pos) OVER o + 200 OR lag(pos) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
runs AS (SELECT doc_id, min(pos) AS a, max(pos) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gaps) GROUP BY doc_id, g),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * coalesce(p, 0) + 1, 2 * (a - coalesce(p, 0))), '' ORDER BY a) AS x, max(b) AS last, sum(b - a) AS gone, count(*) AS spans FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM runs) JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
}
