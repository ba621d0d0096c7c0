"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts and benchmark items become lower-case words (runs of letters and digits). Each fixed mask looks at 8 consecutive words
and ignores some of them, so a substituted word inside a passage leaves other hashes intact. Training hashes meet the
benchmark's hashes in a broadcast join in the same stage as the scan (no shuffle of the corpus; the benchmark's rows are counted first, and
beyond a bound the join shuffles instead). Text and item are then laid side by side on the hit's diagonal, and
the pair counts if some stretch of 13 aligned words (the whole item, if it is shorter) has at most 2 substitutions. Words are compared by 64-bit
hashes. MASKS and MORE together hit every stretch of 13 words with 2 substitutions, SHORT every one of 8 words, wherever they lie (a test
enumerates them); items of 8 to 12 words are looked up by SHORT, items of fewer words than 8 as a whole and must stand verbatim. Both cost a
second pass over the texts, only where the benchmark has such items.

Cases: null and empty texts and items never hit; repeated rows get equal results; an empty benchmark clears every row; extra columns pass by.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed masks over 8 words: 1 is looked at, 0 is ignored.
MASKS = ("11011011", "10111101")
#: Covers the placements of two substitutions in 13 words that MASKS miss.
MORE = ("11001011",)
#: For items of 8 to 12 words.
SHORT = ("1111", "110011", "11000011")
SPAN = 8
STRETCH, MISSES = 13, 2
BROADCAST_ROWS = 250_000


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def word_hashes(text: Column) -> Column:
    return F.transform(word_list(text), lambda w: F.xxhash64(w))


def _places(words: Column) -> Column:
    """Array of structs (w0 .. w7), the words at each place and after it; only whole ones count. Built of shifted copies, so that hashing is
    left to compiled code after the array is exploded."""
    return F.arrays_zip(*[F.slice(words, j + 1, F.greatest(F.size(words) - j, F.lit(0))).alias(f"w{j}") for j in range(SPAN)])


def _hash(row: str, mask: str) -> Column:
    return F.xxhash64(*[F.col(f"{row}.w{j}") for j, c in enumerate(mask) if c == "1"])


#: Words that every mask looks at: the join's key; each mask's own hash is compared in the same join.
COMMON = "".join("1" if all(m[j] == "1" for m in MASKS + MORE) else "0" for j in range(SPAN))


def _seeds(rows: DataFrame, keep: list[str], words: Column, place: str) -> DataFrame:
    """keep's columns, the place, `common`, and each mask's hash, for every place where the masks fit. The texts' words don't go with them: rows
    that carried them would grow with the square of a text. The outer form keeps the optimizer from testing the array's size beforehand, which
    would hash every text twice."""
    at = rows.select(*keep, F.posexplode_outer(_places(words)).alias(place, "s"))
    return at.select(*keep, place, _hash("s", COMMON).alias("common"), *[_hash("s", m).alias(f"seed{i}") for i, m in enumerate(MASKS + MORE)], (F.col("s").isNotNull() & F.col("s.w7").isNotNull()).alias("fits"))


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """(common, item_seed0, item_seed1, item_seed2, item_place, item_id) of the benchmark's items of STRETCH words or more."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", word_hashes(F.col("text")).alias("item"))
    items = items.where(F.size("item") >= STRETCH)
    rows = _seeds(items, ["item_id"], F.col("item"), "item_place").where("fits").drop("fits")
    return rows.withColumnsRenamed({f"seed{i}": f"item_seed{i}" for i in range(len(MASKS + MORE))}).distinct()


def _short_seeds(rows: DataFrame, keep: list[str], words: Column, place: str, masks: list[str]) -> DataFrame:
    """keep's columns, the place and each mask's hash as `key`, for every place where the mask fits."""
    at = rows.select(*keep, F.posexplode_outer(_places(words)).alias(place, "s"))
    keys = [F.when(F.col(f"s.w{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(m), _hash("s", m))) for m in masks]
    return at.select(*keep, place, F.explode(F.array(*keys)).alias("key")).where("key is not null")


def _short_hits(texts: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """(__k, __n, item_id, diagonal) of items of fewer than STRETCH words; of a whole item the first place alone. texts: (__k, __n, w)."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", word_hashes(F.col("text")).alias("item"))
    items = materialize(items.where(F.size("item").between(1, STRETCH - 1)), "short")
    sizes = sorted(r["n"] for r in items.select(F.size("item").alias("n")).distinct().collect())
    if not sizes:
        return None
    whole = {n: "1" * n for n in sizes if n < SPAN}
    masks = list(dict.fromkeys([*whole.values(), *(SHORT if sizes[-1] >= SPAN else ())]))
    seeds = _short_seeds(items.where(F.size("item") >= SPAN), ["item_id"], F.col("item"), "item_place", list(SHORT)).withColumn("whole", F.lit(False))
    for n, mask in whole.items():
        seeds = seeds.unionByName(_short_seeds(items.where(F.size("item") == n), ["item_id"], F.col("item"), "item_place", [mask]).withColumn("whole", F.lit(True)))
    seeds = materialize(seeds.distinct(), "short_seeds")
    met = _short_seeds(texts, ["__k", "__n"], F.col("w"), "at", masks).join(F.broadcast(seeds) if seeds.count() <= BROADCAST_ROWS else seeds, "key")
    hits = met.groupBy("__k", "__n", "item_id", F.when(~F.col("whole"), F.col("at") - F.col("item_place")).alias("d")).agg(F.min("at").alias("first"))
    return hits.select("__k", "__n", "item_id", F.coalesce("d", "first").alias("diagonal"))


def _stretches(part: Column, item: Column, diagonal: Column) -> Column:
    """Substitutions in each stretch of min(STRETCH, item's words) of the item, laid on the text so that item word k meets word diagonal + k; part: the text's words
    from max(diagonal, 0) on; stretches lie inside the item."""
    n, skipped = F.least(F.lit(STRETCH), F.size(item)), F.least(diagonal, F.lit(0))
    off = F.transform(F.sequence(F.lit(0), F.size(item) - 1), lambda k: F.when(skipped + k < 0, 1).when(F.get(part, F.greatest(skipped + k, F.lit(0))).eqNullSafe(F.get(item, k)), 0).otherwise(1))
    return F.transform(F.sequence(F.lit(0), F.size(item) - n), lambda a: F.aggregate(F.slice(off, a + 1, n), F.lit(0), lambda s, x: s + x))


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns with (item_id, first_word, misses): a row for each document row, benchmark item and diagonal that overlap; first_word is the first word of the
    text that a counted stretch of the item may begin at. The words of texts that are hit are cut again for the check, once for each text."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(*keep, text.alias("__text"), F.xxhash64(text).alias("__k"), F.octet_length(text).alias("__n"))
    seeds = materialize(item_seeds(benchmark), "seeds")
    few = seeds.count() <= BROADCAST_ROWS
    words = keyed.select("__k", "__n", word_hashes(F.col("__text")).alias("w"))
    spread = _seeds(words, ["__k", "__n"], F.col("w"), "at")
    same = [F.col(f"seed{i}") == F.col(f"item_seed{i}") for i in range(len(MASKS + MORE))]
    met = spread.join(F.broadcast(seeds) if few else seeds, "common").where(F.col("fits") & reduce(or_, same))
    hits = met.select("__k", "__n", "item_id", (F.col("at") - F.col("item_place")).alias("diagonal")).distinct()
    short = _short_hits(words, benchmark)
    hits = materialize(hits if short is None else hits.unionByName(short), "hits")
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", word_hashes(F.col("text")).alias("item"))
    items = items.join(hits.select("item_id").distinct(), "item_id", "left_semi")
    items = F.broadcast(items) if few else items
    sized = hits.join(items, "item_id").groupBy("__k", "__n").agg(F.collect_set(F.struct("item_id", "diagonal", F.size("item").alias("m"))).alias("__hits"))
    texts = keyed.join(F.broadcast(sized) if hits.count() <= BROADCAST_ROWS else sized, ["__k", "__n"])
    # written first: a word list inlined in a lambda would be cut anew for every word
    laid = materialize(texts.select(*keep, "__hits", word_hashes(F.col("__text")).alias("__words")), "laid")
    part = lambda h: F.slice(F.col("__words"), F.greatest(h["diagonal"], F.lit(0)) + 1, F.greatest(h["m"] + F.least(h["diagonal"], F.lit(0)), F.lit(0)))
    each = laid.select(*keep, F.explode(F.transform("__hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["diagonal"].alias("diagonal"), part(h).alias("part")))).alias("__dc"))
    each = each.select(*keep, "__dc.item_id", F.col("__dc.diagonal").alias("__d"), F.col("__dc.part").alias("__part")).join(items.withColumnRenamed("item", "__item"), "item_id")
    found = each.withColumn("__s", _stretches(F.col("__part"), F.col("__item"), F.col("__d"))).withColumn("__most", F.when(F.size("__item") < SPAN, 0).otherwise(MISSES))
    first = F.array_position(F.transform("__s", lambda x: x <= F.col("__most")), True) - 1 + F.col("__d")
    found = found.select(*keep, "item_id", F.greatest(first, F.lit(0)).cast("long").alias("first_word"), F.array_min("__s").cast("long").alias("misses"), "__most")
    return found.where("misses <= __most").drop("__most")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, misses): a row for each doc_id and item, the least of each over its diagonals."""
    rows = contaminated(docs, benchmark, ["doc_id"])
    return rows.groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"), F.min("misses").alias("misses"))
